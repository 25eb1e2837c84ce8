import base64
import hashlib

import numpy as np
import tiktoken
from text_rows import EDGE_SCHEMA, edge_rows, prose

import corpus_pipeline
from tidemark.llm import byte_bpe


def rich(seed, n):
    """Prose of a wide vocabulary, which the bands take for text."""
    import random
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages_against_brute_force(spark, tmp_path):
    item = rich(900, 40)
    texts = {1: rich(1, 150), 2: rich(2, 150), 4: rich(4, 100), 5: rich(5, 200), 6: "too short",
             7: rich(7, 100) + " " + item, 8: "again and again " * 100, 9: None, 10: ""}
    words = texts[1].split()
    words[70] = "edited"
    texts[3] = " ".join(words)                      # near copy of 1
    texts[11] = texts[2]                            # copy of 2
    shared = rich(50, 60)
    texts[4] += " " + shared
    texts[5] += " " + shared
    docs = spark.createDataFrame(
        [(d, t, "en", f"src{d}", len(t or "")) for d, t in texts.items()],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4, 5}
    cut = (" " + shared).encode()
    five = texts[5].encode()
    assert five.endswith(cut)
    want = {1: texts[1], 2: texts[2], 4: texts[4], 5: five[:-len(cut)].decode()}
    ranks, pattern = byte_bpe.default_ranks()
    enc = tiktoken.Encoding("t", pat_str=pattern, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))})
    for d, text in want.items():
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([(1, prose(70, 40))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for rows in (edge_rows(), []):
        docs = spark.createDataFrame(rows, EDGE_SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
