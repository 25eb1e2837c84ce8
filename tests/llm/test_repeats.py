import hashlib

import numpy as np
import pytest
from text_rows import prose

from tidemark.llm import repeats


def brute(rows):
    """Expected (id, bytes, removed, spans, kept) of rows with distinct texts
    per id, by one set of all 100-byte strings."""
    seen: dict = {}
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}):
        raw = t.encode()
        for i in range(len(raw) - 99):
            seen.setdefault(raw[i:i + 100], (d, i))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            if d is not None and seen[raw[i:i + 100]] != (d, i):
                gone[i:i + 100] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        starts = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    out = []
    for r in repeats.remove_repeats(df).collect():
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:], strict=False))
        out.append((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans),
                    hashlib.sha256(r.kept).hexdigest()))
    return sorted(out, key=str)


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(edge_docs) == brute(rows)
    assert repeats.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot,chunk", [(4096, 1 << 18), (2, 1 << 18), (3, 256)])
def test_passages(spark, monkeypatch, hot, chunk):
    """A passage in many documents, inside one, at edges, next to itself, in
    runs of one byte; with buckets spread and texts scanned in pieces."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    passage, other = prose(7, 50), prose(8, 20)[:101]
    rows = [(i, prose(100 + i, 30) + passage + prose(200 + i, 30)) for i in range(25)]
    rows += [(30, passage * 3), (31, passage[:100]), (32, passage[:99]), (33, passage[1:102]),
             (34, other + "|" + other[1:] + "|" + other[:-1]), (35, "a" * 500), (36, "ab" * 400),
             (37, "é" * 130), (38, "x" + "é" * 90), (39, rows[3][1]), (40, rows[3][1][:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)


def one_id_rows():
    """One id on different texts that share passages with others or nothing."""
    a, b, c, d = (prose(i, 120) for i in (301, 302, 303, 304))
    return [(0, c), (1, c[100:400]), (1, b), (1, b), (2, c[50:300] + d), (2, a + b[:200]), (2, a),
            (1, "short"), (1, None), (3, a[200:450])]


def hash_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h")
    return {r.t: r.h for r in df.collect()}


def test_one_id_on_different_texts(spark):
    """Different texts with one id are documents of their own, in the order
    of their hashes; a text that repeats nothing stays whole."""
    rows = one_id_rows()
    h = hash_of(spark, {t for _, t in rows})
    order = {k: i for i, k in enumerate(sorted({(d, h[t]) for d, t in rows}))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    back = {i: k[0] for k, i in order.items()}
    want = sorted([(back[i], *x) for i, *x in brute([(order[d, h[t]], t) for d, t in rows])], key=str)
    assert result(df) == want
    whole = {r.text for r in repeats.cut_texts(df).collect()}
    assert rows[2][1] in whole or rows[5][1] in whole


def test_cut_texts(spark, edge_docs):
    out = repeats.cut_texts(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] == "" and texts[1] and texts[6] is None and texts[17] == "the quickend"


def phrase_rows(n):
    """One phrase with other words around it in every document, which some
    documents hold in part together."""
    phrase = "0123456789 the same words in every document 0123456789 "
    rows = [(i, prose(100 + i, 12) + phrase + prose(900 + i, 12)) for i in range(n)]
    rows += [(n + i, "zz" + rows[i][1][40:] + prose(2000 + i, 5)) for i in range(0, n, 7)]
    return rows


def test_many_variants_are_not_gathered():
    """Batches that each hold few different runs of a bucket."""
    rows = phrase_rows(1000)
    deals, sent, variants = 8, {}, repeats.Variants(repeats.FAR)
    spread = marked = 0
    for lo in range(0, len(rows), 10):
        docs, texts = zip(*rows[lo:lo + 10], strict=True)
        for cols in repeats._scan_batch(np.array(docs), np.zeros(len(docs), int), texts, deals, variants):
            for kind, buckets, p in zip(cols[1].to_pylist(), cols[2].to_pylist(),
                                        cols[5].to_pylist(), strict=True):
                if kind == 0:
                    for b in buckets:
                        sent[b] = sent.get(b, 0) + 1
                spread += len(p) if kind == 2 else 0
                marked += len(buckets) if kind == 3 else 0
    assert max(sent.values()) <= 2 * repeats.FAR and spread > 500 and marked


def test_spread_over_batches(spark):
    rows = phrase_rows(1000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    assert df.count() == len(rows) and repeats._near(df) == repeats.NEAR
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "9")
    try:
        assert result(df) == brute(rows)
    finally:
        spark.conf.set(size, before)
