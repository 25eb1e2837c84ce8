import re
from collections import Counter

import zstandard
from text_rows import by_row
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1
               for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é|\x0b "), max_size=80))
def test_counts(text):
    z = zstandard.ZstdCompressor(level=3)
    assert quality.measure(text, quality.Bands(), z)[:5] == brute(text)


def test_rows(edge_docs, no_docs):
    got = by_row(quality.assess(edge_docs), "doc_id", "n_words", "word_chars", "n_symbols",
                 "n_dup_lines", "n_repeat_words")
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in edge_docs.collect()), key=str)
    assert quality.assess(no_docs).count() == 0
    kept = {r.doc_id: r for r in quality.assess(edge_docs).collect() if r.doc_id}
    assert kept[1].kept
    assert not kept[14].kept and not kept[15].kept and kept[6].base_failed


def test_bands(spark):
    import base64
    import random
    noise = base64.b64encode(random.Random(1).randbytes(3000)).decode()
    spaced = " ".join(noise[i:i + 7] for i in range(0, len(noise), 7))
    docs = spark.createDataFrame([(1, spaced), (2, spaced.replace("+", " "))], "doc_id long, text string")
    assert not any(r.kept for r in quality.assess(docs).collect())


def test_keep_good_columns(edge_docs):
    out = quality.keep_good(edge_docs)
    assert out.schema.names == edge_docs.schema.names
    want = {r.doc_id for r in quality.assess(edge_docs).filter("kept").collect()}
    assert {r.doc_id for r in out.collect()} == want
