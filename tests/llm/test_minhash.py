import random
import re

import numpy as np
import pytest
from text_rows import prose

from tidemark.llm import links, minhash
from tidemark.llm.shingles import rolling_hashes, shingle_set, word_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets: dict = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y)
                             for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(shingles(t)), None if d is None else find(d),
                    d is None or find(d) == d) for d, t in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)


def test_edges(edge_docs, no_docs):
    assert result(edge_docs) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert minhash.near_duplicates(no_docs).count() == 0
    out = minhash.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(1) == 2 and not {3, 4} & set(kept) and kept.count(None) == 3


@pytest.mark.parametrize("block", [300, 1 << 19])
def test_hot_buckets_and_chains(spark, block):
    """Copies of one text, chains of near copies, and many texts that share a
    passage without being near copies."""
    r = random.Random(5)
    words = prose(1, 100).split()
    rows = [(i, " ".join(words)) for i in range(30)]
    chain = list(words)
    for i in range(30, 50):
        chain = list(chain)
        chain[r.randrange(100)] = f"c{i}"
        rows.append((i, " ".join(chain)))
    passage = prose(2, 60)
    for i in range(50, 110):
        rows.append((i, passage + " " + prose(1000 + i, 40)))
    for i in range(110, 130):
        rows.append((i, passage + " " + prose(1000 + i - 60, 40) + f" tail{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(x) for x in minhash.near_duplicates(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_estimate():
    rng = np.random.default_rng(3)
    a, b, na, nb, true = [], [], [], [], []
    for k in range(60):
        both = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        one, two = (rng.integers(0, 1 << 63, 20 + 10 * k, dtype=np.uint64) for _ in range(2))
        x, y = np.unique(np.r_[both, one] * 2), np.unique(np.r_[both, two] * 2)
        a.append(minhash.registers(x))
        b.append(minhash.registers(y))
        na.append(len(x))
        nb.append(len(y))
        true.append(len(both) / (len(x) + len(y) - len(both)))
    j, used = minhash.estimate(np.array(a), np.array(b), np.array(na), np.array(nb))
    assert abs(j - true).mean() < 0.05 and (used > 0.9 * minhash.REGISTERS).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (150, 300), (7, 7)]
    got = {r.id: r.root for r in links.components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100, 150: 100}
    none = spark.createDataFrame([], "a long, b long")
    assert links.components(none).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b c d", "A b\tc\x0bd e f", "w " * 1000,
                                  "x" * 600_000, ("q" * 3000 + " ") * 300])
def test_shingle_sets(text):
    assert len(shingle_set(text)) == len(shingles(text))


def test_rolling_hashes():
    words = word_hashes(b"a b c a b c d a b")
    h = rolling_hashes(words, 2)
    assert h[0] == h[3] == h[7] and h[1] == h[4] and len(set(h.tolist())) == 5
    assert len(rolling_hashes(words, 10)) == 0
