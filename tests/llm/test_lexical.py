import math
import random
import re
from collections import Counter

import pytest
from text_rows import EDGE_SCHEMA, edge_rows, prose

from tidemark.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    texts = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in texts:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, rows, items, schema=EDGE_SCHEMA, item_type="long", **kw):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    qs = spark.createDataFrame(items, f"item_id {item_type}, text string, score int, rank int")
    return sorted((tuple(r) for r in lexical.search(docs, qs, **kw).collect()), key=str)


ITEMS = [(1, prose(0, 120)), (2, prose(99, 60)), (2, "one two"), (3, None), (4, ""), (5, "?!"),
         (None, "same words here again same"), (6, "unheard"), (7, "EMOJI 😀 nbsp"), (8, prose(50, 60_000))]


@pytest.mark.parametrize("kw", [{}, {"k": 3, "width": 8}, {"block_bytes": 500}, {"k": 1, "width": 1}])
def test_against_brute_force(spark, kw):
    rows, items = edge_rows(), [(*x, 1, 2) for x in ITEMS]
    want = brute([r[:2] for r in rows], ITEMS, kw.get("k", 10))
    assert found(spark, rows, items, **kw) == want


def test_random_rows_with_copies_and_ties(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randint(0, 80), r.randint(1, 60))) for i in range(300)]
    rows += [(1000 - i, rows[7][1]) for i in range(200)] + [rows[9]] * 20
    items = [(f"q{i}", rows[r.randint(0, 299)][1]) for i in range(12)]
    got = found(spark, rows, [(*x, 1, 2) for x in items], "doc_id long, text string", "string")
    assert got == brute(rows, items, 10)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "one", 1, 2)]) == []
    assert found(spark, edge_rows(), []) == []


def test_bounds_hold_and_spare_scores():
    texts = [prose(i, 80).lower() for i in range(400)]
    counts = [Counter(lexical.terms(t.encode())) for t in texts]
    norms = [100] * 400
    q = list(dict.fromkeys(lexical.terms(texts[3].encode())))
    b = lexical.Best(q, [500] * len(q), 10, lexical.WIDTH)
    sketch = lexical.sketches(counts, norms)
    bounds = b.weights @ sketch[b.at]
    exact = [sum(500 * lexical.impact(c[t], 100) for t in q if t in c) for c in counts]
    assert all(x >= y for x, y in zip(bounds, exact, strict=True))
    b.take(list(range(400)), counts, norms, sketch)
    assert b.scored < 100
    assert b.rows == [(-s, True, d) for s, d in sorted(zip((-e for e in exact), range(400), strict=True))[:10]
                      for s in [-s]]
