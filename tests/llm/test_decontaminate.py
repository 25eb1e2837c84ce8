import random
from difflib import SequenceMatcher

import numpy as np
from text_rows import prose

from tidemark.llm import decontaminate as dc


UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def naive_tiles(doc, item, shortest):
    """Greedy string tiling as stated: all maximal matches, longest first."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    shortest, out = max(1, min(shortest, len(item))), []
    while True:
        best, found = 0, []
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while (i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]
                       and free_d[i + k] and free_i[j + k]):
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if best < shortest:
            return out
        for i, j in found:
            if all(free_d[i:i + best]) and all(free_i[j:j + best]):
                free_d[i:i + best] = [False] * best
                free_i[j:j + best] = [False] * best
                out.append((i, j, best))


def test_tiles():
    r = random.Random(2)
    for _ in range(200):
        doc = [r.choice("abcd") for _ in range(r.randint(0, 40))]
        item = [r.choice("abcd") for _ in range(r.randint(1, 20))]
        if r.random() < 0.5:
            k = r.randint(0, len(item))
            doc += item[k:] + ["z"] + item[:k]
        code = {c: np.uint64(n * 7919 + 3) for n, c in enumerate("abcdz")}
        to = lambda x: np.array([code[c] for c in x], np.uint64)
        assert dc.tile(to(doc), to(item), 3) == naive_tiles(doc, item, 3)


def test_verdicts(spark, edge_docs, no_docs):
    item = prose(70, 40)
    w = item.split()
    moved = " ".join(w[20:] + ["between", "them"] + w[:20])
    docs = spark.createDataFrame(
        [(1, prose(71, 80) + " " + item), (2, prose(72, 80) + " " + moved + " " + prose(73, 20)),
         (3, prose(74, 200)), (4, prose(75, 30) + " " + " ".join(w[:9])), (5, None), (6, ""),
         (None, item), (7, item.translate(UPPER)), (8, "alpha beta"), (1, prose(71, 80) + " " + item)],
        "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "alpha beta"),
                                   (14, prose(76, 30)), (10, item)], "item_id long, text string")
    for block in (1, 1 << 20):  # one item a block, and all in one
        got = {r.doc_id: r for r in dc.assess(docs, items, block_bytes=block).collect()}
        assert got[1].leaked == got[2].leaked == got[7].leaked == [10]
        assert got[8].leaked == [13] and got[4].leaked == [] and 0 < got[4].coverage < 0.5
        assert 3 not in got and 5 not in got
        kept = dc.keep_clean(docs, items, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5, 6, None]
    assert dc.assess(edge_docs, items).filter("size(leaked) > 0").count() == 0
    assert dc.assess(no_docs, items).count() == 0
    assert dc.keep_clean(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_close_items_by_difflib(spark):
    """Coverage is at least the longest common run that difflib finds."""
    a, b = prose(80, 60).split(), prose(80, 60).split()
    b[30] = "other"
    code = {}
    to = lambda x: np.array([code.setdefault(c, len(code) + 1) * 104729 for c in x], np.uint64)
    x, y = to(a), to(b)
    run = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert dc.tile(x, y)[0][2] == run.size
    assert sum(t[2] for t in dc.tile(x, y)) == 59


def test_item_ids_of_all_kinds(spark):
    """NULL, int and string item ids, alone and mixed; a full copy never stays."""
    a, b = prose(90, 40), prose(91, 40)
    docs = spark.createDataFrame([(1, a), (2, b), (3, prose(92, 60)), (4, a + " " + b)], "doc_id long, text string")
    for kind, ids in (("int", (7, 8)), ("string", ("x", "y")), ("long", (None, 8)), ("int", (None, None)),
                      ("date", (None, None))):
        items = spark.createDataFrame([(ids[0], a), (ids[1], b)], f"item_id {kind}, text string")
        found = {r.doc_id: r for r in dc.assess(docs, items).collect()}
        listed = [i for i in ids if i is not None]
        assert found[1].coverage == found[2].coverage == 1.0
        assert found[4].leaked == listed and found[1].leaked == listed[:1] * (ids[0] is not None)
        assert [r.doc_id for r in dc.keep_clean(docs, items).collect()] == [3]


def test_repetitive_texts_cost_no_pairs():
    """200,000 equal words against 2,000 of them, and mixed with others."""
    one = np.uint64(12345)
    tiles = dc.tile(np.full(200_000, one), np.full(2_000, one))
    assert tiles == [(0, 0, 2000)]
    doc = np.where(np.arange(200_000) % 7 == 6, np.arange(200_000).astype(np.uint64) + np.uint64(10 ** 9), one)
    tiles = dc.tile(doc, np.full(2_000, one))
    assert sum(k for *_, k in tiles) >= 1998 and {k for *_, k in tiles} <= {5, 6}
