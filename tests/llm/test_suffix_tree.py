import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from text_rows import EDGE_SCHEMA, edge_rows, prose

from tidemark.llm import suffix_tree

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def brute(rows, depth, min_count, evidence, mu):
    """The stated tree over dictionaries, without blocks."""
    texts = [(d, tokens(t), d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in rows]
    c = Counter(w for _, ws, held in texts if not held for w in ws)
    n, z = sum(c.values()), sum(c.values()) + len(c) + 1
    rare = sum(v + 1 for v in c.values() if v < min_count) + 1

    def symbol(w):
        return (w,) if c[w] >= min_count else ()

    def p0(w):
        return (c[w] + 1) / z if symbol(w) else rare / z

    grams, follow = [Counter() for _ in range(depth + 2)], {}
    for _, ws, held in texts:
        if not held:
            for j in range(len(ws)):
                for d in range(depth + 1):
                    if d <= j and all(symbol(w) for w in ws[j - d:j]):
                        ctx = tuple(ws[j - d:j])
                        follow.setdefault(ctx, Counter())[symbol(ws[j])] += 1
                        if symbol(ws[j]):
                            grams[d + 1][(*ctx, ws[j])] += 1
    kept = {(): True}

    def retained(ctx):
        if ctx not in kept:
            kept[ctx] = False
            total = grams[len(ctx)][ctx]
            if total >= min_count and retained(ctx[1:]) and (len(ctx) < 3 or retained(ctx[1:-1])):
                t = sum(x * math.log(x / total / prob(ctx[1:], y)) for y, x in follow[ctx].items())
                kept[ctx] = t >= evidence * len(follow[ctx])
        return kept[ctx]

    def prob(ctx, y):
        if not ctx:
            return (c[y[0]] + 1) / z if y else rare / z
        total = grams[len(ctx)][ctx]
        return (follow[ctx][y] + mu * prob(ctx[1:], y)) / (total + mu)

    out = []
    for d, ws, held in texts:
        base = score = 0.0
        deep = 0
        for j, w in enumerate(ws):
            base += math.log10((c[w] + 1) / z)
            ctx = ()
            for k in range(1, min(depth, j) + 1):
                if all(symbol(x) for x in ws[j - k:j]) and retained(tuple(ws[j - k:j])):
                    ctx = tuple(ws[j - k:j])
                else:
                    break
            deep += bool(ctx)
            score += math.log10(prob(ctx, symbol(w)) * (1 if symbol(w) else (c[w] + 1) / rare))
        out.append((d, held, len(ws), sum(c[w] > 0 for w in ws), n, base, score, deep))
    return sorted(out, key=lambda r: (str(r[0]), *r[2:4], round(r[5], 6)))


def scored(spark, rows, schema, **kw):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    return sorted((tuple(r) for r in suffix_tree.score(docs, held_out(), **kw).collect()),
                  key=lambda r: (str(r[0]), *r[2:4], round(r[5], 6)))


def chain_rows(n):
    """Words that depend on the one or two words before them."""
    r, rows = random.Random(1), []
    for i in range(n):
        ws = ["a", "b"]
        for _ in range(r.randint(0, 60)):
            ws.append({"a": "b", "b": "c"}.get(ws[-1], "d") if r.random() < 0.6 else
                      "e" if ws[-2:] == ["c", "d"] and r.random() < 0.9 else r.choice("abcdefgh"))
        rows.append((i, " ".join(ws) + (f" Rare{i}" if i % 3 else "")))
    return rows


@pytest.mark.parametrize("depth, min_count, evidence, mu", [(2, 4, 0.5, 3.0), (1, 1, 0.1, 1.0), (2, 30, 1.0, 8.0)])
def test_against_brute_force(spark, depth, min_count, evidence, mu):
    kw = {"depth": depth, "min_count": min_count, "evidence": evidence, "mu": mu}
    for rows, schema in ((edge_rows(), EDGE_SCHEMA), (chain_rows(150), "doc_id long, text string")):
        got, want = scored(spark, rows, schema, root_share=0.0, **kw), brute([r[:2] for r in rows], depth, min_count, evidence, mu)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for g, w in zip(got, want, strict=True):
            assert g[5:7] == pytest.approx(w[5:7], rel=1e-9) and g[7] == w[7]


def test_least_count_follows_the_corpus(spark):
    n = sum(len(tokens(t)) for i, t in chain_rows(150) if zlib.crc32(str(i).encode()) % 7 != 2)
    least = math.ceil(0.5 * math.sqrt(n))
    assert least > 20
    got = scored(spark, chain_rows(150), "doc_id long, text string", root_share=0.5, evidence=0.5, mu=3.0)
    for g, w in zip(got, brute(chain_rows(150), 2, least, 0.5, 3.0), strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], rel=1e-9) and g[7] == w[7]


def test_default_least_count_is_one_at_every_size(spark):
    """Words seen nine times, in a corpus whose root would ask for more."""
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, "a b c d " * 9000) for i in learnt[:8]] + [(i, "new york is a b") for i in learnt[8:17]]
    assert 0.02 * math.sqrt(8 * 36000) > 9
    want = brute(rows, suffix_tree.DEPTH, suffix_tree.MIN_COUNT, suffix_tree.EVIDENCE, suffix_tree.MU)
    for g, w in zip(scored(spark, rows, "doc_id long, text string"), want, strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], rel=1e-9) and g[7] == w[7]


def test_contexts_in_parts_and_buckets_do_not_matter(spark):
    kw = {"depth": 2, "min_count": 4, "evidence": 0.5, "mu": 3.0}
    got = scored(spark, chain_rows(150), "doc_id long, text string", part=7, bucket=300, root_share=0.0, **kw)
    for g, w in zip(got, brute(chain_rows(150), **kw), strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], rel=1e-9) and g[7] == w[7]


def test_blocks_do_not_matter(spark):
    rows = chain_rows(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in suffix_tree.score(docs.coalesce(1), held_out()).collect()}
    for r in suffix_tree.score(docs.repartition(40), held_out()).collect():
        assert r.score == pytest.approx(one[r.doc_id], rel=1e-9)


def test_held_out_rows_score_better_with_contexts(spark):
    docs = spark.createDataFrame(chain_rows(600), "doc_id long, text string")
    held = suffix_tree.score(docs, held_out()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.9


def test_empty_table(spark, no_docs):
    assert suffix_tree.score(no_docs, held_out()).count() == 0


def test_nothing_learnt(spark):
    rows = [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in scored(spark, rows, "doc_id long, text string"):
        assert r[1:7] == (True, 3, 0, 0, 0.0, 0.0)


def test_next_symbols_sum_to_one():
    """Words 0 and 1 are symbols, 2 shares one with others; all follow word 0."""
    # 48 words seen 120 times together are no symbols
    totals = suffix_tree.Totals(1000, 50, 168, least=200)
    r = suffix_tree.Replay(np.array([0, 0, 0, 1, 0, 2]), np.array([2] * 3), np.ones(3, np.uint8),
                           np.array([500, 380, 119]), np.array([7, 9, 0]), totals, 30.0)
    assert r.p[1::2].sum() == pytest.approx(1)
    r.open()
    r.close(np.array([{0: 50, 1: 300, 2: 150}[s] for s in r.next.tolist()]), np.ones(3, bool))
    assert r.p[1::2].sum() == pytest.approx(1)
    assert r.depth.tolist() == [0, 1] * 3


def test_frequent_contexts_in_parts():
    """Sums of a bucket, with a context that stands in several parts."""
    pack = suffix_tree._pack

    def row(b, context, parts, sizes, lp, symbols, n):
        return {"bucket": 3, "b": b, "context": pack(np.array(context, np.uint64)), "parts": pack(np.array(parts)),
                "sizes": pack(np.array(sizes)), "lp": pack(np.array(lp, np.float64)),
                "symbols": pack(np.array(symbols)), "n": pack(np.array(n))}

    rows = pa.Table.from_pylist([row(1, [5, 9], [1, 2], [2, 1], [-9.0, -1.0], [2, 3, 4], [5, 4, 6]),
                                 row(2, [9, 5], [2, 1], [2, 1], [-2.0, -8.0], [4, 6, 3], [7, 0, 9])])
    out = suffix_tree._sum_bucket(rows, 3, 0.5).to_pylist()
    answers = {r["b"]: (suffix_tree._unpack(r["v"], np.int64).tolist(), suffix_tree._unpack(r["w"], np.uint8).tolist())
               for r in out if r["e"] == -1}
    # context 5: counts 5 and 13 of 18, 17 below by the shorter one
    assert 5 * math.log(5 / 18) + 13 * math.log(13 / 18) + 17 > 1
    assert answers == {1: ([5, 13, 13], [1, 0]), 2: ([13, 0, 13], [0, 1])}
    assert sorted((r["b"], r["e"], r["context"]) for r in out if (r["e"] or -1) >= 0 or r["e"] == 0) == [
        (1, 1, 9), (2, 0, 9)]
    assert [(r["context"], r["total"], r["different"], r["lp"]) for r in out if r["b"] is None] == [(9, 13.0, 1, -3.0)]
    blocks = [list(range(i, 120, 4)) for i in range(4)]
    rows = chain_rows(120)
    code = suffix_tree.Replay
    for ids in blocks:
        ws = [[w for w in tokens(rows[i][1])] for i in ids]
        words_ = sorted({w for x in ws for w in x if w})
        number = {w: i + 1 for i, w in enumerate([None, *words_])}
        n = np.array([sum(w == x for y in ws for x in y) for w in number])
        r = code(np.array([number[w] - 1 for x in ws for w in x]), np.array([len(x) for x in ws]),
                 np.ones(len(ws), np.uint8), n, np.array(list(number.values())),
                 suffix_tree.Totals(int(n.sum()), len(n), 0, 1, 5, 7, 2), 3.0)
        r.open()
        assert r.parts.max() > 1 and r.bucket.max() == 4 and r.sizes.sum() == len(r.key)
        # a run is one context; every event stands in one run
        run = np.repeat(np.arange(len(r.runs)), r.sizes)
        assert all(len(set(r.context[run == i].tolist())) == 1 for i in range(len(r.runs)))
        assert len(set(zip(r.context.tolist(), r.next.tolist(), strict=True))) == len(r.key)
        assert r.in_train.sum() == len(r.at)


def test_events_are_packed_as_differences():
    r = np.random.default_rng(2)
    for a in (np.zeros(0, np.uint64), r.integers(0, 1 << 64, 50, np.uint64, endpoint=False),
              np.sort(r.integers(0, 1 << 40, 50)).astype(np.uint64)):
        assert (suffix_tree._whole(suffix_tree._halves(a)) == a).all()
    sizes = np.array([3, 1, 4, 2])
    a = np.array([0, 5, 9, 7, 2, 3, 5, 1 << 40, 0, 1])
    assert suffix_tree._steps(a, sizes).tolist() == [0, 5, 4, 7, 2, 1, 2, (1 << 40) - 5, 0, 1]
    assert (suffix_tree._climbed(suffix_tree._steps(a, sizes), sizes) == a).all()
    # contexts of two words in a block's order, where hashes would take 8 bytes each
    pairs = np.unique(np.minimum(r.zipf(1.3, (4000, 2)), 1 << 17), axis=0).astype(np.uint64)
    packed = suffix_tree._pack(suffix_tree._halves(pairs[:, 0] << np.uint64(32) | pairs[:, 1]))
    assert len(packed) < 4 * len(pairs)


def test_contexts_are_exact_pairs_or_hashes():
    """Numbers that pass 32 bits are hashed; a block's symbols are in the numbers' order."""
    keys = []
    for own in (10, 1 << 32):
        totals = suffix_tree.Totals(1000, 50, 0, least=1, own=own)
        r = suffix_tree.Replay(np.array([0, 1, 0, 1, 1]), np.array([5]), np.ones(1, np.uint8),
                               np.array([500, 380]), np.array([9, 7]), totals, 30.0)
        assert r.number.tolist() == [0, 7, 9] and r.symbol.tolist() == [2, 1, 2, 1, 1]
        r.open()
        assert r.context.tolist() == [7, 7, 9]
        keys.append(r.key.tolist())
    assert keys[0] == [7 << 32 | 7, 7 << 32 | 9, 9 << 32 | 7] and not set(keys[0]) & set(keys[1])


def test_tables_go_when_nothing_reads_them(spark, monkeypatch):
    """At the end of a run only the blocks and one table of answers a level are left."""
    left, leave = [], suffix_tree.Scratch.__exit__

    def end(self, *a):
        left.append([t.columns for t, _ in self.tables])
        return leave(self, *a)

    monkeypatch.setattr(suffix_tree.Scratch, "__exit__", end)
    scored(spark, chain_rows(40), "doc_id long, text string")
    assert len(left[0]) == 1 + 1 + suffix_tree.DEPTH and not any("words" in c or "lp" in c for c in left[0])
