import zlib
from collections import Counter, defaultdict

from tidemark.llm import shards


def check(rows, source, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
        for r in source)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total = sum(r.size for r in rows)
    assert set(by) <= set(range(n))
    before = 0
    order = []
    for s in sorted(by):
        part = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        for r in part:  # a row's first byte decides
            assert min(n - 1, before * n // total) == s
            before += r.size
        order += [(r.doc_id is not None, r.doc_id or 0) for r in part]
    assert order == sorted(order)


def test_rows(edge_docs, no_docs):
    check(shards.shard(edge_docs, 4).collect(), edge_docs.collect(), 4)
    check(shards.shard(edge_docs, 24).collect(), edge_docs.collect(), 24)
    assert shards.shard(no_docs, 24).count() == 0


def test_one_id_on_all_rows(spark):
    same = spark.range(500).selectExpr("1L AS doc_id", "'abc' AS text")
    rows = shards.shard(same, 5).collect()
    assert Counter(r.shard for r in rows) == Counter({s: 100 for s in range(5)})


def test_balance(spark, edge_docs):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 37 AS INT)) AS text")
    rows = shards.shard(docs, 24).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 45
