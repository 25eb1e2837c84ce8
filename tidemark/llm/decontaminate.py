"""Benchmark leaks by greedy string tiling.

Tokens are words (A-Z lowered).  A document and a test item that share a
seed (``seed`` consecutive tokens) are tiled: running Karp-Rabin hashes find
the longest matches of unmarked tokens on both sides, matches are marked from
the longest down without overlaps, and the search goes on with shorter ones
until none of ``shortest`` tokens is left.  The share of an item's tokens
under tiles is its coverage; reordered passages keep theirs, since tiles
may stand in any order.  A document leaks an item from ``threshold`` on.

The test table is a stated query set: it is read in blocks of a fixed
number of bytes, and each block's seeds and tokens go to the tasks as one
broadcast of that size, so documents never move, whatever the size of the
benchmark.  A document is tiled against every item it shares a seed with.

Defined results: items of fewer tokens than a seed are compared whole (the
seed is then as long as the item); items without tokens, and NULL texts,
match nothing; items that repeat are counted each; NULL ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import cut_lineage

from .batches import slices
from .registry import load, query
from .shingles import rolling_hashes, run_hashes, word_hashes

SEED = 5
SHORTEST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20      # of item texts broadcast at once
SIEVE_BITS = 20


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower())


def _free_runs(x: np.ndarray, free: np.ndarray, k: int):
    """Places of ``k`` unmarked tokens, and the rolling hashes there."""
    if len(x) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(marked[k:] == marked[:-k])
    return at, rolling_hashes(x, k)[at]


def _mark(doc, item, free_doc, free_item, k: int) -> list[tuple[int, int, int]]:
    """Marks matches of ``k`` tokens, none of which is longer: by place in the
    item, then in the document.  Places in the document are taken up in order
    for each hash, so that equal passages cost no pairs."""
    at_doc, hash_doc = _free_runs(doc, free_doc, k)
    at_item, hash_item = _free_runs(item, free_item, k)
    order = np.argsort(hash_doc, kind="stable")
    at_doc, hash_doc = at_doc[order], hash_doc[order]
    low = np.searchsorted(hash_doc, hash_item, "left")
    high = np.searchsorted(hash_doc, hash_item, "right")
    some = high > low
    passed: dict[int, int] = {}  # of each hash, places before this one are marked
    tiles = []
    # tiles have k tokens or more: one inside a run would cover one of its ends
    for j, lo, hi in zip(at_item[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
        if not (free_item[j] and free_item[j + k - 1]):
            continue
        p = passed.get(lo, lo)
        while p < hi and not (free_doc[at_doc[p]] and free_doc[at_doc[p] + k - 1]):
            p += 1
        passed[lo] = p
        for i in at_doc[p:hi].tolist():
            if free_doc[i] and free_doc[i + k - 1] and np.array_equal(doc[i:i + k], item[j:j + k]):
                free_doc[i:i + k] = free_item[j:j + k] = False
                tiles.append((i, j, k))
                break
    return tiles


def tile(doc: np.ndarray, item: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (place in ``doc``, place in ``item``, tokens) in the order they
    are marked: longest first, then by place in the item and the document."""
    shortest = max(1, min(shortest, len(item)))
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)

    def matches(k: int) -> bool:
        return bool(np.isin(_free_runs(item, free_item, k)[1], _free_runs(doc, free_doc, k)[1]).any())

    tiles: list[tuple[int, int, int]] = []
    longest = len(item)
    while longest >= shortest and matches(shortest):
        low, high = shortest, longest
        while low < high:  # the greatest length that still matches
            mid = (low + high + 1) // 2
            low, high = (mid, high) if matches(mid) else (low, mid - 1)
        tiles += _mark(doc, item, free_doc, free_item, low)
        longest = low if matches(low) else low - 1
    return tiles


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items, in driver memory, one block of bounded bytes at a time."""
    held, size = [], 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.filter(F.col("t").isNotNull()).toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


class Seeds:
    """Seeds of one block of items, sorted by hash."""

    def __init__(self, block, seed: int = SEED):
        self.items = [(i, tokens(t)) for i, t in block]
        self.items = [(i, x) for i, x in self.items if len(x)]
        hashes, owner = [], []
        self.lengths = sorted({min(seed, len(x)) for _, x in self.items})
        for n, (_, x) in enumerate(self.items):
            h = np.unique(run_hashes(x, seed))
            hashes.append(h)
            owner.append(np.full(len(h), n))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owner = self.hashes[order], self.owner[order]
        # one bit for the low part of each hash: most places stop here
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._low(self.hashes)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a seed with the document."""
        found = []
        for k in self.lengths:
            if len(doc) < k:
                continue
            h = run_hashes(doc, k)
            h = np.unique(h[self.sieve[self._low(h)]])
            lo = np.searchsorted(self.hashes, h, "left")
            n = np.searchsorted(self.hashes, h, "right") - lo
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(self.owner[np.repeat(lo, n) + step])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED,
             shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that share a seed: ``id``,
    ``item``, ``n_tiles``, ``n_tiled`` (item tokens under tiles),
    ``n_tokens`` (of the item) and ``coverage``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = items.schema[item_col].dataType
    item_type = to_arrow_type(kind)
    schema = T.StructType([
        T.StructField("id", src.schema["id"].dataType), T.StructField("item", kind),
        T.StructField("n_tiles", T.LongType()), T.StructField("n_tiled", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("coverage", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            seeds = Seeds(shared.value, seed)
            for b in slices(batches, 1):
                ids, rows = [], []
                for at, t in enumerate(b.column(1).to_pylist()):
                    doc = tokens(t)
                    for n in seeds.candidates(doc).tolist():
                        item, x = seeds.items[n]
                        tiles = tile(doc, x, shortest)
                        tiled = sum(k for _, _, k in tiles)
                        ids.append(at)
                        rows.append((item, len(tiles), tiled, len(x), tiled / len(x)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids, pa.int64())),
                     *(pa.array(c, k) for c, k in zip(
                         cols, (item_type, pa.int64(), pa.int64(), pa.int64(),
                                pa.float64()), strict=True))], names=schema.names)

        out = out.unionByName(src.mapInArrow(run, schema))
    return out


def assess(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED,
           shortest: int = SHORTEST, threshold: float = THRESHOLD,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document that shares a seed with an item: ``n_items``, ``best_item``
    (highest coverage, then smallest id, NULL first), ``coverage``,
    ``n_leaked`` (items at or over the threshold) and ``leaked`` (their ids,
    sorted; a NULL id counts in ``n_leaked`` but cannot be listed)."""
    pairs = overlaps(docs, items, id_col, text_col, item_col, item_text_col, seed, shortest,
                     block_bytes).filter("id IS NOT NULL")
    # rows that repeat an id: the item's best coverage counts
    per_item = pairs.groupBy("id", "item").agg(F.max("coverage").alias("coverage"))
    best = F.min(F.struct((-F.col("coverage")).alias("minus"), "item"))
    over = F.sort_array(F.collect_list(F.when(F.col("coverage") >= threshold, F.col("item"))))
    out = per_item.groupBy("id").agg(F.count(F.lit(1)).alias("n_items"), best.alias("best"),
                                     F.count_if(F.col("coverage") >= threshold).alias("n_leaked"),
                                     over.alias("leaked"))
    return out.select(F.col("id").alias(id_col), "n_items",
                      F.col("best.item").alias("best_item"),
                      (-F.col("best.minus")).alias("coverage"), "n_leaked", "leaked")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """``docs`` without the rows that leak an item; NULL ids stay."""
    found = assess(docs, items, id_col, text_col, **options)
    gone = cut_lineage(found.filter("n_leaked > 0").select(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


@query("op10_string_tiling_leaks")
def op10_string_tiling_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the items it shares seeds with, its best coverage, the
    items it leaks, and whether it stays."""
    docs = load(spark, sf_dir, "documents")
    found = cut_lineage(assess(docs, load(spark, sf_dir, "benchmark")))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item",
                       F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
                       F.coalesce("leaked", F.array().cast(found.schema["leaked"].dataType)).alias("leaked"),
                       (F.coalesce("n_leaked", F.lit(0)) == 0).alias("kept"))
