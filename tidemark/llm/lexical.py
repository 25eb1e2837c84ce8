"""Ranked lexical search with hashed max-sketches.

A term's impact in a document grows with its count there and falls with the
document's length; an item's score for a document sums its terms' weights
times their impacts.  The impacts of a document fold into a sketch of
``WIDTH`` coordinates, each the largest impact of the terms hashed to it, so
weights times the coordinates of an item's terms are an upper bound of its
score.  A task takes its documents slice by slice: bounds of all items by
lookups in the slice's sketches, then exact scores in the order of falling
bounds until a bound lies below the k-th best score so far.  Equal bounds are
still scored, since a tie may have the smaller id.

Two passes over the documents serve a block of items: the first counts
documents, terms and the documents that hold each of the block's terms (one
row for a term and task), the second searches.  Every task hands on its k
best for each item, which are merged in two steps.  Items go to the tasks in
blocks of ``BLOCK_BYTES`` of text, the only thing that is broadcast; nothing
of the documents passes through the driver but the counts of a block's terms.

Defined results: NULL or empty text has no terms and is never found; an item
without terms finds nothing; NULL ids come before all others among equal
scores; rows that repeat an id are documents of their own; items that repeat
an id are ranked each for itself; empty tables give no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .registry import load, query

WIDTH = 4096              # coordinates of a sketch
SLICE_ROWS = 1024         # documents sketched at once, at most
BLOCK_BYTES = 8 << 20     # text of the items searched for at once
MERGE_SALTS = 64
# every byte to itself in lower case, or to a space where it ends a term
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
                   for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return raw.translate(TERM_BYTES).split() if raw else []


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 10 + 90 * n * n_docs // n_terms


def sketches(counts: list[Counter], norms: list[int], width: int = WIDTH) -> np.ndarray:
    """One column a document: the largest impact at each coordinate."""
    out = np.zeros(width * len(counts), np.int32)
    for d, (c, m) in enumerate(zip(counts, norms, strict=True)):
        at = np.fromiter(map(crc32, c), np.int64, len(c)) % width * len(counts) + d
        tf = np.fromiter(c.values(), np.int64, len(c))
        np.maximum.at(out, at, impact(tf, m).astype(np.int32))
    return out.reshape(width, len(counts))


class Best:
    """The k best documents of one item: highest score, then smallest id."""

    def __init__(self, terms_: list[bytes], weights: list[int], k: int, width: int):
        self.terms = list(zip(terms_, weights, strict=True))
        self.at = np.array([crc32(t) % width for t in terms_], np.int64)
        self.weights = np.array(weights, np.float64)
        self.k, self.rows, self.least, self.scored = k, [], 1, 0

    def take(self, ids: list, counts: list[Counter], norms: list[int], sketch: np.ndarray) -> None:
        """Search a slice in the order of falling bounds."""
        if not self.terms:
            return
        # sums of whole numbers: exact up to 2**53, the margin is for longer items
        bounds = (self.weights @ sketch[self.at].astype(np.float64)) * (1 + 1e-12)
        open_ = np.flatnonzero(bounds >= self.least)
        for d in open_[np.argsort(-bounds[open_], kind="stable")].tolist():
            if bounds[d] < self.least:
                break
            c, m = counts[d], norms[d]
            self.scored += 1
            score = sum(w * impact(c[t], m) for t, w in self.terms if t in c)
            if score >= self.least:
                insort(self.rows, (-score, ids[d] is not None, ids[d]))
                if len(self.rows) > self.k:
                    self.rows.pop()
                if len(self.rows) == self.k:
                    self.least = -self.rows[-1][0]


def _pieces(batches):
    for b in slices(batches, 1):
        for lo in range(0, b.num_rows, SLICE_ROWS):
            piece = b.slice(lo, SLICE_ROWS)
            yield piece.column(0).to_pylist(), [terms(t) for t in piece.column(1).to_pylist()]


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all terms with repeats, and the documents that
    hold each term of ``vocabulary``; ``docs`` is (id, text bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known, held, n_docs, n_terms = frozenset(shared.value), Counter(), 0, 0
        for _, texts in _pieces(batches):
            for words in texts:
                if words:
                    n_docs += 1
                    n_terms += len(words)
                    held.update(known.intersection(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b" docs", b" terms", *held], pa.binary()),
             pa.array([n_docs, n_terms, *held.values()], pa.int64())], names=["term", "n"])

    rows = docs.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {bytes(r.term): r.n for r in rows.collect()}  # at most the block's terms and two rows
    return found.pop(b" docs", 0), found.pop(b" terms", 0), found


def _search_block(docs: DataFrame, block: list[tuple], k: int, width: int, item_type) -> DataFrame:
    spark = docs.sparkSession
    wanted = [list(dict.fromkeys(terms(text))) for _, _, text in block]
    n_docs, n_terms, held = term_counts(docs, sorted({t for ts in wanted for t in ts}))
    kind = docs.schema["k"].dataType
    shared = spark.sparkContext.broadcast(
        [(q, item, ts, [weight(n_docs, held.get(t, 0)) for t in ts])
         for (q, item, _), ts in zip(block, wanted, strict=True)])
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("item", item_type),
                           T.StructField("k", kind), T.StructField("score", T.LongType())])
    arrow_item, arrow_id = _arrow(item_type), _arrow(kind)

    def search(batches):
        items = shared.value
        best = [Best(ts, ws, k, width) for _, _, ts, ws in items]
        for ids, texts in _pieces(batches):
            keep = [i for i, words in enumerate(texts) if words]
            if not keep:
                continue
            counts = [Counter(texts[i]) for i in keep]
            norms = [length_norm(len(texts[i]), n_docs, n_terms) for i in keep]
            sketch = sketches(counts, norms, width)
            ids = [ids[i] for i in keep]
            for b in best:
                b.take(ids, counts, norms, sketch)
        rows = [(q, item, key[2], -key[0]) for (q, item, _, _), b in zip(items, best, strict=True)
                for key in b.rows]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], arrow_item),
             pa.array(cols[2], arrow_id), pa.array(cols[3], pa.int64())],
            names=["q", "item", "k", "score"])

    return docs.mapInArrow(search, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("k").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col``, ``rank``, ``id_col`` and ``score`` of the ``k`` documents
    with the highest score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("k"),
                      F.col(text_col).cast("string").cast("binary").alias("raw"))
    wanted = items.select(F.col(item_col).alias("item"),
                          F.col(item_text).cast("string").cast("binary").alias("raw"))
    item_type = wanted.schema["item"].dataType
    found, block, size = [], [], 0

    def flush():
        if block:
            found.append(_search_block(src, list(block), k, width, item_type))
            block.clear()

    for q, r in enumerate(wanted.toLocalIterator()):
        if size + len(r.raw or b"") > block_bytes:
            flush()
            size = 0
        block.append((q, r.item, bytes(r.raw) if r.raw is not None else None))
        size += len(r.raw or b"") + 64
    flush()
    if not found:
        found.append(spark.createDataFrame([], T.StructType([
            T.StructField("q", T.LongType()), T.StructField("item", item_type),
            T.StructField("k", src.schema["k"].dataType), T.StructField("score", T.LongType())])))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    salt = F.pmod(F.xxhash64("k"), F.lit(MERGE_SALTS))
    rows = _top(rows.withColumn("salt", salt), ["q", "salt"], k).drop("rank")
    return _top(rows, ["q"], k).select(F.col("item").alias(item_col), "rank",
                                       F.col("k").alias(id_col), "score")


SQL_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@query("op13_max_sketch_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_TERMS} AS ts FROM documents),
words AS (SELECT r, unnest(ts) AS t FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM words GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // terms AS m FROM n, total),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({SQL_TERMS}) AS ts FROM benchmark),
qt AS (SELECT q, item_id, unnest(ts) AS t FROM q),
w AS (SELECT q, item_id, t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM qt JOIN df USING (t), total),
s AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM w JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM s WHERE score > 0)
WHERE rank <= 10
""")
def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
