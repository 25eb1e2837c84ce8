"""Quality rules: counts of a text and zstandard compression bands.

A text that is repetitive compresses too well, one that is random or packed
hardly at all.  The ratio (bytes over compressed bytes) of a whole text has
a lower and an upper limit for its length, since longer texts of the same
kind compress better; the text's full chunks of fixed size share one pair of
limits, and a text fails when half of them or more lie outside.  Texts of
fewer than ``SHORTEST`` bytes are too short for a verdict by ratio.

The work is row by row inside Spark's tasks: no shuffle, memory bounded by
one Arrow batch.  Defined results: NULL and empty texts have no words and
fail the base rule; every row is kept in ``assess``; repeated rows get equal
results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .registry import load, query

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio."""

    level: int = 3
    shortest: int = 256
    # (texts of up to so many bytes, lowest ratio, highest ratio)
    whole: tuple[tuple[float, float, float], ...] = (
        (512, 1.10, 1.95), (1024, 1.20, 2.10), (2048, 1.30, 2.25), (4096, 1.40, 2.40),
        (16384, 1.50, 2.60), (float("inf"), 1.60, 2.85))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.35, 2.20)
    chunk_share: float = 0.5


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:  # two windows at least
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(seen) + ids[1:-1]
    # pairs are numbered again, so that no product grows past 64 bits
    _, pairs = np.unique(pairs, return_inverse=True)
    _, window, times = np.unique(pairs * len(seen) + ids[2:], return_inverse=True,
                                 return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None, bands: Bands, compressor) -> tuple:
    """Counts and ratios of one text; ratios are None where it is too short."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: splits at the six ASCII white-space characters only
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    ratio = outside = None
    if len(raw) >= bands.shortest:
        ratio = len(raw) / len(compressor.compress(raw))
        size = bands.chunk_bytes
        full = range(0, len(raw) - size + 1, size)
        if full:
            low, high = bands.chunk
            bad = sum(not low <= size / len(compressor.compress(raw[i:i + size])) <= high
                      for i in full)
            outside = bad / len(full)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            sum(lines.values()) - len(lines), _repeat_words(words), len(raw), ratio, outside)


SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("raw_bytes", T.LongType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("chunks_outside", T.DoubleType())])


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           bands: Bands = Bands()) -> DataFrame:
    """``id_col``, the counts, ``ratio``, ``chunks_outside`` (share of full
    chunks outside their limits), ``base_failed``, ``banded`` (the ratios lie
    inside) and ``kept``."""
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("v"))

    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in slices(batches, 1):
            rows = [measure(t, bands, z) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
            arrays = [pa.array(c, pa.float64() if f.dataType == T.DoubleType() else pa.int64())
                      for c, f in zip(cols, SCHEMA, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["k", *SCHEMA.names])

    out = src.mapInArrow(run, T.StructType([T.StructField("k", src.schema["k"].dataType),
                                            *SCHEMA.fields]))
    return verdict(out, bands).withColumnRenamed("k", id_col)


def verdict(measured: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rules over ``measure``'s columns."""
    inside = F.lit(True)
    for upto, low, high in reversed(bands.whole):
        inside = F.when(F.col("raw_bytes") <= F.lit(upto),
                        F.col("ratio").between(low, high)).otherwise(inside)
    banded = (F.col("ratio").isNull()
              | (inside & (F.coalesce("chunks_outside", F.lit(0.0)) < bands.chunk_share)))
    base_failed = ((F.col("n_words") < 50)
                   | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return (measured.withColumn("base_failed", base_failed).withColumn("banded", banded)
            .withColumn("kept", ~base_failed & banded))


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns (names
    that equal the rules' own do not clash: columns go by position)."""
    fields = docs.schema.fields
    at = [f.name for f in fields].index(text_col)
    src = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    names = [f"c{i}" for i in range(len(fields))]
    types = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])

    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in slices(batches, at):
            rows = [measure(t, bands, z) for t in b.column(at).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
            arrays = [pa.array(c, pa.float64() if f.dataType == T.DoubleType() else pa.int64())
                      for c, f in zip(cols, SCHEMA, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*names, *SCHEMA.names])

    measured = src.mapInArrow(run, T.StructType([*types.fields, *SCHEMA.fields]))
    return verdict(measured, bands).filter("kept").select(*names).toDF(*[f.name for f in fields])


@query("op3_compression_bands")
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return assess(load(spark, sf_dir, "documents")).drop("banded")
