"""Small helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side (rows) any operator broadcasts after counting it.  Above it
# the operator takes its shuffle-based path instead.
MAX_BROADCAST_ROWS = 200_000


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows``, else ``None``.

    Reads at most ``max_rows + 1`` rows (a limit job), so the check itself
    stays cheap even when the side turns out to be large.
    """
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """The numeric columns of ``df`` in schema order."""
    ex = {c.lower() for c in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name.lower() not in ex]


def and_all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (used only where results are compared)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# Rows of a round's table that one task may write.
ROWS_OF_TASK = 20_000


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` small rows, in tasks of a fair size
    where shuffles leave more; two at least."""
    return df.coalesce(1 + max(1, -(-rows // ROWS_OF_TASK)))


# Rows of one key that a join may bring into one task.
ROWS_OF_KEY = 1_000_000


class Spread:
    """Joins on a key of which one value may hold most rows.

    Values with more than ``rows`` rows of ``df`` are counted (at most
    ``len(df) / rows`` of them, so their list is small beside the table) and
    dealt over as many salts as they have multiples of ``rows``; all other
    values have one.  With ``total`` (rows of ``df``, where known) of ``rows``
    or less there is none to count.
    """

    def __init__(self, df: DataFrame, key: str, rows: int = ROWS_OF_KEY, total: int | None = None):
        self.key, self.heavy = key, None
        if total is None or total > rows:
            self.heavy = (df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
                          .select(key, F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias("__salts")))

    def _salts(self, df: DataFrame) -> DataFrame:
        return df.join(self.heavy, self.key, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))

    def join(self, big: DataFrame, small: DataFrame, by: str, on: Sequence[str] = (),
             how: str = "inner") -> DataFrame:
        """``big`` joined with ``small`` on the key (and ``on``); the rows of a
        heavy value are dealt by the column ``by`` of ``big``."""
        if self.heavy is None:
            return big.join(small, [self.key, *on], how)
        big = self._salts(big).withColumn("__salt", F.pmod(F.xxhash64(by), F.col("__salts"))).drop("__salts")
        small = self._salts(small).withColumn(
            "__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
        return big.join(small, [self.key, "__salt", *on], how).drop("__salt")


def sum_of_parts(parts, add, wide: int = 16):
    """Sum of the elements of an RDD (one or few a partition, all of one size),
    in the order of its partitions.

    Tasks add up the elements of ``wide`` partitions at a time until one is
    left, so that the driver is sent a single element, whatever the number of
    partitions.
    """
    def run(values):
        total = None
        for v in values:
            total = v if total is None else add(total, v)
        if total is not None:
            yield total

    def in_order(pairs):
        return run(v for _, v in sorted(pairs, key=lambda p: p[0]))

    parts = parts.mapPartitions(run)
    while (n := parts.getNumPartitions()) > 1:
        parts = (parts.mapPartitionsWithIndex(lambda i, vs: ((i // wide, (i, v)) for v in vs))
                 .partitionBy(-(-n // wide), int).values().mapPartitions(in_order))
    return parts.reduce(add)
