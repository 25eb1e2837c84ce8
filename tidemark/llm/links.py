"""Components of a link table, and joins that stand a hot key."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage_path, drop_table

SALTS = 16


@contextmanager
def shuffles_end_with_jobs(spark):
    """Inside, a job's shuffle files go when the job has ended, instead of when
    the driver collects its garbage.  For jobs that write their results."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables in the shared folder that a job needs only while it runs."""

    def __init__(self, spark):
        self.spark, self.tables = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        df, path = cut_lineage_path(df)
        self.tables.append((df, path))
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``write`` that nothing reads any more."""
        for table, path in self.tables:
            if table is df:
                drop_table(self.spark, path)
        self.tables = [x for x in self.tables if x[0] is not df]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for _, path in self.tables:
            drop_table(self.spark, path)
        self.tables.clear()


def salted_left_join(big: DataFrame, small: DataFrame, key: str, by: str,
                     merge: bool = True) -> DataFrame:
    """``big`` left join ``small`` on ``key``; ``small`` holds a key once.

    One key may stand on a large part of ``big``: its rows are dealt over
    ``SALTS`` tasks by the column ``by``, and ``small`` is repeated as often.
    With ``merge`` it is never broadcast, whatever its estimated size;
    without, Spark's own size check decides.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = many.hint("merge") if merge else many
    return big.withColumn("_salt", salt).join(many, [key, "_salt"], "left").drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` (smallest id reachable) of every linked id.

    Alternating large-star and small-star rounds; in each, neighbours are
    joined to their smallest one.  A hub's neighbour list is only ever
    reduced to a minimum (combined before the shuffle) and joined row by
    row, never gathered.  Rounds are tables in the shared folder; they end
    when a round changes nothing.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    edges, path = cut_lineage_path(edges.distinct())

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    last = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large, large_path = cut_lineage_path(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        small, small_path = cut_lineage_path(small)
        drop_table(spark, path)
        drop_table(spark, large_path)
        edges, path = small, small_path
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            .unionByName(roots.select("id", F.col("id").alias("root"))))
