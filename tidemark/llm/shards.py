"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in one global order by a range partitioning; every partition
reports one total (bytes, rows); the running sums of these totals are the
partitions' offsets, and a running sum inside each partition adds the rest.
A row goes to the shard in whose equal share of the total its first byte
falls, so shards are contiguous in the order and differ by less than one row
in size.  Only ids, sizes and checksums move, never texts.

The order ends in the row's content and source partition, so ties and
repeated rows (one id on a third of all rows, say) still spread over the
range partitions.  Defined results: NULL text has no bytes; NULL ids come
first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

from .registry import load, query

ROW_OVERHEAD = 8


def global_prefix(df: DataFrame, order: list[str], size_col: str) -> DataFrame:
    """``df`` with ``before`` (sum of ``size_col`` over all earlier rows),
    ``row`` (number of earlier rows), ``total`` and ``partition``, in the
    global order of ``order``.

    The ordered rows are written once, so that the partition borders, which
    Spark finds by sampling, are the same for the totals and for the rows.
    """
    placed = cut_lineage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                         .withColumn("partition", F.spark_partition_id()))
    totals = placed.groupBy("partition").agg(F.sum(size_col).alias("bytes"),
                                             F.count(F.lit(1)).alias("rows"))
    # one row for each partition
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "partition", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("partition").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("before", F.coalesce(F.sum(size_col).over(upto), F.lit(0)))
            .withColumn("row", F.row_number().over(inside) - F.lit(1))
            .join(F.broadcast(offsets), "partition")
            .withColumn("before", F.col("before") + F.col("bytes_before"))
            .withColumn("row", F.col("row") + F.col("rows_before"))
            .drop("bytes_before", "rows_before"))


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (place in
    the shard, from 0) of every row."""
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    small = df.select(F.col(id_col).alias("k"),
                      (F.octet_length(raw) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                      F.crc32(raw).alias("text_crc32"),
                      F.spark_partition_id().alias("source"))
    rows = global_prefix(small, ["k", "text_crc32", "size", "source"], "size")
    share = F.floor(F.col("before") * F.lit(n_shards) / F.col("total")).cast("int")
    rows = cut_lineage(rows.withColumn("shard", F.least(share, F.lit(n_shards - 1))))
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return (rows.join(F.broadcast(firsts), "shard")
            .select(F.col("k").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("row") - F.col("first")).cast("long").alias("slot")))


@query("op8_prefix_sum_shards")
def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes."""
    out = shard(load(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))
