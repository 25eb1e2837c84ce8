"""Sources, joins and feature preparation not covered by the other plans
(S5, S6, J5, J6, M1, M2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import clean, models
from tidemark.operators._util import round_doubles
from tidemark.plans.panel import CLUSTER_NAMES, PANEL_CTE, orders_panel
from tidemark.plans.registry import register
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import io


@register("vector_cache_roundtrip", """
SELECT vec_id AS id, len(embedding) AS dims,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vec_sum
FROM embeddings WHERE embedding IS NOT NULL
""")
def vector_cache_roundtrip(spark, sf_dir):
    """The feature-matrix cache written as parquet (id, array<double>)
    into the shared folder and read back."""
    emb = io.load_table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-vectors/{uuid.uuid4().hex}"
    io.write_vectors(emb.withColumnRenamed("vec_id", "id"), path, "id", "embedding")
    v = io.read_vectors(spark, path)
    return round_doubles(v.select(
        "id", F.size("embedding").cast("long").alias("dims"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("vec_sum")))


@register("orders_preview", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10
""")
def orders_preview(spark, sf_dir):
    """First ten rows in an explicit order."""
    o = io.load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return io.preview(o, 10, ["o_orderkey"])


@register("panel_train_rows", f"""
WITH {PANEL_CTE}
SELECT o_custkey FROM panel WHERE NOT (md5(CAST(o_custkey AS VARCHAR) || '-42') < '33333333')
""")
def panel_train_rows(spark, sf_dir):
    """Training rows = all points minus the test ids (anti join on id)."""
    p = models.split(orders_panel(spark, sf_dir), "o_custkey", 0.2, 42)
    test_ids = p.filter("is_test").select("o_custkey")
    return p.select("o_custkey").join(test_ids, "o_custkey", "left_anti")


@register("panel_with_cluster", f"""
WITH {PANEL_CTE}
SELECT p.o_custkey, CAST(c.c_nationkey AS INTEGER) AS Cluster,
  CASE CAST(c.c_nationkey AS INTEGER) WHEN 0 THEN 'Water' WHEN 1 THEN 'Land - Limestone'
    WHEN 2 THEN 'Water 2' WHEN 3 THEN 'Land 2' WHEN 4 THEN 'Water 3'
    WHEN 5 THEN 'Water - Tidal' WHEN 6 THEN 'Tide Vary' END AS ClusterName,
  round(p.NDVI_2001H, 6) AS NDVI_2001H
FROM panel p JOIN customer c ON p.o_custkey = c.c_custkey
""")
def panel_with_cluster(spark, sf_dir):
    """J6 + P7: the label table joined to the panel on the point id, code
    mapped to its name (the label table here: customer nation codes)."""
    lab = io.load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("Cluster"))
    p = orders_panel(spark, sf_dir).select("o_custkey", "NDVI_2001H").join(lab, "o_custkey")
    p = clean.map_labels(p, "Cluster", CLUSTER_NAMES, "ClusterName")
    return round_doubles(p)


@register("customer_standardise", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd,
                  avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer)
SELECT c_custkey,
       round(CASE WHEN sd > 0 THEN (c_acctbal - m) / sd WHEN c_acctbal IS NOT NULL THEN 0 END, 6)
         AS c_acctbal,
       round(CASE WHEN sn > 0 THEN (c_nationkey - mn) / sn WHEN c_nationkey IS NOT NULL THEN 0 END, 6)
         AS c_nationkey
FROM customer CROSS JOIN s
""")
def customer_standardise(spark, sf_dir):
    """M1: z-scores with the population std over all rows."""
    c = io.load_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return round_doubles(models.standardise(c, ["c_acctbal", "c_nationkey"]))


def _one_hot_sql():
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cols = ", ".join(
        f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}"
        for s in segs[1:])
    return f"SELECT c_custkey, {cols} FROM customer"


@register("customer_one_hot", _one_hot_sql())
def customer_one_hot(spark, sf_dir):
    """M2: dummies of the sorted categories, first dropped, NULL -> zeros."""
    c = io.load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return models.one_hot(c, "c_mktsegment", drop_first=True)
