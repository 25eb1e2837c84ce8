"""Point-panel operators bound to ``orders``.

The panel: point = o_custkey; for every year of o_orderdate and half-year
(Jan-Jun = L, Jul-Dec = H) the mean o_totalprice, as ``NDVI_{year}{H|L}``.
Cells are naturally NULL where a customer has no order in that half-year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, enrich, features, reshape
from tidemark.operators._util import round_doubles
from tidemark.plans.registry import register
from tidemark.sources import io

YEARS = list(range(1995, 2002))
TIDES = ["H", "L"]
LABELS = [f"{y}{t}" for y in YEARS for t in TIDES]
NDVI = [f"NDVI_{x}" for x in LABELS]
FIRST, LAST = ["NDVI_1996H", "NDVI_1996L"], ["NDVI_2001H", "NDVI_2001L"]


def orders_panel(spark, sf_dir):
    o = io.load_table(spark, sf_dir, "orders")
    r = o.select("o_custkey",
                 F.concat(F.year("o_orderdate").cast("string"),
                          F.when(F.month("o_orderdate") <= 6, "L").otherwise("H")).alias("yt"),
                 "o_totalprice").filter(F.col("o_custkey").isNotNull() & F.col("yt").isNotNull())
    return enrich.pivot_wide(r, ["o_custkey"], "yt", LABELS, "o_totalprice", "NDVI_")


_PANEL_COLS = ",\n  ".join(
    f"avg(v) FILTER (WHERE y = {y} AND t = '{t}') AS NDVI_{y}{t}" for y in YEARS for t in TIDES)
PANEL_CTE = f"""
o AS (SELECT o_custkey, year(o_orderdate) AS y,
             CASE WHEN month(o_orderdate) <= 6 THEN 'L' ELSE 'H' END AS t, o_totalprice AS v
      FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
panel AS (SELECT o_custkey,
  {_PANEL_COLS}
  FROM o GROUP BY 1)"""


def _r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _mean_sql(cols):
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    return f"(CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) END)"


CHANGE_SQL = f"({_mean_sql(LAST)} - {_mean_sql(FIRST)})"


def _long_sql(table):
    """Wide -> long in plain SQL (NULL cells kept)."""
    return " UNION ALL ".join(
        f"SELECT o_custkey, CAST({y} AS BIGINT) AS year, '{t}' AS tide, NDVI_{y}{t} AS value "
        f"FROM {table}" for y in YEARS for t in TIDES)


@register("panel_build", f"WITH {PANEL_CTE} SELECT o_custkey, {_r(NDVI)} FROM panel")
def panel_build(spark, sf_dir):
    """A4: the wide point panel (year x tide pivot)."""
    return round_doubles(orders_panel(spark, sf_dir))


@register("erosion_points", f"""
WITH {PANEL_CTE}
SELECT o_custkey, round({CHANGE_SQL}, 6) AS change FROM panel WHERE {CHANGE_SQL} < -0.3
""")
def erosion_points(spark, sf_dir):
    """P5 + P6: change of the two-tide mean between the first and last year,
    points strictly below -0.3."""
    p = clean.detect_erosion(orders_panel(spark, sf_dir), FIRST, LAST, -0.3)
    return round_doubles(p.select("o_custkey", "change"))


@register("panel_impute_mean", f"""
WITH {PANEL_CTE}
SELECT o_custkey, {", ".join(f"round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}" for c in NDVI)}
FROM panel
""")
def panel_impute_mean(spark, sf_dir):
    """NULL cells -> column mean over all points."""
    return round_doubles(clean.impute_mean(orders_panel(spark, sf_dir), NDVI))


# three whole years: few points of the test tables have more of them complete
_COMPLETE = [c for c in NDVI if 1996 <= int(c[5:9]) <= 1998]


@register("panel_drop_null_rows", f"""
WITH {PANEL_CTE}
SELECT o_custkey, {_r(_COMPLETE)} FROM panel
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _COMPLETE)}
""")
def panel_drop_null_rows(spark, sf_dir):
    """Points observed in every listed half-year."""
    p = orders_panel(spark, sf_dir).select("o_custkey", *_COMPLETE)
    return round_doubles(clean.drop_null_rows(p, _COMPLETE))


@register("panel_fill_constant", f"""
WITH {PANEL_CTE}
SELECT p.o_custkey, {", ".join(f"round(coalesce({c}, 0.0), 6) AS {c}" for c in NDVI)},
       CASE WHEN c.c_mktsegment IS NULL OR c.c_mktsegment = '' THEN 'WATER'
            ELSE c.c_mktsegment END AS STRATCODE
FROM panel p LEFT JOIN customer c ON p.o_custkey = c.c_custkey
""")
def panel_fill_constant(spark, sf_dir):
    """NULL cells -> 0 (as NULL sediment code -> water) and NULL / empty
    category -> 'WATER'."""
    cust = io.load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("STRATCODE"))
    p = orders_panel(spark, sf_dir).join(cust, "o_custkey", "left")
    p = clean.blank_to(clean.fill_constant(p, {c: 0.0 for c in NDVI}), "STRATCODE", "WATER")
    return round_doubles(p)


@register("lineitem_numeric_features", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
""")
def lineitem_numeric_features(spark, sf_dir):
    """Drop id columns, keep the numeric ones."""
    li = io.load_table(spark, sf_dir, "lineitem")
    li = clean.drop_columns(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return clean.keep_numeric(li)


# Label code -> name, as the reference names its seven
# clusters (codes 7-9 of the test labels stay unmapped -> NULL).
CLUSTER_NAMES = {
    0: "Water",
    1: "Land - Limestone",
    2: "Water 2",
    3: "Land 2",
    4: "Water 3",
    5: "Water - Tidal",
    6: "Tide Vary",
}


@register("cluster_names", """
SELECT vec_id, CAST(label AS INTEGER) AS label,
  CASE CAST(label AS INTEGER) WHEN 0 THEN 'Water' WHEN 1 THEN 'Land - Limestone'
    WHEN 2 THEN 'Water 2' WHEN 3 THEN 'Land 2' WHEN 4 THEN 'Water 3'
    WHEN 5 THEN 'Water - Tidal' WHEN 6 THEN 'Tide Vary' END AS ClusterName
FROM embeddings
""")
def cluster_names(spark, sf_dir):
    """Cluster code -> name (unmapped -> NULL)."""
    e = io.load_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int"))
    return clean.map_labels(e, "label", CLUSTER_NAMES, "ClusterName")


@register("panel_slice", f"""
WITH {PANEL_CTE}
SELECT o_custkey, {_r(NDVI)} FROM panel ORDER BY o_custkey LIMIT 50 OFFSET 60
""")
def panel_slice(spark, sf_dir):
    """Rows [60:110] by point id."""
    return round_doubles(clean.slice_rows(orders_panel(spark, sf_dir), ["o_custkey"], 60, 50))


@register("first_line_per_order", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem))
WHERE rn = 1
""")
def first_line_per_order(spark, sf_dir):
    """First row per key in an explicit order."""
    li = io.load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return clean.distinct_on(li, ["l_orderkey"], ["l_linenumber", "l_partkey"])


@register("every_50th_customer", """
SELECT c_custkey, c_nationkey FROM (
  SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS pos
  FROM customer) WHERE pos % 50 = 0
""")
def every_50th_customer(spark, sf_dir):
    """Every 50th row of an ordered table (distributed global rank)."""
    c = io.load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return clean.every_nth(c, 50, ["c_nationkey", "c_custkey"])


@register("events_sample_fraction", """
SELECT event_id, value FROM events WHERE md5(CAST(event_id AS VARCHAR) || '-42') < '33333333'
""")
def events_sample_fraction(spark, sf_dir):
    """20 % sample, seed 42, stable per id."""
    ev = io.load_table(spark, sf_dir, "events").select("event_id", "value")
    return clean.sample_fraction(ev, "event_id", 0.2, 42)


@register("orders_sample_n", """
SELECT o_orderkey, o_custkey FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 500
""")
def orders_sample_n(spark, sf_dir):
    """Uniform sample of 500 rows without replacement (md5 order)."""
    o = io.load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return clean.sample_n(o, "o_orderkey", 500, 42)


@register("erosion_panel_rows", f"""
WITH {PANEL_CTE}
SELECT o_custkey, {_r(NDVI)} FROM panel WHERE {CHANGE_SQL} < -0.3
""")
def erosion_panel_rows(spark, sf_dir):
    """Panel rows of the erosion points (semi join on the id table)."""
    panel = orders_panel(spark, sf_dir)
    ids = clean.detect_erosion(panel, FIRST, LAST).select("o_custkey")
    return round_doubles(clean.points_by_id(panel, "o_custkey", ids))


@register("panel_series", f"""
WITH {PANEL_CTE}
SELECT o_custkey, year, tide, round(value, 6) AS value FROM ({_long_sql("panel")})
""")
def panel_series(spark, sf_dir):
    """Wide panel -> (id, year, tide, value), NULL cells kept."""
    return round_doubles(reshape.to_series(orders_panel(spark, sf_dir), ["o_custkey"],
                                           YEARS, TIDES))


@register("erosion_trend", f"""
WITH {PANEL_CTE},
e AS (SELECT * FROM panel WHERE {CHANGE_SQL} < -0.3),
s AS ({_long_sql("e")})
SELECT o_custkey, year, round(avg(value), 6) AS mean_value FROM s GROUP BY 1, 2
""")
def erosion_trend(spark, sf_dir):
    """Yearly two-tide mean of the erosion points."""
    panel = orders_panel(spark, sf_dir)
    ids = clean.detect_erosion(panel, FIRST, LAST).select("o_custkey")
    return round_doubles(reshape.yearly_trend(panel, "o_custkey", YEARS, TIDES, ids=ids))


@register("heat_matrix", f"""
WITH {PANEL_CTE}
SELECT o_custkey, {", ".join(f"round(NDVI_{y}L, 6) AS y{y}" for y in YEARS)}
FROM panel ORDER BY o_custkey LIMIT 50 OFFSET 60
""")
def heat_matrix(spark, sf_dir):
    """Points [60:110] x years of the low tide."""
    return round_doubles(reshape.heat_matrix(orders_panel(spark, sf_dir), "o_custkey",
                                             ["o_custkey"], 60, 50, YEARS, "L"))


@register("customer_impute_integer", """
WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer)
SELECT c_custkey, round(coalesce(CAST(c_nationkey AS DOUBLE), avg(c_nationkey) OVER ()), 6)
       AS c_nationkey FROM c
""")
def customer_impute_integer(spark, sf_dir):
    """P3 on a whole-number column: its mean is no whole number."""
    c = io.load_table(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"))
    return round_doubles(clean.impute_mean(c, ["c_nationkey"]))


# the panel's years moved so that its last one is the scripts' target year
_MOVED = {c: f"NDVI_{int(c[5:9]) + 23}{c[9]}" for c in NDVI}
_INDEX = list(_MOVED.values())
_NO_TARGET = [c for c in _INDEX if c not in ("NDVI_2024H", "NDVI_2024L")]
_EXPECTED = {
    "base": ["Longitude", *_NO_TARGET],
    "no_sediment_class": ["Longitude", "FID", *_NO_TARGET],
    "all_wave_no_sediment": ["Longitude", *_NO_TARGET],
    "all_wave_with_code": ["Longitude", "FID", *_NO_TARGET],
    "basic_wave_with_code": ["Longitude", "FID", *_NO_TARGET],
    "basic_wave_with_class": ["Longitude", "FID", *_NO_TARGET],
    "all_wave_with_class": [f"NDVI_{y}{t}" for t in "HL" for y in range(2018, 2024)],
}


@register("variant_columns", f"""
WITH {PANEL_CTE},
w AS (SELECT o_custkey AS OBJECTID, o_custkey / 10.0 AS Longitude, nullif(o_custkey % 5, 0) AS FID,
      {", ".join(f"{a} AS {b}" for a, b in _MOVED.items())} FROM panel)
{" UNION ALL ".join(
    f"SELECT '{v}' AS variant, CAST({i} AS INTEGER) AS place, '{c}' AS name, count({c}) AS n FROM w"
    for v, cols in _EXPECTED.items() for i, c in enumerate(cols))}
""")
def variant_columns(spark, sf_dir):
    """The columns of every model variant, with their known values."""
    p = orders_panel(spark, sf_dir).withColumnsRenamed(_MOVED)
    w = p.select(F.col("o_custkey").alias("OBJECTID"),
                 (F.col("o_custkey") / 10.0).alias("Longitude"),
                 F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("FID"),
                 F.lit("clay").alias("STRATCODE"), *_INDEX)
    chosen = [(v, i, c) for v in features.VARIANTS for i, c in enumerate(
        features.feature_set(w, v, ["NDVI_2024H", "NDVI_2024L"])[0])]
    counts = w.agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for _, _, c in chosen)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(i).alias("place"), F.lit(c).alias("name"),
                 F.col(c).alias("n")) for v, i, c in chosen])))
