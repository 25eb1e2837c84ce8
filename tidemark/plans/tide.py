"""Sensor roll-ups and enrichment bound to the driver's tables.

Bindings (see FIXTURES.md part B): ``lineitem`` is a multi-year reading
table with station = (l_returnflag, l_linestatus), time = l_shipdate,
level = l_extendedprice; ``events`` is an intraday one with station =
event_type, time = ts, level = value.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import enrich
from tidemark.operators._util import round_doubles
from tidemark.plans.registry import register
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import io

STATION = ["l_returnflag", "l_linestatus"]


def distinct_years(df, ts_col):
    """Years present in the readings (bounded: one row per year)."""
    rows = df.select(F.year(ts_col).alias("y")).filter("y IS NOT NULL").distinct().collect()
    return sorted(int(r["y"]) for r in rows)


def _years_sql(prefix, measure, years):
    return ", ".join(
        f"round(avg({measure}) FILTER (WHERE year = {y}), 6) AS {prefix}{y}" for y in years)


_YEARS = list(range(1995, 2002))  # years present in the sf0.01 oracle tables

TIDE_PIVOT_SQL = f"""
WITH d AS (
  SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date,
         min(l_extendedprice) AS daily_min, max(l_extendedprice) AS daily_max
  FROM lineitem
  WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_shipdate IS NOT NULL
  GROUP BY 1, 2, 3),
y AS (
  SELECT l_returnflag, l_linestatus, CAST(year(date) AS BIGINT) AS year,
         avg(daily_min) AS avg_low_tide, avg(daily_max) AS avg_high_tide
  FROM d GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus,
  {_years_sql('AvgHighTide', 'avg_high_tide', _YEARS)},
  {_years_sql('AvgLowTide', 'avg_low_tide', _YEARS)}
FROM y GROUP BY 1, 2
"""


@register("tide_yearly_pivot", TIDE_PIVOT_SQL)
def tide_yearly_pivot(spark, sf_dir):
    """Flagship: A1 -> A2 -> A4 on the multi-year readings."""
    li = io.load_table(spark, sf_dir, "lineitem")
    years = distinct_years(li, "l_shipdate")
    out = enrich.tide_yearly_summary(li, STATION, "l_shipdate", "l_extendedprice",
                                     years=years)
    return round_doubles(out)


@register("tide_daily_extremes", """
SELECT event_type, CAST(ts AS DATE) AS date, min(value) AS daily_min,
       max(value) AS daily_max, CAST(year(CAST(ts AS DATE)) AS BIGINT) AS year
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2
""")
def tide_daily_extremes(spark, sf_dir):
    """A1 + P8 on the intraday readings."""
    ev = io.load_table(spark, sf_dir, "events")
    return enrich.daily_extremes(ev, ["event_type"], "ts", "value")


@register("tide_daily_year_join", """
WITH d AS (
  SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date,
         min(l_extendedprice) AS daily_min, max(l_extendedprice) AS daily_max
  FROM lineitem
  WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_shipdate IS NOT NULL
  GROUP BY 1, 2, 3),
dy AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date,
              CAST(year(l_shipdate) AS BIGINT) AS year
       FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT d.date, l_returnflag, l_linestatus, daily_min, daily_max, dy.year
FROM d LEFT JOIN dy ON d.date = dy.date
""")
def tide_daily_year_join(spark, sf_dir):
    """Daily extremes LEFT JOIN distinct (date, year)."""
    li = io.load_table(spark, sf_dir, "lineitem")
    daily = enrich.daily_extremes(li, STATION, "l_shipdate", "l_extendedprice")
    return enrich.attach_year_by_join(daily, li, "l_shipdate")


@register("tide_yearly_means", """
WITH d AS (
  SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date,
         min(l_extendedprice) AS daily_min, max(l_extendedprice) AS daily_max
  FROM lineitem
  WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_shipdate IS NOT NULL
  GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, CAST(year(date) AS BIGINT) AS year,
       round(avg(daily_min), 6) AS avg_low_tide, round(avg(daily_max), 6) AS avg_high_tide
FROM d GROUP BY 1, 2, 3
""")
def tide_yearly_means(spark, sf_dir):
    """A2: yearly mean of daily extremes (long form)."""
    li = io.load_table(spark, sf_dir, "lineitem")
    daily = enrich.daily_extremes(li, STATION, "l_shipdate", "l_extendedprice")
    return round_doubles(enrich.yearly_mean_extremes(daily, STATION))


@register("wave_yearly_mean", """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag, l_linestatus,
       round(avg(l_quantity), 6) AS WaveFrequency
FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_shipdate IS NOT NULL
GROUP BY 1, 2, 3
""")
def wave_yearly_mean(spark, sf_dir):
    """A3: yearly mean of one wave measure per location key."""
    li = io.load_table(spark, sf_dir, "lineitem")
    return round_doubles(enrich.yearly_mean(li, STATION, "l_shipdate", "l_quantity",
                                            "WaveFrequency"))


def _wave_pivot_sql():
    def one(measure, prefix):
        cols = ", ".join(f"avg(v) FILTER (WHERE year = {y}) AS {prefix}{y}" for y in _YEARS)
        return (f"(SELECT l_returnflag, l_linestatus, {cols} FROM ("
                f"SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, avg({measure}) AS v "
                f"FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL "
                f"AND l_shipdate IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)")
    f_cols = ", ".join(f"round(f.WaveFrequency{y}, 6) AS WaveFrequency{y}" for y in _YEARS)
    h_cols = ", ".join(f"round(h.SigWaveHeight{y}, 6) AS SigWaveHeight{y}" for y in _YEARS)
    return (f"SELECT coalesce(f.l_returnflag, h.l_returnflag) AS l_returnflag, "
            f"coalesce(f.l_linestatus, h.l_linestatus) AS l_linestatus, {f_cols}, {h_cols} "
            f"FROM {one('l_quantity', 'WaveFrequency')} f FULL OUTER JOIN "
            f"{one('l_discount', 'SigWaveHeight')} h "
            f"ON f.l_returnflag IS NOT DISTINCT FROM h.l_returnflag "
            f"AND f.l_linestatus IS NOT DISTINCT FROM h.l_linestatus")


@register("wave_pivot_full_join", _wave_pivot_sql())
def wave_pivot_full_join(spark, sf_dir):
    """A3 + A4 per measure, then J2: full outer join of the two pivots."""
    li = io.load_table(spark, sf_dir, "lineitem")
    years = distinct_years(li, "l_shipdate")
    freq = enrich.pivot_years(enrich.yearly_mean(li, STATION, "l_shipdate", "l_quantity", "v"),
                              STATION, {"v": "WaveFrequency"}, years=years)
    height = enrich.pivot_years(enrich.yearly_mean(li, STATION, "l_shipdate", "l_discount", "v"),
                                STATION, {"v": "SigWaveHeight"}, years=years)
    return round_doubles(enrich.full_outer_on(freq, height, STATION))


@register("lineitem_column_means", """
SELECT round(avg(l_orderkey), 6) AS l_orderkey, round(avg(l_partkey), 6) AS l_partkey,
       round(avg(l_suppkey), 6) AS l_suppkey, round(avg(l_linenumber), 6) AS l_linenumber,
       round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
FROM lineitem
""")
def lineitem_column_means(spark, sf_dir):
    """A5: one row of column means over every numeric column."""
    return round_doubles(enrich.column_means(io.load_table(spark, sf_dir, "lineitem")))


@register("customer_with_wave_means", """
SELECT c.c_custkey, c.c_acctbal, round(m.l_quantity, 6) AS l_quantity,
       round(m.l_discount, 6) AS l_discount
FROM customer c CROSS JOIN (SELECT avg(l_quantity) AS l_quantity,
                                   avg(l_discount) AS l_discount FROM lineitem) m
""")
def customer_with_wave_means(spark, sf_dir):
    """The mean row of a forcing table put on every point."""
    cust = io.load_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    forcing = io.load_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    return round_doubles(enrich.broadcast_row(cust, forcing))


NEAREST_SQL = """
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
                  label FROM embeddings),
s AS (SELECT CAST(label AS BIGINT) AS site_id, avg(x) AS sx, avg(y) AS sy,
             count(*) AS site_size
      FROM p WHERE label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
c AS (SELECT p.vec_id, s.site_id, s.site_size,
             sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM p CROSS JOIN s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, site_id) AS rn FROM c)
SELECT vec_id, site_id AS nearest_site_id, site_size, round(d, 6) AS nearest_dist
FROM r WHERE rn = 1
"""


def _points_and_stations(spark, sf_dir):
    """Points: dims 1-2 of every vector.  Stations: one per label, at the
    label's centroid, carrying its point count (derived from the table)."""
    emb = io.load_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("label"))
    sites = (emb.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy(F.col("label").alias("site_id"))
             .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("site_size")))
    return emb.select("vec_id", "x", "y"), sites


@register("nearest_station", NEAREST_SQL)
def nearest_station(spark, sf_dir):
    """Each point takes the values of its nearest station (inline path)."""
    pts, sites = _points_and_stations(spark, sf_dir)
    out = enrich.nearest_join(pts, sites, ["x", "y"], ["x", "y"], "site_id", ["site_size"])
    return round_doubles(out.select("vec_id", "nearest_site_id", "site_size", "nearest_dist"))


@register("nearest_station_grid", NEAREST_SQL)
def nearest_station_grid(spark, sf_dir):
    """J3 through the exact grid path (what large station sets take)."""
    pts, sites = _points_and_stations(spark, sf_dir)
    out = enrich.nearest_join(pts, sites, ["x", "y"], ["x", "y"], "site_id", ["site_size"],
                              max_broadcast=0, cell=0.01)
    return round_doubles(out.select("vec_id", "nearest_site_id", "site_size", "nearest_dist"))


@register("nearest_station_3", NEAREST_SQL.replace(
    "round(d, 6) AS nearest_dist", "round(d, 6) AS nearest_dist, CAST(rn AS INTEGER) AS rank").replace(
    "WHERE rn = 1", "WHERE rn <= 3"))
def nearest_station_3(spark, sf_dir):
    """J3 with k = 3: a row for each of the three nearest stations."""
    pts, sites = _points_and_stations(spark, sf_dir)
    out = enrich.nearest_join(pts, sites, ["x", "y"], ["x", "y"], "site_id", ["site_size"], k=3)
    return round_doubles(out.select("vec_id", "nearest_site_id", "site_size", "nearest_dist", "rank"))


SENSOR_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


@register("sensor_csv_roundtrip", """
SELECT event_type, CAST(ts AS DATE) AS date, min(value) AS daily_min,
       max(value) AS daily_max, CAST(year(CAST(ts AS DATE)) AS BIGINT) AS year
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2
""")
def sensor_csv_roundtrip(spark, sf_dir):
    """S4 -> S2 -> S3 -> A1: readings written as two CSV sources with a units
    line, their columns in another order in the second one, read back by name
    (units row dropped by content), unioned, rolled up."""
    import uuid
    ev = io.load_table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        "event_type", F.col("value").cast("string").alias("value"))
    units = spark.createDataFrame([("", "UTC", "", "metres")], ev.schema)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-io/{uuid.uuid4().hex}"
    paths = []
    # the readings split over two sources, each with the units line
    first = F.coalesce(F.xxhash64("event_id") >= 0, F.lit(False))
    for part, rows, order in (("a", ev.filter(first), ev.columns),
                              ("b", ev.filter(~first), ev.columns[::-1])):
        path = f"{base}/{part}"
        io.write_table(rows.unionByName(units).select(*order), path, fmt="csv")
        paths.append(path)
    srcs = [io.read_sensor(spark, p, SENSOR_SCHEMA, time_col="ts") for p in paths]
    readings = io.union_sources(srcs)
    return enrich.daily_extremes(readings, ["event_type"], "ts", "value")


@register("sensor_stream_daily_extremes", """
SELECT event_type, CAST(ts AS DATE) AS date, min(value) AS daily_min,
       max(value) AS daily_max, CAST(year(CAST(ts AS DATE)) AS BIGINT) AS year
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2
""")
def sensor_stream_daily_extremes(spark, sf_dir):
    """A1 as a Structured Streaming job over the readings file(s): state per
    (station, day) under a watermark, updated days merged into a
    date-partitioned table, which is read back."""
    from tidemark.streaming import daily_extremes_stream, run_to_table
    from tidemark.streaming.sensor import new_stream_folder
    base = new_stream_folder(ensure_checkpoint_dir(spark))
    schema = io.load_table(spark, sf_dir, "events").schema
    s = daily_extremes_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet", schema,
                              ["event_type"], "ts", "value")
    run_to_table(s, f"{base}/table", f"{base}/state", ["event_type"])
    return spark.read.parquet(f"{base}/table").select(
        "event_type", "date", "daily_min", "daily_max", "year")


@register("customer_csv_by_name", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def customer_csv_by_name(spark, sf_dir):
    """S4 -> S1: a table written as CSV with its columns reversed and one more,
    read back by the names in the header."""
    import uuid
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    c = io.load_table(spark, sf_dir, "customer").select(*names)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-io/{uuid.uuid4().hex}"
    io.write_table(c.withColumn("c_extra", F.lit("x")).select("c_extra", *names[::-1]), path,
                   fmt="csv")
    return io.read_table(spark, path, c.schema, fmt="csv")
