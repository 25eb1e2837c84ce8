"""Sensor roll-ups and point enrichment.

Roll-ups are plain ``groupBy().agg()`` so Spark runs a partial (map-side)
aggregate before the shuffle: a station holding a third of all readings
costs one partial row per task, not a hot reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators._util import and_all, bounded_rows
from tidemark.session import cut_lineage


def with_calendar(df: DataFrame, ts_col: str, date_col: str = "date",
                  year_col: str = "year") -> DataFrame:
    """Calendar day and year of a timestamp (session time zone, UTC)."""
    ts = F.col(ts_col)
    return df.withColumns({date_col: F.to_date(ts),
                           year_col: F.year(ts).cast("long")})


def daily_extremes(df: DataFrame, keys: Sequence[str], ts_col: str,
                   value_col: str, date_col: str = "date") -> DataFrame:
    """A1: min and max reading per station key and calendar day.

    Rows with a NULL key (station or day) form no group, as in a pandas
    ``groupby``.  The year is derived from the day (the reference's extra
    join to a (date, year) table is a function of the day, J1).
    """
    d = df.withColumn(date_col, F.to_date(F.col(ts_col)))
    d = d.filter(and_all([F.col(k).isNotNull() for k in [*keys, date_col]]))
    return (d.groupBy(*keys, date_col)
            .agg(F.min(value_col).alias("daily_min"),
                 F.max(value_col).alias("daily_max"))
            .withColumn("year", F.year(F.col(date_col)).cast("long")))


def attach_year_by_join(daily: DataFrame, readings: DataFrame, ts_col: str,
                        date_col: str = "date") -> DataFrame:
    """J1 as the reference writes it: daily rows LEFT JOIN distinct
    (date, year) of the readings.  Kept for parity; ``daily_extremes``
    computes the same column without the join."""
    dy = (readings.select(F.to_date(F.col(ts_col)).alias(date_col),
                          F.year(F.col(ts_col)).cast("long").alias("year"))
          .filter(F.col(date_col).isNotNull()).distinct())
    return daily.drop("year").join(dy, on=date_col, how="left")


def yearly_mean_extremes(daily: DataFrame, keys: Sequence[str],
                         year_col: str = "year") -> DataFrame:
    """A2: mean of the daily minima / maxima per station and year."""
    return (daily.groupBy(*keys, year_col)
            .agg(F.avg("daily_min").alias("avg_low_tide"),
                 F.avg("daily_max").alias("avg_high_tide")))


def yearly_mean(df: DataFrame, keys: Sequence[str], ts_col: str,
                value_col: str, out_col: str | None = None) -> DataFrame:
    """A3: mean reading per (year, key...)."""
    d = df.withColumn("year", F.year(F.col(ts_col)).cast("long"))
    d = d.filter(and_all([F.col(k).isNotNull() for k in [*keys, "year"]]))
    return d.groupBy("year", *keys).agg(F.avg(value_col).alias(out_col or value_col))


def year_range(df: DataFrame, year_col: str = "year") -> list[int]:
    """The years between the smallest and largest present (one tiny agg)."""
    r = df.agg(F.min(year_col).alias("lo"), F.max(year_col).alias("hi")).first()
    if r is None or r["lo"] is None:
        return []
    return list(range(int(r["lo"]), int(r["hi"]) + 1))


def pivot_years(df: DataFrame, keys: Sequence[str], values: Mapping[str, str],
                years: Sequence[int] | None = None, year_col: str = "year",
                drop_empty: bool = False) -> DataFrame:
    """A4: one column per (value, year), named ``{prefix}{year}``.

    ``values`` maps a value column to its name prefix.  Columns come in the
    value columns' alphabetical order, then ascending year; a missing cell
    is NULL and a repeated cell is averaged.  Passing ``years`` avoids the
    job that finds them.  ``drop_empty`` removes all-NULL columns (one more
    aggregate over the already small wide table).
    """
    if years is None:
        years = year_range(df, year_col)
    years = sorted(int(y) for y in years)
    measures = sorted(values)
    g = (df.groupBy(*keys).pivot(year_col, years)
         .agg(*[F.avg(m).alias(m) for m in measures]))
    cols = [F.col(k) for k in keys]
    for m in measures:
        for y in years:
            src = f"{y}_{m}" if len(measures) > 1 else str(y)
            cols.append(F.col(f"`{src}`").alias(f"{values[m]}{y}"))
    wide = g.select(*cols)
    if drop_empty:
        value_cols = [c for c in wide.columns if c not in keys]
        counts = wide.agg(*[F.count(c).alias(c) for c in value_cols]).first()
        wide = wide.drop(*[c for c in value_cols if counts[c] == 0])
    return wide


def tide_yearly_summary(readings: DataFrame, keys: Sequence[str], ts_col: str,
                        level_col: str, years: Sequence[int] | None = None,
                        drop_empty: bool = False) -> DataFrame:
    """A1 -> A2 -> A4: daily extremes, yearly means, one wide row per station
    with ``AvgHighTide{y}`` then ``AvgLowTide{y}``."""
    daily = daily_extremes(readings, keys, ts_col, level_col)
    yearly = yearly_mean_extremes(daily, keys)
    return pivot_years(yearly, keys,
                       {"avg_high_tide": "AvgHighTide", "avg_low_tide": "AvgLowTide"},
                       years=years, drop_empty=drop_empty)


def full_outer_on(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  null_safe: bool = True) -> DataFrame:
    """Full outer join on ``keys`` with the keys coalesced.

    ``null_safe`` matches NULL keys to each other (``<=>``), as pandas does.
    """
    l = left.select(*[F.col(k).alias(f"__l_{k}") for k in keys],
                    *[c for c in left.columns if c not in keys])
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = and_all([(F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) if null_safe
                     else F.col(f"__l_{k}") == F.col(f"__r_{k}")) for k in keys])
    j = l.join(r, cond, "full")
    rest = [c for c in j.columns if not c.startswith(("__l_", "__r_"))]
    return j.select(*[F.coalesce(F.col(f"__l_{k}"), F.col(f"__r_{k}")).alias(k) for k in keys],
                    *rest)


def column_means(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: one row holding the mean of every (numeric) column."""
    from tidemark.operators._util import numeric_columns
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def broadcast_row(df: DataFrame, row: DataFrame,
                  reduce_to_mean: bool = True) -> DataFrame:
    """Put the values of a one-row table on every row.

    A table with more than one row is first reduced to its column means
    (so the broadcast side is one row by construction, never data-sized).
    Its columns replace same-named columns of ``df``.
    """
    one = column_means(row) if reduce_to_mean else row.limit(1)
    base = df.drop(*[c for c in one.columns if c in df.columns])
    return base.crossJoin(F.broadcast(one))


def with_constants(df: DataFrame, constants: Mapping[str, float]) -> DataFrame:
    """J4, literal form: per-year constants as literal columns."""
    return df.withColumns({k: F.lit(float(v)) for k, v in constants.items()})


def nearest_join(points: DataFrame, sites: DataFrame, point_xy: Sequence[str],
                 site_xy: Sequence[str], site_id: str,
                 value_cols: Sequence[str] | None = None,
                 dist_col: str = "nearest_dist",
                 max_broadcast: int = 1000,
                 cell: float | None = None, max_per_cell: int = 64, k: int = 1) -> DataFrame:
    """Every point takes the value columns of its nearest site, or of its
    ``k`` nearest: then one row for each, with its ``rank`` from 1 (fewer rows
    where there are fewer sites; a point without coordinates has one, rank NULL).

    Euclidean distance on the raw coordinates; equal distances go to the
    lowest site id.  A small site set (counted, at most ``max_broadcast``
    rows, so the per-point work is bounded) is inlined: the nearest site id
    is found per point inside the scan (no shuffle of the point table) and
    the values come from a broadcast hash join.  Larger site sets, and all
    where ``k`` is over 1, use an exact grid join (``_nearest_grid``).
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    value_cols = list(value_cols) if value_cols is not None else [
        c for c in sites.columns if c not in (site_id, *site_xy)]
    sx, sy = site_xy
    px, py = point_xy
    s = sites.filter(F.col(sx).isNotNull() & F.col(sy).isNotNull())
    n_sites = bounded_rows(s, max_broadcast)
    if n_sites is None or (k > 1 and n_sites):
        return _nearest_grid(points, s, point_xy, site_xy, site_id, value_cols,
                             dist_col, cell, max_per_cell, k)
    site_rows = s.select(F.col(site_id).alias("__sid"),
                         F.col(sx).cast("double").alias("__sx"),
                         F.col(sy).cast("double").alias("__sy")).collect()
    if not site_rows:  # no site: every point stays, without values
        kept = points.drop(*[c for c in value_cols if c in points.columns])
        none = {c: F.lit(None).cast(sites.schema[c].dataType) for c in value_cols}
        return kept.withColumns({
            f"nearest_{site_id}": F.lit(None).cast(sites.schema[site_id].dataType),
            dist_col: F.lit(None).cast("double"), **none,
            **({"rank": F.lit(None).cast("int")} if k > 1 else {})})
    site_arr = F.array(*[F.struct(F.lit(r["__sx"]).alias("x"), F.lit(r["__sy"]).alias("y"),
                                  F.lit(r["__sid"]).alias("id")) for r in site_rows])
    x, y = F.col(px).cast("double"), F.col(py).cast("double")
    # min over struct(dist, id): nearest first, lowest id on equal distance
    best = F.array_min(F.transform(site_arr, lambda e: F.struct(
        F.sqrt((x - e["x"]) * (x - e["x"]) + (y - e["y"]) * (y - e["y"])).alias("d"),
        e["id"].alias("id"))))
    tagged = points.withColumn("__best", F.when(x.isNotNull() & y.isNotNull(), best))
    tagged = tagged.withColumns({"__nid": F.col("__best.id"), dist_col: F.col("__best.d")})
    vals = s.select(F.col(site_id).alias("__nid"), *value_cols)
    base = tagged.drop("__best", *[c for c in value_cols if c in points.columns])
    return base.join(F.broadcast(vals), on="__nid", how="left").withColumnRenamed(
        "__nid", f"nearest_{site_id}")


def _nearest_grid(points, sites, point_xy, site_xy, site_id, value_cols,
                  dist_col, cell, max_per_cell=64, k=1):
    """Exact nearest ``k`` sites for large site sets by a cell equi-join.

    Sites at identical coordinates collapse to the ``k`` lowest ids first (the
    tie rule makes that exact), and the starting cell is halved until no cell
    holds more than ``max_per_cell`` sites, so a dense area is no hot join
    key.  Round r uses square cells of side ``cell * 4**r``.  A point is joined to
    the sites of its own and the eight neighbouring cells; when its
    ``k``-th candidate lies within one cell side, no site outside the block can
    be closer, so the answer is final (also where all sites are candidates).  Unresolved points go to the next round
    with larger cells until every point is resolved (a point at distance
    ``D`` from its nearest site is resolved once the side reaches ``D``).
    """
    px, py = point_xy
    sx, sy = site_xy
    ext = sites.agg(F.min(sx).alias("x0"), F.max(sx).alias("x1"),
                    F.min(sy).alias("y0"), F.max(sy).alias("y1"),
                    F.count("*").alias("n")).first()
    span = max(ext["x1"] - ext["x0"], ext["y1"] - ext["y0"], 1e-12)
    if cell is None:
        cell = span / max(1.0, (ext["n"] / 4.0) ** 0.5)
    pts = points.withColumn("__pid", F.monotonically_increasing_id())
    pts = cut_lineage(pts)  # fixes the ids for the later joins
    todo = pts.select("__pid", F.col(px).cast("double").alias("__x"),
                      F.col(py).cast("double").alias("__y")).filter(
        F.col("__x").isNotNull() & F.col("__y").isNotNull())
    placed = sites.select(F.col(sx).cast("double").alias("__sx"), F.col(sy).cast("double").alias("__sy"),
                          F.col(site_id).alias("__sid"))
    at = Window.partitionBy("__sx", "__sy").orderBy("__sid")
    sites_xy = cut_lineage(
        placed.groupBy("__sx", "__sy").agg(F.min("__sid").alias("__sid")) if k == 1 else
        placed.withColumn("__n", F.row_number().over(at)).filter(F.col("__n") <= k).drop("__n"))
    n_left = sites_xy.count()
    max_per_cell = max(max_per_cell, k)
    for _ in range(40):
        busiest = (sites_xy.groupBy(F.floor(F.col("__sx") / cell).alias("a"),
                                    F.floor(F.col("__sy") / cell).alias("b"))
                   .count().agg(F.max("count")).first()[0])
        if busiest is None or busiest <= max_per_cell:
            break
        cell /= 2.0
    found = None
    size = cell
    while True:
        s_cells = sites_xy.withColumns({"__cx": F.floor(F.col("__sx") / size),
                                        "__cy": F.floor(F.col("__sy") / size)})
        offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                         for a in (-1, 0, 1) for b in (-1, 0, 1)])
        q = (todo.withColumn("__o", F.explode(offs))
             .withColumns({"__cx": F.floor(F.col("__x") / size) + F.col("__o.a"),
                           "__cy": F.floor(F.col("__y") / size) + F.col("__o.b")}))
        cand = (q.join(s_cells, ["__cx", "__cy"])
                .withColumn("__d", F.sqrt((F.col("__x") - F.col("__sx")) ** 2
                                          + (F.col("__y") - F.col("__sy")) ** 2)))
        if k == 1:
            best = cand.groupBy("__pid").agg(
                F.min(F.struct("__d", "__sid")).alias("__b"))
            best = best.select("__pid", F.col("__b.__d").alias(dist_col),
                               F.col("__b.__sid").alias("__nid"))
            ok = cut_lineage(best.filter(F.col(dist_col) <= F.lit(size)))
        else:
            near = Window.partitionBy("__pid").orderBy("__d", "__sid")
            best = cut_lineage(cand.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
                               .select("__pid", F.col("__d").alias(dist_col), F.col("__sid").alias("__nid"), "rank"))
            sure = (best.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.max(dist_col).alias("far"))
                    .filter((F.col("n") == min(k, n_left)) & ((F.col("far") <= F.lit(size)) | (F.lit(n_left) <= k))))
            ok = cut_lineage(best.join(sure.select("__pid"), "__pid", "left_semi"))
        found = ok if found is None else found.unionByName(ok)
        todo = cut_lineage(todo.join(ok.select("__pid"), "__pid", "left_anti"))
        if todo.isEmpty():
            break
        size *= 4
    vals = sites.select(F.col(site_id).alias("__nid"), *value_cols)
    out = (pts.drop(*[c for c in value_cols if c in points.columns])
           .join(found, "__pid", "left").join(vals, "__nid", "left"))
    return out.drop("__pid").withColumnRenamed("__nid", f"nearest_{site_id}")


def pivot_wide(df: DataFrame, keys: Sequence[str], pivot_col: str,
               pivot_values: Sequence[str], value_col: str, prefix: str) -> DataFrame:
    """A4, general form: one ``{prefix}{label}`` column per pivot label
    (mean of repeated cells, NULL for missing ones), labels in given order."""
    g = df.groupBy(*keys).pivot(pivot_col, list(pivot_values)).agg(F.avg(value_col))
    return g.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in pivot_values])
