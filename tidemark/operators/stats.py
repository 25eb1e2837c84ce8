"""Descriptive statistics of scored rows.

Each is one or two aggregate passes whose result is bounded (one row, or a
fixed number of bins / grid cells); exact quantiles come from
``rank.column_quantiles`` (histogram narrowing, no single-task buffer).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import pair_count, safe_corr
from tidemark.operators.rank import column_quantiles, exact_quantiles


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-NULL values."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def n_distinct(df: DataFrame, col: str, out: str = "n_clusters") -> DataFrame:
    """Number of distinct non-NULL values (one row)."""
    return df.agg(F.countDistinct(col).alias(out))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 % (linear), max,
    one row per column.  The quartiles of all columns come from the same
    passes."""
    spark = df.sparkSession
    cols = [c for c in dict.fromkeys(cols) if c in df.columns]
    schema = ("column string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    if not cols:
        return spark.createDataFrame([], schema)
    df = df.select(*cols).persist()       # read by several passes below
    base = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
        F.max(c).alias(f"{c}__max"))]).first()
    quartiles = column_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    rows = []
    for c, q in quartiles.items():
        rows.append((c, int(base[f"{c}__n"]), base[f"{c}__mean"], base[f"{c}__std"],
                     _f(base[f"{c}__min"]), q[0.25], q[0.5], q[0.75], _f(base[f"{c}__max"])))
    df.unpersist()
    return spark.createDataFrame(rows, schema)


def _f(v):
    return None if v is None else float(v)


def group_mean_std(df: DataFrame, by: str, col: str) -> DataFrame:
    """Mean and sample std of ``col`` per group (NULL group dropped)."""
    return (df.filter(F.col(by).isNotNull()).groupBy(by)
            .agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.count(col).alias("n")))


def sigma_outliers(df: DataFrame, col: str, k: float) -> DataFrame:
    """Rows with ``col > mean + k * std`` (sample std over all rows)."""
    thr = df.agg((F.avg(col) + F.lit(float(k)) * F.stddev_samp(col)).alias("__thr"))
    return df.crossJoin(F.broadcast(thr)).filter(F.col(col) > F.col("__thr")).drop("__thr")


def tukey_outliers(df: DataFrame, col: str, m: float = 1.5) -> DataFrame:
    """A10: rows above ``Q3 + m * IQR`` (upper fence only)."""
    q = exact_quantiles(df, col, [0.25, 0.75])
    if q[0.25] is None:
        return df.limit(0)
    fence = q[0.75] + m * (q[0.75] - q[0.25])
    return df.filter(F.col(col) > F.lit(fence))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (a, b, corr, n);
    absent columns are skipped.  One aggregate pass over the unordered pairs;
    each off-diagonal result is given in both orders."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    one = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in (
        safe_corr(a, b).alias(f"c{i}"), pair_count(a, b).alias(f"n{i}"))])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"),
                 F.col(f"c{i}").alias("corr"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]))
    return one.select(stacked.alias("s")).select("s.*")


def value_range(df: DataFrame, a: str, b: str) -> DataFrame:
    """Joint min and max of two columns."""
    return df.agg(F.least(F.min(a), F.min(b)).alias("lo"),
                  F.greatest(F.max(a), F.max(b)).alias("hi"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins
    kept.  An all-equal column gets the range value +- 0.5."""
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    rng = v.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    rng = rng.select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5)
                     .otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5)
                     .otherwise(F.col("mx")).alias("hi"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * F.lit(float(bins))
                        / (F.col("hi") - F.col("lo"))).cast("long"), F.lit(bins - 1))
    counts = (v.crossJoin(F.broadcast(rng)).groupBy(b.alias("bin"))
              .agg(F.count("*").alias("count")))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
                      "lo", "hi").withColumn("bin", F.col("bin").cast("long"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def box_stats(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest data inside the 1.5 IQR fences)
    and the number of points beyond them."""
    spark = df.sparkSession
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    if q[0.25] is None:
        return spark.createDataFrame([], "q1 double, median double, q3 double, "
                                         "whisker_lo double, whisker_hi double, n_fliers long")
    iqr = q[0.75] - q[0.25]
    lo_f, hi_f = q[0.25] - whis * iqr, q[0.75] + whis * iqr
    c = F.col(col)
    return df.agg(F.lit(q[0.25]).alias("q1"), F.lit(q[0.5]).alias("median"),
                  F.lit(q[0.75]).alias("q3"),
                  F.min(F.when(c >= lo_f, c)).cast("double").alias("whisker_lo"),
                  F.max(F.when(c <= hi_f, c)).cast("double").alias("whisker_hi"),
                  F.count(F.when((c < lo_f) | (c > hi_f), 1)).alias("n_fliers"))


def _kernel_sums(points: DataFrame, kernel, n_grid: int, chunk: int = 512) -> DataFrame:
    """``g`` (grid place) and ``s``: weighted kernel sums over all points (the
    last column is the weight).  One row per grid place leaves a task."""
    def run(batches):
        total = np.zeros(n_grid)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            for lo in range(0, len(x), chunk):
                total += x[lo:lo + chunk, -1] @ kernel(x[lo:lo + chunk])
        yield pd.DataFrame({"g": np.arange(n_grid, dtype=np.int64), "s": total})

    if kernel is None:
        return points.sparkSession.createDataFrame([], "g long, s double")
    return (points.mapInPandas(run, "g long, s double")
            .groupBy("g").agg(F.sum("s").alias("s")))


def kde_1d(df: DataFrame, col: str, grid_size: int = 200,
           prebin: int | None = None) -> DataFrame:
    """Gaussian KDE on ``grid_size`` points over [min, max].

    Bandwidth: Scott's factor n^(-1/5) times the sample std.  Each task
    sums its rows' kernels per grid point and hands on one row per point, so
    no row x grid table is made; the arithmetic is rows times grid points.
    ``prebin`` (cells over [min, max]) first counts points per cell (one
    aggregate with a bounded result) and sums kernels over cell centres
    weighted by the counts: cost independent of the row count, error
    within half a cell width.
    """
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    st = v.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("*").alias("n"),
               F.stddev_samp("v").alias("sd"))
    w = F.lit(1.0)
    if prebin:
        width = (F.col("mx") - F.col("mn")) / F.lit(float(prebin))
        cell = F.least(F.floor((F.col("v") - F.col("mn")) / width), F.lit(prebin - 1))
        v = (v.crossJoin(F.broadcast(st.select("mn", "mx"))).groupBy(
            F.when(F.col("mx") > F.col("mn"), cell).otherwise(F.lit(0)).alias("c"), "mn", "mx")
            .agg(F.count("*").alias("w"))
            .select((F.col("mn") + (F.col("c") + 0.5) * (F.col("mx") - F.col("mn"))
                     / F.lit(float(prebin))).alias("v"), "w"))
        w = F.col("w")
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    one = st.first()
    grid = st.select(F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("g"), "*")
    grid = grid.withColumn("x", F.col("mn") + F.col("g") * (F.col("mx") - F.col("mn"))
                           / F.lit(float(grid_size - 1)))
    if not one["n"] or not one["h"]:
        kernel = None           # no spread: NULL densities below, no rows without values
    else:
        x = one["mn"] + np.arange(grid_size) * (one["mx"] - one["mn"]) / (grid_size - 1)

        def kernel(p):
            return np.exp(-0.5 * ((x[None, :] - p[:, :1]) / one["h"]) ** 2)
    sums = _kernel_sums(v.select("v", w.cast("double").alias("w")), kernel, grid_size)
    dens = grid.join(F.broadcast(sums), "g", "left" if one["n"] else "inner")
    return dens.select(F.col("g").cast("long").alias("g"), "x",
                       (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))))
                       .alias("density"))


def kde_2d(df: DataFrame, x: str, y: str, grid_size: int = 50,
           prebin: int | None = None) -> DataFrame:
    """2-D Gaussian KDE on a grid_size^2 grid over the bounding box.

    Bandwidth matrix: sample covariance times Scott's n^(-1/3) (d = 2).
    ``prebin`` as in ``kde_1d``, with prebin x prebin cells.
    """
    v = (df.select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
         .filter(F.col("px").isNotNull() & F.col("py").isNotNull()))
    st = v.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"),
               F.max("py").alias("y1"), F.count("*").alias("n"),
               F.var_samp("px").alias("vxx"), F.var_samp("py").alias("vyy"),
               F.covar_samp("px", "py").alias("vxy"))
    f = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    st = st.select("*", (F.col("vxx") * f).alias("a"), (F.col("vxy") * f).alias("b"),
                   (F.col("vyy") * f).alias("c"))
    st = st.withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b"))
    seq = F.sequence(F.lit(0), F.lit(grid_size - 1))
    one = st.first()
    grid = (st.select(F.explode(seq).alias("i"), "*").select(F.explode(seq).alias("j"), "*"))
    step = F.lit(float(grid_size - 1))
    grid = grid.select("i", "j", "n", "a", "b", "c", "det",
                       (F.col("x0") + F.col("i") * (F.col("x1") - F.col("x0")) / step).alias("gx"),
                       (F.col("y0") + F.col("j") * (F.col("y1") - F.col("y0")) / step).alias("gy"))
    w = F.lit(1.0)
    if prebin:
        box = st.select("x0", "x1", "y0", "y1")
        fb = F.lit(float(prebin))

        def cell(c, lo, hi):
            raw = F.least(F.floor((F.col(c) - F.col(lo)) * fb / (F.col(hi) - F.col(lo))),
                          F.lit(prebin - 1))
            return F.when(F.col(hi) > F.col(lo), raw).otherwise(F.lit(0))
        v = (v.crossJoin(F.broadcast(box))
             .groupBy(cell("px", "x0", "x1").alias("cx"), cell("py", "y0", "y1").alias("cy"),
                      "x0", "x1", "y0", "y1")
             .agg(F.count("*").alias("w"))
             .select((F.col("x0") + (F.col("cx") + 0.5) * (F.col("x1") - F.col("x0")) / fb)
                     .alias("px"),
                     (F.col("y0") + (F.col("cy") + 0.5) * (F.col("y1") - F.col("y0")) / fb)
                     .alias("py"), "w"))
        w = F.col("w")
    if not one["n"] or not one["det"]:
        kernel = None
    else:
        at = np.arange(grid_size) / (grid_size - 1)
        gx = np.repeat(one["x0"] + at * (one["x1"] - one["x0"]), grid_size)
        gy = np.tile(one["y0"] + at * (one["y1"] - one["y0"]), grid_size)

        def kernel(p):
            # (dx, dy) H^-1 (dx, dy)' with H = [[a, b], [b, c]]
            dx, dy = gx[None, :] - p[:, :1], gy[None, :] - p[:, 1:2]
            return np.exp(-0.5 * (one["c"] * dx * dx - 2 * one["b"] * dx * dy
                                  + one["a"] * dy * dy) / one["det"])
    sums = _kernel_sums(v.select("px", "py", w.cast("double").alias("w")), kernel, grid_size ** 2)
    dens = grid.withColumn("g", F.col("i") * grid_size + F.col("j")).join(
        F.broadcast(sums), "g", "left" if one["n"] else "inner")
    return dens.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                       "gx", "gy",
                       (F.col("s") / (F.col("n") * F.lit(2 * math.pi) * F.sqrt(F.col("det"))))
                       .alias("density"))


def pair_grid(df: DataFrame, id_col: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """For every ordered pair of the listed columns, counts on a
    bins x bins grid over each column's [min, max] (bounded output:
    pairs x bins^2 rows at most).  Absent columns are skipped."""
    cols = [c for c in cols if c in df.columns]
    rng = df.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"{c}__lo"),
                                             F.max(c).cast("double").alias(f"{c}__hi"))])

    def binned(c):
        lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
        raw = F.floor((F.col(c) - lo) * F.lit(float(bins)) / (hi - lo))
        return F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("long")

    b = df.crossJoin(F.broadcast(rng)).select(
        *[binned(c).alias(c) for c in cols])
    long_a = b.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.col(a).alias("bin_a"),
                 F.lit(c2).alias("col_b"), F.col(c2).alias("bin_b"))
        for a in cols for c2 in cols if a != c2])).alias("p")).select("p.*")
    return (long_a.filter(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
            .groupBy("col_a", "col_b", "bin_a", "bin_b").agg(F.count("*").alias("count")))


def kde_levels(grid: DataFrame, n_levels: int = 50, thresh: float = 0.05,
               density_col: str = "density") -> DataFrame:
    """A16 contour levels: for iso-proportions q in linspace(thresh, 1, n),
    the density above which the grid holds a fraction 1 - q of the total
    mass (cells sorted by density, descending cumulative share).

    Works on the density grid (grid_size^2 rows, bounded by its
    parameter), never on the data rows.
    """
    from pyspark.sql import Window
    w = Window.orderBy(F.col(density_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = grid.select(density_col).withColumn(
        "__share", F.sum(density_col).over(w) / F.sum(density_col).over(Window.partitionBy()))
    qs = ([thresh + (1.0 - thresh) * i / (n_levels - 1) for i in range(n_levels)]
          if n_levels > 1 else [thresh])
    one = g.agg(*[F.max(F.when(F.col("__share") >= F.lit(1.0 - q), F.col(density_col)))
                  .alias(f"l{i}") for i, q in enumerate(qs)],
                F.min(density_col).alias("__lowest"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("level"), F.lit(q).alias("iso_proportion"),
                 F.coalesce(F.col(f"l{i}"), F.col("__lowest")).alias("threshold"))
        for i, q in enumerate(qs)]))
    return one.select(rows.alias("r")).select("r.*")
