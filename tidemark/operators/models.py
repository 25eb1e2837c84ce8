"""Feature preparation and models (M1-M5, M8-M10; boosted trees are in
``boosting``).

Fitting is distributed: least squares is one aggregate of centred cross
products (d x d, bounded by the feature count) solved on the driver.
Prediction is a column expression, so scoring a table is a map-only stage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import md5_below


def standardise(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """M1: z-score with the population std, fitted on ``fit_on`` (default:
    all rows); a constant column becomes 0."""
    src = fit_on if fit_on is not None else df
    st = src.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(c).alias(f"__m{i}"), F.stddev_pop(c).alias(f"__s{i}"))])
    j = df.crossJoin(F.broadcast(st))
    out = {}
    for i, c in enumerate(cols):
        s = F.col(f"__s{i}")
        out[c + suffix] = F.when(s > 0, (F.col(c) - F.col(f"__m{i}")) / s).when(
            F.col(c).isNotNull(), F.lit(0.0))
    return j.withColumns(out).drop(*[x for i in range(len(cols)) for x in (f"__m{i}", f"__s{i}")])


def one_hot(df: DataFrame, col: str, drop_first: bool = False,
            prefix: str | None = None, categories: Sequence[str] | None = None,
            max_categories: int = 1000) -> DataFrame:
    """M2: one 0/1 column per category in sorted order; NULL -> all zero.

    ``drop_first`` drops the first sorted category.  Categories are the
    distinct values unless given; more than ``max_categories`` raises (one
    column per category, so the count must be small).
    """
    if categories is None:
        categories = [r[0] for r in df.select(col).filter(F.col(col).isNotNull())
                      .distinct().limit(max_categories + 1).collect()]
        if len(categories) > max_categories:
            raise ValueError(f"{col} has more than {max_categories} categories")
    cats = sorted(categories)
    if drop_first:
        cats = cats[1:]
    p = prefix if prefix is not None else col
    cols = {f"{p}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in cats}
    return df.withColumns(cols).drop(col)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """M3: numeric columns -> one ``array<double>``."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42,
          flag: str = "is_test") -> DataFrame:
    """M4: stable train / test flag from md5(id, seed); survives
    repartitioning and retries, and the same rule holds across models
    (J5: the second model reuses the test ids by the same predicate)."""
    return df.withColumn(flag, md5_below(id_col, seed, test_fraction))


@dataclass
class LinearModel:
    features: list[str]
    coef: list[float]
    intercept: float
    n: int

    def predict(self) -> Column:
        e = F.lit(self.intercept)
        for c, b in zip(self.features, self.coef):
            e = e + F.lit(b) * F.col(c).cast("double")
        return e


def cross_products(df: DataFrame, cols: Sequence[str], means: Sequence[float]) -> np.ndarray:
    """Matrix of centred cross products of ``cols`` (no NULLs).

    Every task adds up its own matrix and hands on one; a grouped sum over
    the cells adds the tasks'.  No expression grows with the column count.
    """
    k = len(cols)
    centre = np.asarray(means, dtype=float)

    def run(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(k * k), "v": total.ravel()})

    cells = (df.select(*cols).mapInPandas(run, "cell long, v double")
             .groupBy("cell").agg(F.sum("v").alias("v")).collect())   # k x k rows
    out = np.zeros(k * k)
    for c in cells:
        out[c["cell"]] = c["v"]
    return out.reshape(k, k)


def linear_fit(df: DataFrame, features: Sequence[str], target: str) -> LinearModel:
    """M5: ordinary least squares (rows with any NULL are skipped).

    Pass 1: means.  Pass 2: centred cross products X'X, X'y (one matrix per
    task, added up).  Solved by least squares on the driver, so constant
    columns get weight 0.
    """
    feats = list(features)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in [*feats, target]]).dropna()
    mrow = d.agg(*[F.avg(c).alias(c) for c in [*feats, target]],
                 F.count("*").alias("__n")).first()
    n = int(mrow["__n"])
    if n == 0:
        return LinearModel(feats, [0.0] * len(feats), float("nan"), 0)
    k = len(feats)
    every = cross_products(d, [*feats, target], [mrow[c] for c in [*feats, target]])
    xx, xy = every[:k, :k], every[:k, k]
    beta = np.linalg.lstsq(xx, xy, rcond=1e-10)[0] if k else np.zeros(0)
    intercept = mrow[target] - float(np.dot(beta, [mrow[c] for c in feats]))
    return LinearModel(feats, [float(b) for b in beta], float(intercept), n)


def linear_fit_one(df: DataFrame, x: str, y: str) -> DataFrame:
    """M5 with one feature as SQL aggregates (slope, intercept, n)."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_count(F.col(y), F.col(x)).alias("n"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """M8: MSE, R^2, MAE, explained variance = 1 - Var(y - yhat) / Var(y)
    (population variances), over rows with both values."""
    d = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    a = d.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
              F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"))
    return a.select("n", "mse", "mae",
                    (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"),
                    (F.lit(1.0) - F.try_divide(F.col("ve"), F.col("vy"))).alias("explained_variance"))


def training_partitions(rows: int, cores: int, min_rows_per_task: int = 2_000,
                        max_rows_per_task: int = 1_000_000) -> int:
    """Task count for an iterative learner that runs several jobs per round:
    few tasks for small data (per-task overhead dominates), never more than
    the cores then, and about ``max_rows_per_task`` rows per task at scale."""
    small = min(max(1, cores), max(1, math.ceil(rows / min_rows_per_task)))
    return max(small, math.ceil(rows / max_rows_per_task))


def pca_2d(df: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """M9: centred projection on the two leading principal components.

    Covariance is one matrix of centred cross products per task, added up; the
    eigenvectors are signed so their largest-magnitude loading is positive.
    """
    cols = list(cols)
    d = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    m = d.agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("__n")).first()
    cen = {c: F.col(c) - F.lit(m[c]) for c in cols}
    cov = cross_products(d, cols, [m[c] or 0.0 for c in cols]) / max(1, m["__n"] - 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:2]
    comps = []
    for idx in order:
        v = vecs[:, idx]
        if v[np.argmax(np.abs(v))] < 0:
            v = -v
        comps.append(v)
    pcs = []
    for n_, v in enumerate(comps):
        e = F.lit(0.0)
        for c, w in zip(cols, v):
            e = e + cen[c] * F.lit(float(w))
        pcs.append(e.alias(f"pc{n_ + 1}"))
    return d.select(id_col, *pcs)


def predictions_table(df: DataFrame, keep: Sequence[str], preds: Sequence[str]) -> DataFrame:
    """Id / coordinate columns plus predictions."""
    return df.select(*keep, *preds)
