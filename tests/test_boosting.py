"""Boosted trees against a plain exact version, and their queries."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import boosting


def grow(X, g, depth, rows, l2=1.0):
    """Exact greedy tree: nested (feature, threshold, missing left, left, right) or value."""
    def score(r):
        return g[r].sum() ** 2 / (len(r) + l2)
    value = -0.1 * g[rows].sum() / (len(rows) + l2)
    if depth == 0:
        return value
    best = (1e-6, None)
    for f in range(X.shape[1]):
        x = X[rows, f]
        known = np.unique(x[~np.isnan(x)])
        for t in [*known[1:], np.inf]:
            for m in (False, True):
                left = np.where(np.isnan(x), m, x < t)
                a, b = rows[left], rows[~left]
                if len(a) and len(b):
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] + 1e-9 * abs(best[0]):
                        best = (gain, (f, t, m, a, b))
    if best[1] is None:
        return value
    f, t, m, a, b = best[1]
    return f, t, m, grow(X, g, depth - 1, a, l2), grow(X, g, depth - 1, b, l2)


def leaf(tree, x):
    while isinstance(tree, tuple):
        f, t, m, a, b = tree
        tree = a if (m if np.isnan(x[f]) else x[f] < t) else b
    return tree


def boosted(X, y, rounds, depth):
    out = np.full(len(y), y.mean())
    for _ in range(rounds):
        tree = grow(X, out - y, depth, np.arange(len(y)))
        out = out + np.array([leaf(tree, x) for x in X])
    return out


def fixture(spark, n=160):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(n, 3))
    X[:, 2] = np.round(X[:, 2])
    X[rng.random((n, 3)) < 0.15] = np.nan
    y = np.nan_to_num(X[:, 0]) * 2 + np.where(np.isnan(X[:, 1]), 3, X[:, 1] ** 2) + rng.normal(scale=.1, size=n)
    z = np.nan_to_num(X[:, 2]) + rng.normal(scale=.1, size=n)
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in X[i]], float(y[i]), float(z[i])) for i in range(n)],
        "id long, a double, b double, c double, y double, z double").repartition(3)
    return X, y, z, df


def values(df, col):
    return np.array([r[col] for r in df.orderBy("id").collect()])


def test_trees_match_an_exact_search(spark):
    X, y, z, df = fixture(spark)
    m = boosting.fit(df, {"y": ["a", "b", "c"], "z": ["c", "a"]}, rounds=12, depth=3, refresh=5)
    assert np.allclose(values(boosting.predict(df, m["y"], "p"), "p"), boosted(X, y, 12, 3), atol=1e-9)
    assert np.allclose(values(boosting.predict(df, m["z"], "p"), "p"), boosted(X[:, [2, 0]], z, 12, 3), atol=1e-9)


def test_the_first_split_falls_where_the_values_part(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 if i < 40 else 9.0) for i in range(100)],
                               "id long, a double, y double")
    t = boosting.fit(df, {"y": ["a"]}, rounds=1, depth=1)["y"]
    assert t.cuts[0][t.trees[0].split[0]] == 40.0


def test_rows_without_values(spark):
    schema = "id long, a double, y double"
    empty = boosting.fit(spark.createDataFrame([], schema), {"y": ["a"]}, rounds=2)["y"]
    one = spark.createDataFrame([(1, None, None), (2, float("nan"), 4.0), (3, None, 4.0)], schema)
    assert boosting.predict(one, empty, "p").filter("p IS NOT NULL").count() == 0
    m = boosting.fit(one, {"y": ["a"]}, rounds=2)["y"]
    assert {r.p for r in boosting.predict(one, m, "p").collect()} == {4.0}
    no_target = boosting.fit(one.withColumn("y", F.lit(None).cast("double")), {"y": ["a"]}, rounds=2)["y"]
    assert no_target.trees == []


def test_no_table_is_left(spark, tmp_path):
    from tidemark import session
    before = session.cut_lineage_path
    paths = []

    def noted(df):
        t, p = before(df)
        paths.append(p)
        return t, p
    boosting.cut_lineage_path = noted
    try:
        boosting.fit(fixture(spark, 40)[3], {"y": ["a"]}, rounds=2)
    finally:
        boosting.cut_lineage_path = before
    import os
    assert paths and not any(os.path.exists(p) for p in paths)


def test_panel_of_both_tides(spark):
    from tidemark.plans.models import boosted_test_rows
    rows = boosted_test_rows(spark, SF_SMALL, rounds=3).toPandas()
    for t in "HL":
        known = rows.dropna(subset=[f"NDVI_2000{t}"])
        got = (known[f"NDVI_2000{t}"] - known[f"Predicted_NDVI_2000{t}"]).abs()
        assert len(known) and np.allclose(known[f"Residual_{t}"], got)


def test_driver_is_sent_one_sum_a_job(spark, monkeypatch):
    """Histograms and Gaussian-process matrices are added up by tasks: what
    reaches the driver does not grow with their number."""
    from pyspark.core.rdd import RDD

    from tidemark.operators import gp
    from tidemark.operators._util import sum_of_parts
    sent, reduce = [], RDD.reduce

    def watched(self, f):
        sent.append(self.getNumPartitions())
        return reduce(self, f)

    monkeypatch.setattr(RDD, "reduce", watched)
    for n in (1, 2, 37, 300):
        rdd = spark.sparkContext.parallelize(range(n), n)
        assert sum_of_parts(rdd.map(lambda i: [i]), lambda a, b: a + b) == list(range(n))
    df = spark.range(0, 45_000, 1, 5).select(
        "id", (F.col("id") % 97 / 97.0).alias("a"), (F.col("id") % 31 / 31.0).alias("b"))
    df = df.withColumn("y", F.col("a") * 2 - F.col("b"))
    boosting.fit(df, {"y": ["a", "b"]}, rounds=2, depth=2)
    gp.fit(df, ["a", "b"], "y", "id", n_inducing=8, steps=1)
    assert len(sent) > 8 and set(sent) == {1}
