"""Quantiles of several columns from the same passes."""

import numpy as np

from tidemark.operators import rank, stats

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def table(spark, n=400):
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=n), "b": np.round(rng.normal(size=n)), "c": rng.pareto(1.0, size=n) * 1e12,
            "hot": np.where(rng.random(n) < 0.5, 3.0, rng.random(n)), "one": np.full(n, 7.0)}
    data["b"][::7] = np.nan
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] for i, r in enumerate(zip(*data.values()))]
    return data, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(4)


def test_every_column_against_numpy(spark):
    data, df = table(spark)
    got = rank.column_quantiles(df, {c: QS for c in data}, buckets=16)
    for c, v in data.items():
        want = np.quantile(v[~np.isnan(v)], QS)
        assert np.allclose([got[c][q] for q in QS], want, rtol=1e-12, atol=0), c


def test_columns_without_values_and_infinite_ends(spark):
    df = spark.createDataFrame([(None, float("inf"), 1.0), (float("nan"), 2.0, 2.0), (None, 5.0, 3.0)],
                               "a double, b double, c double")
    got = rank.column_quantiles(df, {"a": [0.5], "b": [0.5, 1.0], "c": [0.5]})
    assert got == {"a": {0.5: None}, "b": {0.5: 5.0, 1.0: float("inf")}, "c": {0.5: 2.0}}
    assert rank.column_quantiles(df.limit(0), {"c": [0.5]}) == {"c": {0.5: None}}
    assert rank.column_quantiles(df, {}) == {}


def passes(spark, monkeypatch, df, cols):
    seen = []
    inline = rank.F.inline
    monkeypatch.setattr(rank.F, "inline", lambda c: seen.append(c) or inline(c))
    stats.describe(df, cols).collect()
    monkeypatch.setattr(rank.F, "inline", inline)
    return len(seen)


def test_passes_do_not_grow_with_the_columns(spark, monkeypatch):
    data, df = table(spark)
    alone = [passes(spark, monkeypatch, df, [c]) for c in data]
    assert passes(spark, monkeypatch, df, list(data)) == max(alone)
