"""Mean shift and the sparse GP against dense NumPy versions of the same
computation on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import gp, knn, meanshift


def _emb2(spark):
    v = knn.as_vectors(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "vec_id", "embedding")
    return meanshift.standardise_vectors(v.select("id", F.slice("vec", 1, 2).alias("vec")), 2)


def mean_shift_numpy(X, bw, max_iter=300):
    seeds = np.unique(np.round(X / bw), axis=0) * bw
    found = []
    for s in seeds:
        m = s.copy()
        it = 0
        while True:
            inside = X[((X - m) ** 2).sum(1) <= bw * bw]
            if len(inside) == 0:
                m, cnt = None, 0
                break
            old, m = m, inside.mean(0)
            cnt = len(inside)
            if np.linalg.norm(m - old) <= 1e-3 * bw or it == max_iter:
                break
            it += 1
        if m is not None:
            found.append((cnt, tuple(m)))
    found.sort(reverse=True)
    centres = []
    for cnt, m in found:
        if all(np.linalg.norm(np.array(m) - c) > bw for c in centres):
            centres.append(np.array(m))
    C = np.array(centres)
    return C, ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1).argmin(1)


def test_mean_shift_matches_numpy(spark):
    v = _emb2(spark)
    rows = sorted(v.collect(), key=lambda r: r.id)
    X = np.array([r.vec for r in rows])
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000)
    k = int(len(X) * 0.2)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    assert abs(bw - np.sort(D, 1)[:, k - 1].mean()) < 1e-9
    C, lab = mean_shift_numpy(X, bw)
    labels, centres = meanshift.mean_shift(v, bw)
    got = {r.id: r.label for r in labels.collect()}
    assert [got[r.id] for r in rows] == list(lab)
    sc = np.array([r.centre for r in centres.orderBy("label").collect()])
    assert np.allclose(sc, C, atol=1e-9)


def test_mean_shift_takes_many_steps_a_round(spark, monkeypatch):
    """Seeds that climb a ramp of density for some sixty steps."""
    X = np.stack([10 * np.sqrt((np.arange(1200) + 0.5) / 1200), np.arange(1200) % 7 * 0.05], 1)
    X[:400, 1] += 5
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    C, lab = mean_shift_numpy(X, 1.0)
    cut, tables = meanshift.cut_lineage_counted, []
    monkeypatch.setattr(meanshift, "cut_lineage_counted", lambda df, **kw: tables.append(kw) or cut(df, **kw))
    labels, centres = meanshift.mean_shift(v, 1.0, block_rows=100)
    assert len([t for t in tables if "active" in t]) < 10
    assert [r.label for r in labels.orderBy("id").collect()] == list(lab)
    assert np.allclose([r.centre for r in centres.orderBy("label").collect()], C, atol=1e-9)


def test_mean_shift_with_ways_of_all_lengths(spark, monkeypatch):
    """Where few points may be held, some seeds walk and others take single steps."""
    X = np.random.default_rng(5).normal(size=(600, 2))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    C, lab = mean_shift_numpy(X, 0.8, max_iter=6)
    cut, seen = meanshift.cut_lineage_counted, []

    def counted(df, **kw):
        out = cut(df, **kw)
        seen.append(out[2])
        return out

    monkeypatch.setattr(meanshift, "cut_lineage_counted", counted)
    monkeypatch.setattr(meanshift, "WALK", 2 * 220)
    labels, centres = meanshift.mean_shift(v, 0.8, max_iter=6, block_rows=20)
    assert sum(s.get("walks", 0) for s in seen) and sum(s.get("steps", 0) for s in seen)
    assert [r.label for r in labels.orderBy("id").collect()] == list(lab)
    assert np.allclose([r.centre for r in centres.orderBy("label").collect()], C, atol=1e-9)


def test_mean_shift_queries_over_all_dimensions(spark, tmp_path):
    """Four clusters that the first two of 12 dimensions don't tell apart."""
    from tidemark.plans import QUERIES
    rng = np.random.default_rng(3)
    X = rng.normal(scale=0.3, size=(240, 12))
    X[:, 2:] += 4 * rng.choice([-1, 1], size=(4, 10))[np.arange(240) % 4]
    spark.createDataFrame([(i, X[i].tolist(), 0) for i in range(240)],
                          "vec_id long, embedding array<double>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    Z = (X - X.mean(0)) / X.std(0)
    D = np.sqrt(((Z[:, None, :] - Z[None, :, :]) ** 2).sum(-1))
    bw = np.sort(D, 1)[:, int(240 * 0.2) - 1].mean()
    got = QUERIES["meanshift_bandwidth_all"](spark, str(tmp_path)).first().bandwidth
    assert abs(got - bw) < 1e-6
    _, lab = mean_shift_numpy(Z, bw)
    labels = {r.id: r.label for r in QUERIES["meanshift_labels_all"](spark, str(tmp_path)).collect()}
    assert [labels[i] for i in range(240)] == list(lab) and len(set(lab)) > 2


def test_sparse_gp_matches_dense_posterior(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 3))
    y = np.sin(X[:, 0]) + 0.5 * X[:, 1] + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(300)],
                               "id long, a double, b double, c double, y double").repartition(5)
    m = gp.fit(df, ["a", "b", "c"], "y", "id", n_inducing=40, lengthscales=[1.3],
               outputscales=[0.8], noises=[0.05], jitter=1e-6)
    Z, ls, s2, nz = m.z, m.lengthscale, m.outputscale, m.noise
    yc = y - y.mean()

    def k(a, b):
        return s2 * np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / ls ** 2)
    Kmm = k(Z, Z) + 1e-6 * s2 * np.eye(len(Z))
    Kmn = k(Z, X)
    B = Kmm + Kmn @ Kmn.T / nz
    w = np.linalg.solve(B, Kmn @ yc) / nz
    mean = y.mean() + Kmn.T @ w
    out = {r.id: r.gp_mean for r in gp.predict(df, m).collect()}
    assert np.allclose([out[i] for i in range(300)], mean, atol=1e-6)


def test_gp_gradient_and_bound(spark):
    """The gradient against differences, the fitted bound against the grid's."""
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 2))
    y = np.sin(2 * X[:, 0]) + rng.normal(scale=0.2, size=200)
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(200)],
                               "id long, a double, b double, y double").repartition(3).cache()
    z, yc = X[:25], y - y.mean()

    def value(theta):
        stats = gp.gradient_stats(df, ["a", "b"], "y", z, float(np.exp(theta[0])), float(y.mean()))
        return gp.bound_gradient(stats, float(yc @ yc), 200, z, theta, 1e-4)

    theta = np.log([1.1, 0.7, 0.08])
    _, grad = value(theta)
    for i, e in enumerate(np.eye(3) * 1e-5):
        assert abs((value(theta + e)[0] - value(theta - e)[0]) / 2e-5 - grad[i]) < 1e-3 * (1 + abs(grad[i]))
    grid = gp.fit(df, ["a", "b"], "y", "id", n_inducing=25, steps=0)
    found = gp.fit(df, ["a", "b"], "y", "id", n_inducing=25)
    assert found.bound > grid.bound + 1
    _, grad = gp.bound_gradient(
        gp.gradient_stats(df, ["a", "b"], "y", found.z, found.lengthscale, found.mean),
        float(yc @ yc), 200, found.z, np.log([found.lengthscale, found.outputscale, found.noise]), 1e-4)
    assert np.abs(grad).max() < 0.5


def test_every_gp_variant_is_fitted(spark):
    from tidemark.operators import features
    from tidemark.plans.models import sparse_gp_variants
    rows = {r.variant: r for r in sparse_gp_variants(spark, SF_SMALL, n_inducing=10).collect()}
    assert set(rows) == set(features.VARIANTS)
    assert all(r.n > 0 and r.mse > 0 and 0 <= r.inside_band <= 1 for r in rows.values())
    assert rows["basic_wave_with_class"].n_features > rows["no_sediment_class"].n_features


def test_bandwidth_and_labels_hold_a_piece_of_the_matrix():
    """The tasks' arrays do not grow with the sample or the number of centres."""
    import tracemalloc

    import pandas as pd
    r = np.random.default_rng(3).normal(size=(50_000, 2))
    x, centres = r[:40], r[:20_000]
    c = pd.DataFrame({"label": np.arange(len(centres)), "centre": list(centres)})
    q = pd.DataFrame({"id": np.arange(300), "vec": list(r[:300])})
    tracemalloc.start()
    got = meanshift._kth_distance(x, r, 10_000, 256)
    labels = meanshift._nearest_centre(q, c)["label"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.sort(np.sqrt(((x[:, None] - r[None]) ** 2).sum(2)), 1)[:, 9_999]
    assert np.allclose(got, want) and (labels == np.arange(300)).all()
    assert most < 5 * 8 * meanshift.MATRIX
