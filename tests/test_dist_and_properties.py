"""Distribution tails against closed forms, and properties of the iterative
and model operators (no SQL oracle exists for them)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import cpf, enrich, gp, meanshift, models, significance


def test_t_tail_closed_forms():
    # df = 1 is Cauchy: p = 1 - 2 atan(|t|) / pi ; df = 2: p = 1 - |t| / sqrt(t^2 + 2)
    for t in (0.3, 1.0, 2.5, 7.0):
        assert abs(dist.t_two_sided_p(t, 1) - (1 - 2 * math.atan(t) / math.pi)) < 1e-12
        assert abs(dist.t_two_sided_p(t, 2) - (1 - t / math.sqrt(t * t + 2))) < 1e-12
    # large df tends to the normal tail
    assert abs(dist.t_two_sided_p(1.96, 1e7) - 2 * dist.norm_sf(1.96)) < 1e-6


def test_f_tail_closed_form():
    # d1 = 2: p = (1 + d1 F / d2)^(-d2 / 2)
    for f, d2 in ((3.0, 10), (0.5, 4), (12.0, 30)):
        assert abs(dist.f_upper_p(f, 2, d2) - (1 + 2 * f / d2) ** (-d2 / 2)) < 1e-12


def test_norm_ppf_inverts_cdf():
    p = np.array([1e-10, 0.001, 0.02425, 0.3, 0.5, 0.8, 0.975, 1 - 1e-9])
    x = dist.norm_ppf(p)
    back = np.array([dist.norm_cdf(v) for v in x])
    assert np.allclose(back, p, rtol=1e-9, atol=1e-15)
    assert x[4] == 0.0 or abs(x[4]) < 1e-15


def shapiro_in_memory(x):
    """W and p of a small sample."""
    sig = significance
    v = np.sort(np.asarray(x, dtype=float))
    n = len(v)
    mvec = dist.norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    summ2 = float(np.sum(mvec ** 2))
    ssumm2 = math.sqrt(summ2)
    rsn = 1 / math.sqrt(n)
    a = np.zeros(n)
    a1 = sig._poly(sig._C1, rsn) + mvec[-1] / ssumm2
    if n > 5:
        a2 = sig._poly(sig._C2, rsn) + mvec[-2] / ssumm2
        fac = math.sqrt((summ2 - 2 * mvec[-1] ** 2 - 2 * mvec[-2] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
        a[:] = mvec / fac
        a[-1], a[0], a[-2], a[1] = a1, -a1, a2, -a2
    else:
        fac = math.sqrt((summ2 - 2 * mvec[-1] ** 2) / (1 - 2 * a1 ** 2))
        a[:] = mvec / fac
        a[-1], a[0] = a1, -a1
    if n % 2 == 1:
        a[n // 2] = 0.0
    w = min(1.0, float(np.dot(a, v)) ** 2 / float(np.sum((v - v.mean()) ** 2)))
    if n <= 11:
        gamma = sig._poly(sig._G, n)
        z = (-math.log(gamma - math.log1p(-w)) - sig._poly(sig._C3, n)) / math.exp(sig._poly(sig._C4, n))
    else:
        ln = math.log(n)
        z = (math.log1p(-w) - sig._poly(sig._C5, ln)) / math.exp(sig._poly(sig._C6, ln))
    return w, dist.norm_sf(z)


def test_shapiro_distributed_equals_in_memory(spark):
    rng = np.random.default_rng(7)
    for n, sample in ((30, rng.normal(size=30)), (200, rng.exponential(size=200)),
                      (9, rng.normal(size=9)), (5, rng.normal(size=5))):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(sample)], "id long, x double")
        r = significance.shapiro(df, "x", "id").first()
        w, p = shapiro_in_memory(sample)
        assert abs(r["W"] - w) < 1e-9 and abs(r["p_value"] - p) < 1e-9
        assert 0 < r["W"] <= 1
    big = rng.exponential(size=200)
    assert shapiro_in_memory(big)[1] < 0.01


def test_shapiro_has_no_p_for_many_rows(spark):
    r = significance.shapiro(spark.range(5001).withColumn("x", F.sqrt("id")), "x", "id").first()
    assert r["n"] == 5001 and 0.9 < r["W"] < 1 and r["p_value"] is None


def test_pearson_welch_anova_p_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=50)
    y = 0.8 * x + rng.normal(scale=0.5, size=50)
    df = spark.createDataFrame([(float(a), float(b), "g" + str(i % 3)) for i, (a, b) in
                                enumerate(zip(x, y))], "x double, y double, g string")
    r = significance.pearson_test(df, "x", "y").first()
    assert abs(r["r"] - np.corrcoef(x, y)[0, 1]) < 1e-12 and r["p_value"] < 1e-6
    w = significance.welch_t(df, "g", "g0", "g1", "x").first()
    assert 0 <= w["p_value"] <= 1
    a = significance.anova(df, "g", "x").first()
    assert 0 <= a["p_value"] <= 1 and a["df_between"] == 2.0


def _blobs(spark, seed=1):
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal([0, 0], 0.3, (60, 2)), rng.normal([5, 5], 0.3, (60, 2)),
                     rng.normal([0, 6], 0.3, (40, 2))])
    return spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)],
                                 "id long, vec array<double>")


def test_cpf_labels_partition_ids(spark):
    v = _blobs(spark)
    fits = cpf.cpf_fit(v, [5], [0.4], [1.0]).collect()
    ids = sorted(r.id for r in fits)
    assert ids == list(range(160))
    labels = {r.label for r in fits}
    assert len(labels - {-1}) >= 3


def test_mean_shift_centres_apart_and_all_labelled(spark):
    v = _blobs(spark)
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000)
    labels, centres = meanshift.mean_shift(v, bw)
    c = [np.array(r.centre) for r in centres.collect()]
    assert len(c) >= 2
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            assert np.linalg.norm(c[i] - c[j]) > bw
    assert labels.count() == 160


def test_gp_interpolates_with_small_noise(spark):
    x = np.linspace(0, 3, 25)
    df = spark.createDataFrame([(i, float(a), float(math.sin(a))) for i, a in enumerate(x)],
                               "id long, x double, y double")
    m = gp.fit(df, ["x"], "y", "id", n_inducing=25, lengthscales=[0.7], noises=[1e-6],
               outputscales=[1.0], jitter=1e-8)
    out = gp.predict(df, m).collect()
    assert max(abs(r.gp_mean - r.y) for r in out) < 1e-3
    assert all(r.gp_var >= 0 and r.gp_lower <= r.gp_mean <= r.gp_upper for r in out)


def test_pca_scores_centred(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(100, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)],
                               "id long, a double, b double, c double")
    s = models.pca_2d(df, ["a", "b", "c"], "id").agg(F.avg("pc1"), F.avg("pc2"),
                                                     F.var_samp("pc1"), F.var_samp("pc2")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1]) < 1e-9 and s[2] >= s[3]


def test_rollup_unchanged_under_repartitioning(spark):
    from tests.conftest import SF_SMALL
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    keys = ["l_returnflag", "l_linestatus"]
    a = enrich.tide_yearly_summary(li, keys, "l_shipdate", "l_extendedprice", years=range(1995, 2002))
    b = enrich.tide_yearly_summary(li.repartition(13), keys, "l_shipdate", "l_extendedprice",
                                   years=range(1995, 2002))
    ra = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in a.collect())
    rb = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in b.collect())
    assert ra == rb


def test_qq_fit_on_normal_scores(spark):
    # values equal to their own normal scores: slope 1, intercept 0, r 1
    n = 200
    m = [(i - 0.3175) / (n + 0.365) for i in range(1, n + 1)]
    m[-1], m[0] = 0.5 ** (1 / n), 1 - 0.5 ** (1 / n)
    z = dist.norm_ppf(np.array(m))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "id long, x double")
    f = significance.qq_fit(significance.qq_points(df, "x", "id")).first()
    assert abs(f["slope"] - 1) < 1e-9 and abs(f["intercept"]) < 1e-9 and abs(f["r"] - 1) < 1e-9


def test_prebinned_kde_close_to_exact(spark):
    from tidemark.operators import stats
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(3000, 2)) @ np.array([[1.0, 0.3], [0.0, 0.5]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    e1 = {r.g: r.density for r in stats.kde_1d(df, "x", 50).collect()}
    p1 = {r.g: r.density for r in stats.kde_1d(df, "x", 50, prebin=1024).collect()}
    assert max(abs(e1[g] - p1[g]) for g in e1) < 1e-3 * max(e1.values())
    e2 = {(r.i, r.j): r.density for r in stats.kde_2d(df, "x", "y", 20).collect()}
    p2 = {(r.i, r.j): r.density for r in stats.kde_2d(df, "x", "y", 20, prebin=512).collect()}
    assert max(abs(e2[k] - p2[k]) for k in e2) < 1e-2 * max(e2.values())
