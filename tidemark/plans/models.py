"""Models bound to the ``orders`` panel, and mean shift on ``embeddings``.

Panel task (as the reference predicts the last year per point): targets
NDVI_2000H / NDVI_2000L (the last full year: 2001 has few second-half
orders), features the earlier half-years 1995-1999 with
NULL cells mean-imputed; rows without the target are dropped; md5 80/20
split on o_custkey (seed 42); predictions for every point, metrics on test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boosting, clean, features, gp, meanshift, models, reshape, stats
from tidemark.operators._util import round_doubles
from tidemark.plans.panel import CLUSTER_NAMES, NDVI, PANEL_CTE, YEARS, orders_panel
from tidemark.plans.registry import register
from tidemark.plans.cluster import vectors as emb_vectors
from tidemark.session import cut_lineage
from tidemark.sources import io

FEATURES = [c for c in NDVI if int(c[5:9]) < 2000]
TARGETS = ["NDVI_2000H", "NDVI_2000L"]


def prepared_panel(spark, sf_dir):
    p = clean.impute_mean(orders_panel(spark, sf_dir), FEATURES)
    return models.split(p, "o_custkey", 0.2, 42)


@register("linear_panel_predictions")
def linear_panel_predictions(spark, sf_dir):
    """M5 (many features) + M10: OLS per target on the training rows,
    predictions for every point."""
    p = prepared_panel(spark, sf_dir).cache()
    out = p
    for t in TARGETS:
        m = models.linear_fit(p.filter(~F.col("is_test")), FEATURES, t)
        out = out.withColumn(f"Predicted_{t}", m.predict())
    return models.predictions_table(out, ["o_custkey", "is_test", *TARGETS],
                                    [f"Predicted_{t}" for t in TARGETS])


_PAIR = ["NDVI_1999H", "NDVI_1999L"]
_PAIR_CTE = f"""{PANEL_CTE},
f AS (SELECT o_custkey, coalesce(NDVI_1999H, avg(NDVI_1999H) OVER ()) AS x1,
             coalesce(NDVI_1999L, avg(NDVI_1999L) OVER ()) AS x2, NDVI_2000H AS h, NDVI_2000L AS l,
             md5(CAST(o_custkey AS VARCHAR) || '-42') < '33333333' AS is_test FROM panel)"""


def _plane_sql(y):
    """Least-squares plane of ``y`` over x1 and x2 on the training rows."""
    return f"""SELECT b1, b2, my - b1 * m1 - b2 * m2 AS a FROM (
  SELECT (s1 * v2 - s2 * c) / (v1 * v2 - c * c) AS b1, (s2 * v1 - s1 * c) / (v1 * v2 - c * c) AS b2, my, m1, m2
  FROM (SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, {y}) AS s1,
               covar_pop(x2, {y}) AS s2, avg({y}) AS my, avg(x1) AS m1, avg(x2) AS m2
        FROM f WHERE NOT is_test AND {y} IS NOT NULL))"""


@register("linear_pair_predictions", f"""
WITH {_PAIR_CTE}, ph AS ({_plane_sql("h")}), pl AS ({_plane_sql("l")})
SELECT o_custkey, round(ph.a + ph.b1 * x1 + ph.b2 * x2, 2) AS Predicted_NDVI_2000H,
       round(pl.a + pl.b1 * x1 + pl.b2 * x2, 2) AS Predicted_NDVI_2000L
FROM f CROSS JOIN ph CROSS JOIN pl
""")
def linear_pair_predictions(spark, sf_dir):
    """M5 (two features) + M10: both tides from the last year's two tides,
    predictions for every point."""
    p = cut_lineage(prepared_panel(spark, sf_dir))
    out = p
    for t in TARGETS:
        out = out.withColumn(f"Predicted_{t}", models.linear_fit(p.filter(~F.col("is_test")), _PAIR, t).predict())
    return round_doubles(models.predictions_table(out, ["o_custkey"], [f"Predicted_{t}" for t in TARGETS]), 2)


@register("panel_feature_vector", f"""
WITH {PANEL_CTE}
SELECT o_custkey, CAST(i AS INTEGER) AS place, round(list_extract(v, i + 1), 6) AS value
FROM (SELECT o_custkey, [{", ".join(f"coalesce({c}, avg({c}) OVER ())" for c in FEATURES)}] AS v FROM panel),
     range({len(FEATURES)}) r(i)
""")
def panel_feature_vector(spark, sf_dir):
    """M3: the imputed features as one array, read back by place."""
    v = models.assemble(prepared_panel(spark, sf_dir), FEATURES)
    return round_doubles(v.select("o_custkey", F.posexplode("features").alias("place", "value")))


@register("pca_pair", f"""
WITH {_PAIR_CTE},
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2,
             0.5 * atan2(2 * covar_samp(x1, x2), var_samp(x1) - var_samp(x2)) AS t FROM f),
d AS (SELECT m1, m2, cos(t) AS c, sin(t) AS s FROM m),
u AS (SELECT m1, m2, CASE WHEN (CASE WHEN abs(s) > abs(c) THEN s ELSE c END) < 0 THEN -1 ELSE 1 END AS one,
             CASE WHEN (CASE WHEN abs(c) > abs(s) THEN c ELSE -s END) < 0 THEN -1 ELSE 1 END AS two, c, s FROM d)
SELECT o_custkey, round(one * (c * (x1 - m1) + s * (x2 - m2)), 2) AS pc1,
       round(two * (c * (x2 - m2) - s * (x1 - m1)), 2) AS pc2
FROM f CROSS JOIN u
""")
def pca_pair(spark, sf_dir):
    """M9 on two columns, whose axes SQL can turn by one angle."""
    return round_doubles(models.pca_2d(cut_lineage(prepared_panel(spark, sf_dir)), _PAIR, "o_custkey"), 2)


@register("linear_panel_metrics")
def linear_panel_metrics(spark, sf_dir):
    """M8 on the test rows of both linear models."""
    pred = linear_panel_predictions(spark, sf_dir).filter("is_test")
    res = None
    for t in TARGETS:
        m = models.regression_metrics(pred, t, f"Predicted_{t}").withColumn("target", F.lit(t))
        res = m if res is None else res.unionByName(m)
    return res


def boosted_test_rows(spark, sf_dir, rounds=100):
    """Test rows with the boosted predictions of both tides (depth 5, step
    0.1): features are the earlier half-years, the other tide's target
    year and the one-hot sediment and cluster classes (the test tables'
    customer segment and nation); both models share the test ids."""
    classes = io.load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("STRATCODE"),
        F.col("c_nationkey").cast("int").alias("Cluster"))
    p = clean.blank_to(prepared_panel(spark, sf_dir).join(classes, "o_custkey", "left"), "STRATCODE", "WATER")
    p = clean.map_labels(p, "Cluster", CLUSTER_NAMES, "ClusterName")
    p = cut_lineage(p.withColumn("Code", F.col("Cluster")))
    wide = models.one_hot(models.one_hot(p, "STRATCODE", drop_first=True), "Code", drop_first=True)
    hot = [c for c in wide.columns if c not in p.columns]
    fitted = boosting.fit(wide.filter(~F.col("is_test")),
                          {t: [*FEATURES, *[o for o in TARGETS if o != t], *hot] for t in TARGETS}, rounds)
    test = wide.filter("is_test")
    for t in TARGETS:
        test = boosting.predict(test, fitted[t], f"Predicted_{t}")
        test = test.withColumn(f"Residual_{t[-1]}", clean.residual(t, f"Predicted_{t}"))
    return test.select("o_custkey", "Cluster", "ClusterName", *TARGETS,
                       *[f"Predicted_{t}" for t in TARGETS], "Residual_H", "Residual_L")


@register("boosted_panel")
def boosted_panel(spark, sf_dir):
    """M6: boosted trees of both tides; test rows with predictions and
    residuals."""
    return boosted_test_rows(spark, sf_dir)


@register("boosted_metrics")
def boosted_metrics(spark, sf_dir):
    """M6 + M8: MSE, MAE, R2 and explained variance of both boosted models on
    the test rows."""
    test = cut_lineage(boosted_test_rows(spark, sf_dir))
    each = [models.regression_metrics(test, t, f"Predicted_{t}").withColumn("target", F.lit(t))
            for t in TARGETS]
    return each[0].unionByName(each[1])


@register("boosted_outliers")
def boosted_outliers(spark, sf_dir):
    """M6 + A9: test rows whose residual lies more than two deviations above
    the mean residual of their tide's model (few test rows of the small tables lie three
    above)."""
    test = cut_lineage(boosted_test_rows(spark, sf_dir))
    each = [stats.sigma_outliers(test, f"Residual_{t[-1]}", 2).select(
        "o_custkey", "ClusterName", F.lit(t).alias("target"), F.col(t).alias("actual"),
        F.col(f"Predicted_{t}").alias("predicted"), F.col(f"Residual_{t[-1]}").alias("residual"))
        for t in TARGETS]
    return each[0].unionByName(each[1])


@register("boosted_cluster_residuals")
def boosted_cluster_residuals(spark, sf_dir):
    """M6 + A8: mean and deviation of the modelled residuals by cluster, for
    both tides."""
    test = cut_lineage(boosted_test_rows(spark, sf_dir))
    each = [stats.group_mean_std(test, "Cluster", f"Residual_{t[-1]}").withColumn("target", F.lit(t))
            for t in TARGETS]
    return each[0].unionByName(each[1])


@register("pca_panel")
def pca_panel(spark, sf_dir):
    """M9: centred 2-component projection of the standardised features."""
    p = models.standardise(prepared_panel(spark, sf_dir), FEATURES)
    return models.pca_2d(p, FEATURES, "o_custkey")


@register("sparse_gp_panel")
def sparse_gp_panel(spark, sf_dir):
    """M7: sparse GP (500 inducing points) for the high-tide target,
    features standardised on the training rows; test-row predictions."""
    p = prepared_panel(spark, sf_dir).filter(F.col("NDVI_2000H").isNotNull())
    # The variant with train-only scaling and a white-noise term; later
    # years than the target are not features
    later = [c for c in NDVI if int(c[5:9]) >= 2000 and c not in TARGETS]
    feats, var = features.feature_set(p.drop("o_custkey", *later), "all_wave_no_sediment",
                                      TARGETS)
    train = p.filter(~F.col("is_test"))
    p = models.standardise(p, feats, fit_on=train if var.scale == "train" else p).cache()
    model = gp.fit(p.filter(~F.col("is_test")), feats, "NDVI_2000H", "o_custkey",
                   n_inducing=500, white=var.white, jitter=var.jitter)
    out = gp.predict(p.filter("is_test").select("o_custkey", *feats, "NDVI_2000H"), model)
    return out.select("o_custkey", "NDVI_2000H", "gp_mean", "gp_var", "gp_lower", "gp_upper")


# the panel's years moved so that the target year is the scripts' own
_MOVED = {c: f"NDVI_{int(c[5:9]) + 24}{c[9]}" for c in NDVI if int(c[5:9]) <= 2000}


def variant_table(spark, sf_dir):
    """The panel under the column names of the scripts' point table."""
    classes = io.load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("STRATCODE"),
        F.col("c_nationkey").cast("double").alias("FID"), F.col("c_acctbal").alias("Longitude"))
    p = prepared_panel(spark, sf_dir).filter(F.col("NDVI_2000H").isNotNull())
    p = clean.blank_to(p.join(classes, "o_custkey", "left"), "STRATCODE", "WATER")
    p = clean.fill_constant(p, {"FID": 0.0, "Longitude": 0.0})
    return p.select(F.col("o_custkey").alias("OBJECTID"), "is_test", "Longitude", "FID", "STRATCODE",
                    *[F.col(c).alias(m) for c, m in _MOVED.items()])


@register("sparse_gp_variants")
def sparse_gp_variants(spark, sf_dir, n_inducing=500):
    """M11 + M7: each of the seven variants fitted on its own columns, scaling
    and kernel terms; number of features, metrics and the share of test rows
    inside the band."""
    w, target = cut_lineage(variant_table(spark, sf_dir)), "NDVI_2024H"
    out = None
    for name in features.VARIANTS:
        feats, var = features.feature_set(w, name, [target, "NDVI_2024L"])
        p = w
        if var.sediment_class:
            p = models.one_hot(w, "STRATCODE", drop_first=True)
            feats = [*feats, *[c for c in p.columns if c not in w.columns]]
        if var.scale != "none":
            p = models.standardise(p, feats, fit_on=p.filter(~F.col("is_test")) if var.scale == "train" else p)
        p = cut_lineage(p.select("OBJECTID", "is_test", target, *feats))
        model = gp.fit(p.filter(~F.col("is_test")), feats, target, "OBJECTID", n_inducing=n_inducing,
                       white=var.white, jitter=var.jitter)
        test = gp.predict(p.filter("is_test").select("OBJECTID", target, *feats), model)
        inside = test.agg(F.avg(F.col(target).between(F.col("gp_lower"), F.col("gp_upper")).cast("int"))
                          .alias("inside_band"))
        one = (models.regression_metrics(test, target, "gp_mean").crossJoin(F.broadcast(inside))
               .withColumns({"variant": F.lit(name), "n_features": F.lit(len(feats))}))
        out = one if out is None else out.unionByName(one)
    return out


FORECAST_SQL = f"""
WITH {PANEL_CTE},
s AS (SELECT *, md5(CAST(o_custkey AS VARCHAR) || '-42') < '33333333' AS is_test FROM panel),
fit AS (SELECT regr_slope(NDVI_2001H, NDVI_2000H) AS b, regr_intercept(NDVI_2001H, NDVI_2000H) AS a
        FROM s WHERE NOT is_test)
{" UNION ALL ".join(
    f"SELECT o_custkey, CAST({y} AS BIGINT) AS year, 'H' AS tide, round(NDVI_{y}H, 6) AS value, "
    f"false AS is_predicted FROM panel" for y in YEARS)}
UNION ALL SELECT o_custkey, CAST(2002 AS BIGINT), 'H', round(a + b * NDVI_2000H, 2), true
FROM panel CROSS JOIN fit
"""


@register("series_with_forecast", FORECAST_SQL)
def series_with_forecast(spark, sf_dir):
    """Each point's high-tide series plus its prediction at the next
    year (one-feature least squares on the training rows)."""
    p = models.split(orders_panel(spark, sf_dir), "o_custkey", 0.2, 42)
    fit = models.linear_fit_one(p.filter(~F.col("is_test")), "NDVI_2000H", "NDVI_2001H")
    p = p.crossJoin(F.broadcast(fit)).withColumn(
        "pred", F.col("intercept") + F.col("slope") * F.col("NDVI_2000H"))
    s = reshape.series_with_forecast(p, ["o_custkey"], YEARS, "H", "pred", 2002)
    # actual cells to 6 places; regression outputs to 2 (engines agree to ~1e-12 relative)
    return s.withColumn("value", F.when(F.col("is_predicted"), F.round("value", 2))
                        .otherwise(F.round("value", 6)))


def _emb2(spark, sf_dir):
    v = emb_vectors(spark, sf_dir).select("id", F.slice("vec", 1, 2).alias("vec"))
    return meanshift.standardise_vectors(v, 2)


def _bandwidth_ctes(quantile: float) -> str:
    """Standardised points ``z`` and distances ``d`` of the bandwidth estimate."""
    return f"""p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p),
z AS (SELECT id, CASE WHEN sx > 0 THEN (x - mx) / sx ELSE 0 END AS x,
             CASE WHEN sy > 0 THEN (y - my) / sy ELSE 0 END AS y FROM p CROSS JOIN s),
smp AS (SELECT * FROM z ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT 50000),
k AS (SELECT CAST(floor(count(*) * {quantile}) AS BIGINT) AS k FROM smp),
d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
             row_number() OVER (PARTITION BY a.id ORDER BY
               sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS rn
      FROM smp a CROSS JOIN smp b)"""


@register("meanshift_bandwidth", f"""
WITH {_bandwidth_ctes(0.2)}
SELECT round(avg(d), 6) AS bandwidth FROM d CROSS JOIN k WHERE rn = k.k
""")
def meanshift_bandwidth(spark, sf_dir):
    """bandwidth = mean distance to the 0.2-quantile neighbour
    (sample of at most 50,000 points) on the standardised first two dims."""
    v = _emb2(spark, sf_dir)
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000, 42)
    return v.agg(F.round(F.lit(bw), 6).alias("bandwidth"))


@register("meanshift_labels")
def meanshift_labels(spark, sf_dir):
    """C14: mean shift with bin seeding; label of the nearest centre."""
    v = _emb2(spark, sf_dir)
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000, 42)
    labels, _ = meanshift.mean_shift(v, bw)
    return labels


@register("meanshift_labels_fine", f"""
WITH RECURSIVE {_bandwidth_ctes(0.02)},
bw AS (SELECT avg(d) AS bw FROM d CROSS JOIN k WHERE rn = k.k),
seeds AS (SELECT DISTINCT round_even(x / bw, 0) * bw AS x, round_even(y / bw, 0) * bw AS y FROM z, bw),
shift(sid, x, y, cnt, n, active) AS (
  SELECT row_number() OVER (), x, y, CAST(0 AS BIGINT), 0, true FROM seeds
  UNION ALL
  SELECT s.sid, avg(p.x), avg(p.y), count(*), s.n + 1,
         sqrt((avg(p.x) - s.x) ** 2 + (avg(p.y) - s.y) ** 2) > 1e-3 * bw AND s.n < 300
  FROM shift s JOIN bw ON s.active JOIN z p ON (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= bw * bw
  GROUP BY s.sid, s.x, s.y, s.n, bw),
means AS (SELECT x, y, row_number() OVER (ORDER BY cnt DESC, x DESC, y DESC, sid) AS r FROM shift WHERE NOT active),
absorbed(r, xs, ys) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[])
  UNION ALL
  SELECT m.r, CASE WHEN apart THEN list_append(xs, m.x) ELSE xs END, CASE WHEN apart THEN list_append(ys, m.y) ELSE ys END
  FROM (SELECT m.*, a.xs, a.ys, len(list_filter(list_zip(a.xs, a.ys),
               lambda c: sqrt((c[1] - m.x) ** 2 + (c[2] - m.y) ** 2) <= bw)) = 0 AS apart
        FROM absorbed a JOIN means m ON m.r = a.r + 1, bw) m),
centres AS (SELECT unnest(xs) AS x, unnest(ys) AS y, unnest(range(len(xs))) AS label
            FROM absorbed WHERE r = (SELECT max(r) FROM means))
SELECT z.id, CAST(arg_min(label, (z.x - c.x) ** 2 + (z.y - c.y) ** 2) AS INTEGER) AS label
FROM z, centres c GROUP BY z.id
""")
def meanshift_labels_fine(spark, sf_dir):
    """C14 with the bandwidth of the 0.02-quantile neighbour, which leaves
    many clusters on the first two dimensions."""
    v = _emb2(spark, sf_dir)
    labels, _ = meanshift.mean_shift(v, meanshift.estimate_bandwidth(v, 0.02, 50_000, 42))
    return labels


def _emb_all(spark, sf_dir):
    v = cut_lineage(emb_vectors(spark, sf_dir))
    first = v.select(F.size("vec").alias("n")).head()
    return meanshift.standardise_vectors(v, first.n) if first else v


@register("meanshift_bandwidth_all")
def meanshift_bandwidth_all(spark, sf_dir):
    """C13 over all dimensions, as the reference clusters all its columns."""
    v = _emb_all(spark, sf_dir)
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000, 42)
    return v.agg(F.round(F.lit(bw), 6).alias("bandwidth"))


@register("meanshift_labels_all")
def meanshift_labels_all(spark, sf_dir):
    """C14 over all dimensions."""
    v = _emb_all(spark, sf_dir)
    bw = meanshift.estimate_bandwidth(v, 0.2, 50_000, 42)
    labels, _ = meanshift.mean_shift(v, bw)
    return labels
