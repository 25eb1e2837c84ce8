"""Residual study bound to the driver's tables.

Scored rows: ``lineitem`` with a least-squares fit of l_extendedprice on
l_quantity over the training rows (md5 80/20 split on l_orderkey, seed 42);
every row gets a prediction, the test rows are studied.  Price-scale
outputs are rounded to 2 places (the two engines' regression aggregates
agree to ~1e-12 relative, not to 6 decimals of a 5-digit number).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, models, significance, stats
from tidemark.operators._util import round_doubles
from tidemark.plans.registry import register
from tidemark.sources import io

SCORED_CTE = """
li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
              md5(CAST(l_orderkey AS VARCHAR) || '-42') < '33333333' AS is_test
       FROM lineitem),
fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
               regr_intercept(l_extendedprice, l_quantity) AS intercept
        FROM li WHERE NOT is_test),
scored AS (SELECT li.*, intercept + slope * l_quantity AS predicted,
                  abs(l_extendedprice - (intercept + slope * l_quantity)) AS residual
           FROM li CROSS JOIN fit),
test AS (SELECT * FROM scored WHERE is_test)"""

SEVERITY_T = 5000.0


def scored_lineitem(spark, sf_dir):
    li = io.load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = models.split(li, "l_orderkey", 0.2, 42)
    fit = models.linear_fit_one(li.filter(~F.col("is_test")), "l_quantity", "l_extendedprice")
    scored = li.crossJoin(F.broadcast(fit.select("slope", "intercept")))
    scored = scored.withColumn("predicted",
                               F.col("intercept") + F.col("slope") * F.col("l_quantity"))
    return scored.withColumn("residual", clean.residual("l_extendedprice", "predicted")) \
        .drop("slope", "intercept")


def test_rows(spark, sf_dir):
    return scored_lineitem(spark, sf_dir).filter("is_test")


@register("ols_one_feature", f"""
WITH {SCORED_CTE}
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       regr_count(l_extendedprice, l_quantity) AS n
FROM li WHERE NOT is_test
""")
def ols_one_feature(spark, sf_dir):
    """M5 (one feature) + M4: slope / intercept on the training rows."""
    li = models.split(io.load_table(spark, sf_dir, "lineitem"), "l_orderkey", 0.2, 42)
    f = models.linear_fit_one(li.filter(~F.col("is_test")), "l_quantity", "l_extendedprice")
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    "n")


@register("scored_test_rows", f"""
WITH {SCORED_CTE}
SELECT l_orderkey, l_linenumber, l_extendedprice, round(predicted, 2) AS predicted,
       round(residual, 2) AS residual,
       CASE WHEN l_extendedprice > predicted THEN 'erosion'
            WHEN l_extendedprice < predicted THEN 'accretion' END AS direction_high,
       CASE WHEN l_extendedprice < predicted THEN 'erosion'
            WHEN l_extendedprice > predicted THEN 'accretion' END AS direction_low,
       CASE WHEN residual > {SEVERITY_T} THEN 'important'
            WHEN residual <= {SEVERITY_T} THEN 'other' END AS severity
FROM test
""")
def scored_test_rows(spark, sf_dir):
    """M5 predict + M10 + P9 residual + P10 direction (both tides) + P11."""
    t = test_rows(spark, sf_dir)
    out = t.select("l_orderkey", "l_linenumber", "l_extendedprice",
                   F.round("predicted", 2).alias("predicted"),
                   F.round("residual", 2).alias("residual"),
                   clean.direction("l_extendedprice", "predicted", "H").alias("direction_high"),
                   clean.direction("l_extendedprice", "predicted", "L").alias("direction_low"),
                   clean.severity("residual", SEVERITY_T).alias("severity"))
    return out


@register("regression_metrics", f"""
WITH {SCORED_CTE}
SELECT count(*) AS n, round(avg((l_extendedprice - predicted) ^ 2), 0) AS mse,
       round(avg(abs(l_extendedprice - predicted)), 4) AS mae,
       round(1 - avg((l_extendedprice - predicted) ^ 2) / var_pop(l_extendedprice), 6) AS r2,
       round(1 - var_pop(l_extendedprice - predicted) / var_pop(l_extendedprice), 6)
         AS explained_variance
FROM test
""")
def regression_metrics(spark, sf_dir):
    """M8: MSE, R^2, MAE, explained variance on the test rows."""
    m = models.regression_metrics(test_rows(spark, sf_dir), "l_extendedprice", "predicted")
    return m.select("n", F.round("mse", 0).alias("mse"), F.round("mae", 4).alias("mae"),
                    F.round("r2", 6).alias("r2"),
                    F.round("explained_variance", 6).alias("explained_variance"))


@register("sigma_outliers", f"""
WITH {SCORED_CTE}
SELECT l_orderkey, l_linenumber, round(residual, 2) AS residual FROM test
WHERE residual > (SELECT avg(residual) + 1 * stddev_samp(residual) FROM test)
""")
def sigma_outliers(spark, sf_dir):
    """Residual above mean + 1 sd (none lies above 3)."""
    o = stats.sigma_outliers(test_rows(spark, sf_dir), "residual", 1)
    return o.select("l_orderkey", "l_linenumber", F.round("residual", 2).alias("residual"))


@register("tukey_outliers", f"""
WITH {SCORED_CTE}
SELECT l_orderkey, l_linenumber, round(residual, 2) AS residual FROM test
WHERE residual > (SELECT quantile_cont(residual, 0.75)
                         + 0.25 * (quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25))
                  FROM test)
""")
def tukey_outliers(spark, sf_dir):
    """A10: residual above Q3 + 0.25 IQR (exact quantiles; none lies above 1.5)."""
    o = stats.tukey_outliers(test_rows(spark, sf_dir), "residual", 0.25)
    return o.select("l_orderkey", "l_linenumber", F.round("residual", 2).alias("residual"))


def _describe_sql(col):
    return (f"SELECT '{col}' AS \"column\", count({col}) AS count, round(avg({col}), 2) AS mean, "
            f"round(stddev_samp({col}), 2) AS std, round(min({col}), 2) AS min, "
            f"round(quantile_cont({col}, 0.25), 2) AS p25, round(quantile_cont({col}, 0.5), 2) AS p50, "
            f"round(quantile_cont({col}, 0.75), 2) AS p75, round(max({col}), 2) AS max FROM test")


@register("describe_scored", f"""
WITH {SCORED_CTE}
{" UNION ALL ".join(_describe_sql(c) for c in ["l_extendedprice", "predicted", "residual"])}
""")
def describe_scored(spark, sf_dir):
    """Count, mean, std, min, quartiles, max of actual / predicted / residual."""
    d = stats.describe(test_rows(spark, sf_dir), ["l_extendedprice", "predicted", "residual"])
    return round_doubles(d, 2)


@register("brand_price_mean_std", """
SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std,
       count(p_retailprice) AS n
FROM part WHERE p_brand IS NOT NULL GROUP BY 1
""")
def brand_price_mean_std(spark, sf_dir):
    """Mean and sd per group."""
    p = io.load_table(spark, sf_dir, "part")
    return round_doubles(stats.group_mean_std(p, "p_brand", "p_retailprice"))


@register("label_distinct", "SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def label_distinct(spark, sf_dir):
    """Sorted distinct labels."""
    return stats.distinct_values(io.load_table(spark, sf_dir, "embeddings"), "label")


@register("label_count", "SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def label_count(spark, sf_dir):
    """Number of clusters."""
    return stats.n_distinct(io.load_table(spark, sf_dir, "embeddings"), "label")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "residual"]


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            sa = f"stddev_pop({a}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            sb = f"stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                f"round(CASE WHEN {sa} > 0 AND {sb} > 0 THEN covar_pop({a}, {b}) / ({sa} * {sb}) END, 6)"
                f" AS corr, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM test")
    return " UNION ALL ".join(parts)


@register("corr_matrix", f"WITH {SCORED_CTE} {_corr_sql()}")
def corr_matrix(spark, sf_dir):
    """Pairwise Pearson matrix (long form)."""
    return round_doubles(stats.corr_matrix(test_rows(spark, sf_dir), CORR_COLS))


@register("value_range", f"""
WITH {SCORED_CTE}
SELECT round(least(min(l_extendedprice), min(predicted)), 2) AS lo,
       round(greatest(max(l_extendedprice), max(predicted)), 2) AS hi FROM test
""")
def value_range(spark, sf_dir):
    """Joint min / max of actual and predicted."""
    return round_doubles(stats.value_range(test_rows(spark, sf_dir), "l_extendedprice",
                                           "predicted"), 2)


@register("residual_histogram", f"""
WITH {SCORED_CTE},
r AS (SELECT min(residual) AS lo, max(residual) AS hi FROM test),
b AS (SELECT CAST(least(floor((residual - lo) * 20.0 / (hi - lo)), 19) AS BIGINT) AS bin,
             count(*) AS count
      FROM test CROSS JOIN r GROUP BY 1),
g AS (SELECT CAST(range AS BIGINT) AS bin, lo, hi FROM range(0, 20) CROSS JOIN r)
SELECT g.bin, round(lo + g.bin * (hi - lo) / 20.0, 2) AS bin_lo,
       round(lo + (g.bin + 1) * (hi - lo) / 20.0, 2) AS bin_hi, coalesce(b.count, 0) AS count
FROM g LEFT JOIN b ON g.bin = b.bin
""")
def residual_histogram(spark, sf_dir):
    """20 equal-width bins of the residual, empty bins kept."""
    return round_doubles(stats.histogram(test_rows(spark, sf_dir), "residual", 20), 2)


@register("residual_box", f"""
WITH {SCORED_CTE},
q AS (SELECT quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.5) AS median,
             quantile_cont(residual, 0.75) AS q3 FROM test)
SELECT round(q1, 2) AS q1, round(median, 2) AS median, round(q3, 2) AS q3,
       round(min(residual) FILTER (WHERE residual >= q1 - 1.5 * (q3 - q1)), 2) AS whisker_lo,
       round(max(residual) FILTER (WHERE residual <= q3 + 1.5 * (q3 - q1)), 2) AS whisker_hi,
       count(*) FILTER (WHERE residual < q1 - 1.5 * (q3 - q1) OR residual > q3 + 1.5 * (q3 - q1))
         AS n_fliers
FROM test CROSS JOIN q GROUP BY q1, median, q3
""")
def residual_box(spark, sf_dir):
    """Box-plot statistics of the residual."""
    return round_doubles(stats.box_stats(test_rows(spark, sf_dir), "residual"), 2)


@register("embedding_kde_1d", """
WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS v FROM embeddings),
s AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS n,
             stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
g AS (SELECT CAST(range AS BIGINT) AS g, mn + range * (mx - mn) / 199.0 AS x, n, h
      FROM range(0, 200) CROSS JOIN s)
SELECT g.g, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g CROSS JOIN v GROUP BY g.g, x, n, h
""")
def embedding_kde_1d(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) of one coordinate on 200 points."""
    e = io.load_table(spark, sf_dir, "embeddings").select(
        F.col("embedding")[0].cast("double").alias("v"))
    return round_doubles(stats.kde_1d(e, "v", 200))


KDE2_SQL = """
WITH p AS (SELECT CAST(embedding[2] AS DOUBLE) AS px, CAST(embedding[3] AS DOUBLE) AS py
           FROM embeddings),
s AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, count(*) AS n,
             var_samp(px) * pow(count(*), -1.0 / 3) AS a, covar_samp(px, py) * pow(count(*), -1.0 / 3) AS b,
             var_samp(py) * pow(count(*), -1.0 / 3) AS c FROM p),
g AS (SELECT CAST(i.range AS BIGINT) AS i, CAST(j.range AS BIGINT) AS j,
             x0 + i.range * (x1 - x0) / 49.0 AS gx, y0 + j.range * (y1 - y0) / 49.0 AS gy,
             n, a, b, c, a * c - b * b AS det
      FROM range(0, 50) i CROSS JOIN range(0, 50) j CROSS JOIN s)
SELECT i, j, round(gx, 6) AS gx, round(gy, 6) AS gy,
       round(sum(exp(-0.5 * (c * (gx - px) * (gx - px) - 2 * b * (gx - px) * (gy - py)
                             + a * (gy - py) * (gy - py)) / det))
             / (n * 2 * pi() * sqrt(det)), 6) AS density
FROM g CROSS JOIN p GROUP BY i, j, gx, gy, n, det
"""


@register("embedding_kde_2d", KDE2_SQL)
def embedding_kde_2d(spark, sf_dir):
    """2-D Gaussian KDE of point locations on a 50 x 50 grid."""
    e = io.load_table(spark, sf_dir, "embeddings").select(
        F.col("embedding")[1].cast("double").alias("px"),
        F.col("embedding")[2].cast("double").alias("py"))
    return round_doubles(stats.kde_2d(e, "px", "py", 50))


PAIR_COLS = ["l_quantity", "l_discount", "l_tax"]


def _pair_sql():
    rng = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in PAIR_COLS)

    def b(c):
        return (f"CAST(CASE WHEN {c}_hi = {c}_lo THEN 0 ELSE "
                f"least(floor(({c} - {c}_lo) * 10.0 / ({c}_hi - {c}_lo)), 9) END AS BIGINT)")
    sel = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{c}' AS col_b, {b(a)} AS bin_a, {b(c)} AS bin_b FROM x"
        for a in PAIR_COLS for c in PAIR_COLS if a != c)
    return (f"WITH r AS (SELECT {rng} FROM lineitem), x AS (SELECT * FROM lineitem CROSS JOIN r) "
            f"SELECT col_a, col_b, bin_a, bin_b, count(*) AS count FROM ({sel}) "
            f"WHERE bin_a IS NOT NULL AND bin_b IS NOT NULL GROUP BY 1, 2, 3, 4")


def _levels_sql():
    qs = [0.05 + 0.95 * i / 49 for i in range(50)]
    cols = ", ".join(f"max(density) FILTER (WHERE share >= 1 - {q!r}) AS l{i}"
                     for i, q in enumerate(qs))
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS level, {q!r} AS iso_proportion, "
        f"round(coalesce(l{i}, lowest), 9) AS threshold FROM one" for i, q in enumerate(qs))
    grid = KDE2_SQL.split("SELECT i, j,")[0]
    return (f"{grid}, d AS (SELECT i, j, sum(exp(-0.5 * (c * (gx - px) * (gx - px) "
            f"- 2 * b * (gx - px) * (gy - py) + a * (gy - py) * (gy - py)) / det)) "
            f"/ (n * 2 * pi() * sqrt(det)) AS density FROM g CROSS JOIN p GROUP BY i, j, n, det), "
            f"sh AS (SELECT density, sum(density) OVER (ORDER BY density DESC ROWS BETWEEN "
            f"UNBOUNDED PRECEDING AND CURRENT ROW) / sum(density) OVER () AS share FROM d), "
            f"one AS (SELECT {cols}, min(density) AS lowest FROM sh) {rows}")


@register("embedding_kde_2d_levels", _levels_sql())
def embedding_kde_2d_levels(spark, sf_dir):
    """A16 (levels): 50 filled-contour thresholds of the 2-D density grid."""
    e = io.load_table(spark, sf_dir, "embeddings").select(
        F.col("embedding")[1].cast("double").alias("px"),
        F.col("embedding")[2].cast("double").alias("py"))
    lv = stats.kde_levels(stats.kde_2d(e, "px", "py", 50), 50, 0.05)
    return lv.withColumn("threshold", F.round("threshold", 9))


@register("pair_grid", _pair_sql())
def pair_grid(spark, sf_dir):
    """10 x 10 binned counts for every pair of the listed columns."""
    li = io.load_table(spark, sf_dir, "lineitem")
    return stats.pair_grid(li, "l_orderkey", PAIR_COLS, 10)


@register("pearson_stats", f"""
WITH {SCORED_CTE},
s AS (SELECT CASE WHEN stddev_pop(residual) > 0 AND stddev_pop(l_extendedprice) > 0
                  THEN covar_pop(residual, l_extendedprice)
                       / (stddev_pop(residual) * stddev_pop(l_extendedprice)) END AS r,
             count(*) AS n FROM test)
SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t,
       CAST(n - 2 AS DOUBLE) AS dof FROM s
""")
def pearson_stats(spark, sf_dir):
    """T1 statistic: r, n, t, degrees of freedom (residual vs actual)."""
    s = significance.pearson_stats(test_rows(spark, sf_dir), "residual", "l_extendedprice")
    return s.select(F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"), "dof")


@register("welch_stats", """
WITH a AS (SELECT avg(c_acctbal) AS m1, var_samp(c_acctbal) AS v1, count(c_acctbal) AS n1
           FROM customer WHERE c_mktsegment = 'BUILDING'),
b AS (SELECT avg(c_acctbal) AS m2, var_samp(c_acctbal) AS v2, count(c_acctbal) AS n2
      FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
       round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) AS dof
FROM a CROSS JOIN b WHERE n1 >= 2 AND n2 >= 2
""")
def welch_stats(spark, sf_dir):
    """T2 statistic: Welch t and df between two segments."""
    c = io.load_table(spark, sf_dir, "customer")
    s = significance.welch_stats(c, "c_mktsegment", "BUILDING", "AUTOMOBILE", "c_acctbal")
    return s.select("n1", "n2", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"))


@register("anova_stats", """
WITH d AS (SELECT p_brand, p_retailprice FROM part
           WHERE p_brand IS NOT NULL AND p_retailprice IS NOT NULL),
gm AS (SELECT avg(p_retailprice) AS gm FROM d),
g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m,
             var_pop(p_retailprice) * count(*) AS ss FROM d GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS N, sum(n * (m - gm) * (m - gm)) AS ssb, sum(ss) AS ssw
      FROM g CROSS JOIN gm)
SELECT round((ssb / (k - 1)) / (ssw / (N - k)), 6) AS F, CAST(k - 1 AS DOUBLE) AS df_between,
       CAST(N - k AS DOUBLE) AS df_within FROM s WHERE k >= 2 AND N > k
""")
def anova_stats(spark, sf_dir):
    """T3 statistic: one-way F of price by brand."""
    p = io.load_table(spark, sf_dir, "part")
    s = significance.anova_stats(p, "p_brand", "p_retailprice")
    return s.select(F.round("F", 6).alias("F"), "df_between", "df_within")


@register("significance_tests")
def significance_tests(spark, sf_dir):
    """T1-T3 with p-values (the tails are not expressible in the oracle SQL)."""
    t = test_rows(spark, sf_dir)
    p1 = significance.pearson_test(t, "residual", "l_extendedprice").select(
        F.lit("pearson").alias("test"), F.col("r").alias("statistic"), "dof", "p_value")
    c = io.load_table(spark, sf_dir, "customer")
    p2 = significance.welch_t(c, "c_mktsegment", "BUILDING", "AUTOMOBILE", "c_acctbal").select(
        F.lit("welch").alias("test"), F.col("t").alias("statistic"), "dof", "p_value")
    p = io.load_table(spark, sf_dir, "part")
    p3 = significance.anova(p, "p_brand", "p_retailprice").select(
        F.lit("anova").alias("test"), F.col("F").alias("statistic"),
        F.col("df_between").alias("dof"), "p_value")
    return p1.unionByName(p2).unionByName(p3)


@register("residual_qq")
def residual_qq(spark, sf_dir):
    """Sorted residuals against normal order-statistic medians."""
    t = test_rows(spark, sf_dir).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity"))
    return significance.qq_points(t, "residual", "row_key")


@register("price_qq_positions", """
WITH d AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS value FROM part
           WHERE p_retailprice IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY value, p_partkey) AS i, count(*) OVER () AS n FROM d)
SELECT p_partkey, CAST(i - 1 AS BIGINT) AS pos, value,
       round(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                  ELSE (i - 0.3175) / (n + 0.365) END, 9) AS m
FROM r
""")
def price_qq_positions(spark, sf_dir):
    """A17 (positions): part prices in order with Filliben's medians."""
    p = io.load_table(spark, sf_dir, "part")
    q = significance.qq_positions(p, "p_retailprice", "p_partkey")
    return q.withColumn("m", F.round("m", 9))


@register("residual_qq_fit")
def residual_qq_fit(spark, sf_dir):
    """A17 (line): slope, intercept and r of the residual Q-Q points."""
    t = test_rows(spark, sf_dir).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity"))
    return significance.qq_fit(significance.qq_points(t, "residual", "row_key"))


@register("residual_shapiro")
def residual_shapiro(spark, sf_dir):
    """T4: Shapiro-Wilk W of the residuals (p up to 5,000 of them)."""
    t = test_rows(spark, sf_dir).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity"))
    return significance.shapiro(t, "residual", "row_key")


@register("price_shapiro")
def price_shapiro(spark, sf_dir):
    """T4: Shapiro-Wilk W and p of the part prices."""
    p = io.load_table(spark, sf_dir, "part")
    return significance.shapiro(p, "p_retailprice", "p_partkey")


@register("reading_sigma_outliers", """
SELECT event_id, value FROM events
WHERE value > (SELECT avg(value) + 3 * stddev_samp(value) FROM events)
""")
def reading_sigma_outliers(spark, sf_dir):
    """A9 on heavy-tailed readings: values above mean + 3 sd."""
    e = io.load_table(spark, sf_dir, "events").select("event_id", "value")
    return stats.sigma_outliers(e, "value", 3)


@register("reading_tukey_outliers", """
SELECT event_id, value FROM events
WHERE value > (SELECT quantile_cont(value, 0.75)
                      + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
               FROM events)
""")
def reading_tukey_outliers(spark, sf_dir):
    """A10 on heavy-tailed readings: values above Q3 + 1.5 IQR."""
    e = io.load_table(spark, sf_dir, "events").select("event_id", "value")
    return stats.tukey_outliers(e, "value", 1.5)
