"""Significance tests and normal scores.

Every statistic is one aggregate pass (or two), yielding a single row; the
p-value is then a vectorised function applied to that one row inside Spark
(``pandas_udf``), so the result stays a DataFrame derived from the data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dist
from tidemark.functions.exprs import pair_count, safe_corr
from tidemark.operators.rank import global_rank


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.t_two_sided_p(None if pd.isna(a) else float(a),
                                         None if pd.isna(b) else float(b))
                      for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([dist.f_upper_p(None if pd.isna(a) else float(a),
                                     None if pd.isna(b) else float(b),
                                     None if pd.isna(c) else float(c))
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _norm_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(dist.norm_ppf(p.to_numpy(dtype="float64")))


@F.pandas_udf(T.DoubleType())
def _norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else dist.norm_sf(float(v)) for v in z],
                     dtype="float64")


def pearson_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """T1 statistic: r over complete pairs, n, t = r sqrt((n-2)/(1-r^2)).
    NULL when n < 3 or a column is constant."""
    one = df.agg(safe_corr(a, b).alias("r"), pair_count(a, b).alias("n"))
    r, n = F.col("r"), F.col("n")
    t = F.when((n >= 3) & r.isNotNull() & (F.abs(r) < 1),
               r * F.sqrt((n - 2).cast("double") / (1 - r * r)))
    return one.select(F.when(n >= 3, r).alias("r"), n,
                      t.alias("t"), F.when(n >= 3, (n - 2).cast("double")).alias("dof"))


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """R, n and the two-sided p-value."""
    s = pearson_stats(df, a, b)
    return s.withColumn("p_value", F.when(F.abs(F.col("r")) == 1, F.lit(0.0))
                        .otherwise(_t_p(F.col("t"), F.col("dof"))))


def welch_stats(df: DataFrame, group_col: str, group_a, group_b, col: str) -> DataFrame:
    """T2 statistic: Welch's t and Welch-Satterthwaite degrees of freedom.
    No row when either group has fewer than two values."""
    g = F.col(group_col)
    x = F.col(col)
    one = df.agg(
        F.avg(F.when(g == group_a, x)).alias("m1"), F.var_samp(F.when(g == group_a, x)).alias("v1"),
        F.count(F.when(g == group_a, x)).alias("n1"),
        F.avg(F.when(g == group_b, x)).alias("m2"), F.var_samp(F.when(g == group_b, x)).alias("v2"),
        F.count(F.when(g == group_b, x)).alias("n2"))
    se1 = F.col("v1") / F.col("n1")
    se2 = F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se1 + se2))
    dof = F.try_divide((se1 + se2) * (se1 + se2),
                       se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1))
    return (one.filter((F.col("n1") >= 2) & (F.col("n2") >= 2))
            .select("n1", "n2", t.alias("t"), dof.alias("dof")))


def welch_t(df: DataFrame, group_col: str, group_a, group_b, col: str) -> DataFrame:
    """Welch's t, df and two-sided p."""
    s = welch_stats(df, group_col, group_a, group_b, col)
    return s.withColumn("p_value", _t_p(F.col("t"), F.col("dof")))


def anova_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """T3 statistic: one-way F with (k-1, N-k) degrees of freedom.

    Group sums are a grouped aggregate; the between / within sums of
    squares a second, one-row aggregate over the groups.  No row with
    fewer than two groups.
    """
    d = df.filter(F.col(by).isNotNull() & F.col(col).isNotNull())
    grand = d.agg(F.avg(col).alias("gm"))
    groups = d.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("m"),
                               (F.var_pop(col) * F.count(col)).alias("ss"))
    one = groups.crossJoin(F.broadcast(grand)).agg(
        F.count("*").alias("k"), F.sum("n").alias("N"),
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum("ss").alias("ssw"))
    k, n = F.col("k"), F.col("N")
    f = F.try_divide(F.col("ssb") / (k - 1), F.col("ssw") / (n - k))
    return (one.filter((k >= 2) & (n > k))
            .select(f.alias("F"), (k - 1).cast("double").alias("df_between"),
                    (n - k).cast("double").alias("df_within")))


def anova(df: DataFrame, by: str, col: str) -> DataFrame:
    """F, degrees of freedom and upper-tail p."""
    s = anova_stats(df, by, col)
    return s.withColumn("p_value", _f_p(F.col("F"), F.col("df_between"), F.col("df_within")))


def qq_positions(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """A17, first half: value order (distributed rank) and Filliben's
    order-statistic medians m_1 = 1 - 0.5^(1/n), m_n = 0.5^(1/n),
    m_i = (i - 0.3175) / (n + 0.365) otherwise."""
    d = df.select(F.col(id_col), F.col(col).cast("double").alias("value")).filter(
        F.col("value").isNotNull())
    n = d.count()
    ranked = global_rank(d, ["value", id_col], "pos")
    i = F.col("pos") + 1
    m = (F.when(i == n, F.lit(0.5 ** (1.0 / n)) if n else F.lit(None))
         .when(i == 1, F.lit(1 - 0.5 ** (1.0 / n)) if n else F.lit(None))
         .otherwise((i - 0.3175) / F.lit(n + 0.365)))
    return ranked.select(F.col(id_col), F.col("pos"), F.col("value"), m.alias("m"))


def qq_points(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """Ordered values against the normal quantiles of Filliben's
    medians (theoretical = Phi^-1(m))."""
    q = qq_positions(df, col, id_col)
    return q.select(id_col, "pos", "value", _norm_ppf(F.col("m")).alias("theoretical"))


def qq_fit(qq: DataFrame) -> DataFrame:
    """A17, line: least squares of the ordered values on the normal
    quantiles (slope, intercept) and their correlation r."""
    x, y = F.col("theoretical"), F.col("value")
    return qq.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  safe_corr("theoretical", "value").alias("r"))


# Polynomial coefficients of Royston's (1995) approximation
# for the Shapiro-Wilk test (algorithm AS R94): weights of the two largest
# order statistics (C1, C2), and the mean / log-sd of the normalising
# transform for n <= 11 (C3, C4, G) and n >= 12.
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


LARGEST_P = 5000   # rows for which p is stated


def shapiro(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """T4: Shapiro-Wilk W and p (Royston 1995), for 3 <= n.

    Per row: global rank j, m_j = Phi^-1((j - 3/8) / (n + 1/4)); the
    weights are m_j / sqrt(sum m^2) corrected at the two extremes at each
    end.  W = (sum w_j x_(j))^2 / sum (x - mean)^2: two aggregate passes
    over ranked rows.  Royston's p approximation is stated for n <= 5000;
    beyond, p is NULL.
    """
    spark = df.sparkSession
    q = qq_points(df, col, id_col)  # value + rank; theoretical unused
    d = q.select("pos", "value")
    n = d.count()
    if n < 3:
        return spark.createDataFrame([], "n long, W double, p_value double")
    j = F.col("pos") + 1
    m = _norm_ppf((j - 0.375) / F.lit(n + 0.25))
    d = d.withColumn("m", m)
    st = d.agg(F.sum(F.col("m") * F.col("m")).alias("summ2"),
               F.max(F.when(F.col("pos") == n - 1, F.col("m"))).alias("m_n"),
               F.max(F.when(F.col("pos") == n - 2, F.col("m"))).alias("m_n1"),
               F.avg("value").alias("mean")).first()
    summ2, m_n, m_n1 = st["summ2"], st["m_n"], st["m_n1"]
    rsn = 1.0 / math.sqrt(n)
    ssumm2 = math.sqrt(summ2)
    if n == 3:
        a1, a2, fac = math.sqrt(0.5), None, None
    else:
        a1 = _poly(_C1, rsn) + m_n / ssumm2
        if n > 5:
            a2 = _poly(_C2, rsn) + m_n1 / ssumm2
            fac = math.sqrt((summ2 - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
        else:
            a2 = None
            fac = math.sqrt((summ2 - 2 * m_n ** 2) / (1 - 2 * a1 ** 2))
    i = F.least(j, F.lit(n + 1) - j)          # 1-based index from the nearer end
    sgn = F.when(j > F.lit(n + 1) - j, 1.0).when(j < F.lit(n + 1) - j, -1.0).otherwise(0.0)
    w = F.when(i == 1, sgn * F.lit(a1))
    if a2 is not None:
        w = w.when(i == 2, sgn * F.lit(a2))
    w = w.otherwise(F.col("m") / F.lit(fac) if fac else F.lit(0.0))
    mean = st["mean"]
    agg = d.agg(F.sum(w * F.col("value")).alias("num"),
                F.sum((F.col("value") - mean) * (F.col("value") - mean)).alias("ssq"))
    W = F.least(F.lit(1.0), F.try_divide(F.col("num") * F.col("num"), F.col("ssq")))
    res = agg.select(F.lit(n).cast("long").alias("n"), W.alias("W"))
    if n > LARGEST_P:
        return res.withColumn("p_value", F.lit(None).cast("double"))
    if n == 3:
        p = F.greatest(F.lit(0.0), F.lit(6 / math.pi) * (F.asin(F.sqrt(F.col("W")))
                                                          - F.lit(math.asin(math.sqrt(0.75)))))
        return res.withColumn("p_value", p)
    if n <= 11:
        gamma = _poly(_G, n)
        mu, sd = _poly(_C3, n), math.exp(_poly(_C4, n))
        z = (-F.log(F.lit(gamma) - F.log1p(-F.col("W"))) - F.lit(mu)) / F.lit(sd)
    else:
        ln = math.log(n)
        mu, sd = _poly(_C5, ln), math.exp(_poly(_C6, ln))
        z = (F.log1p(-F.col("W")) - F.lit(mu)) / F.lit(sd)
    return res.withColumn("p_value", _norm_sf(z))
