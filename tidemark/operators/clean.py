"""Projections, fills, predicates and row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import all_not_null, md5_below, md5_key, row_mean
from tidemark.operators._util import numeric_columns
from tidemark.operators.rank import global_rank


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns (absent names are ignored)."""
    return df.drop(*cols)


def keep_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the numeric columns only."""
    return df.select(*numeric_columns(df, exclude))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL -> constant per column."""
    return df.fillna(dict(values))


def blank_to(df: DataFrame, col: str, value: str) -> DataFrame:
    """NULL or empty string -> ``value`` (NULL sediment = water)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c.isNull() | (c == ""), F.lit(value)).otherwise(c))


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> mean of the column over all rows.

    One aggregate computes every mean (a single one-row result, so the
    cross join is a broadcast of one row).  A column that is NULL on every
    row stays NULL; names missing from ``df`` are skipped.  Integral columns
    become double, so that the mean is not cut.
    """
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c in df.columns]
    if not cols:
        return df
    means = df.agg(*[F.avg(c).alias(f"__mean_{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(means))
    out = []
    for name in df.columns:
        if name in cols:
            i = cols.index(name)
            typ = df.schema[name].dataType
            if isinstance(typ, T.IntegralType):  # a mean of whole numbers is none
                typ = T.DoubleType()
            out.append(F.coalesce(F.col(name).cast(typ), F.col(f"__mean_{i}").cast(typ))
                       .alias(name))
        else:
            out.append(F.col(name))
    return j.select(*out)


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is present."""
    return df.filter(all_not_null(subset))


def with_row_mean(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """P5: NULL-skipping mean across columns."""
    return df.withColumn(out, row_mean(cols))


def with_change(df: DataFrame, first: Sequence[str], last: Sequence[str],
                out: str = "change") -> DataFrame:
    """mean(last columns) - mean(first columns), NULL-skipping."""
    return df.withColumn(out, row_mean(last) - row_mean(first))


def detect_erosion(df: DataFrame, first: Sequence[str], last: Sequence[str],
                   threshold: float = -0.3, out: str = "change") -> DataFrame:
    """Points whose change is strictly below ``threshold``.

    A point without a change value (NULL) is not erosion.
    """
    return with_change(df, first, last, out).filter(F.col(out) < F.lit(threshold))


def map_labels(df: DataFrame, col: str, mapping: Mapping[int, str], out: str) -> DataFrame:
    """Integer code -> name; unmapped codes give NULL."""
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(int(k)), F.lit(v))])
    return df.withColumn(out, m[F.col(col).cast("int")])


def residual(actual: str, predicted: str) -> Column:
    """Absolute difference."""
    return F.abs(F.col(actual) - F.col(predicted))


def direction(actual: str, predicted: str, tide: str) -> Column:
    """P10: erosion / accretion of a scored point.

    High tide: actual above the prediction is erosion, below accretion.
    Low tide: the reverse.  Equal (or NULL) gives NULL.
    """
    a, p = F.col(actual), F.col(predicted)
    up, down = ("erosion", "accretion") if tide.upper().startswith("H") else ("accretion", "erosion")
    return F.when(a > p, F.lit(up)).when(a < p, F.lit(down))


def severity(col: str, threshold: float) -> Column:
    """P11: 'important' above the threshold, 'other' at or below, NULL for NULL."""
    c = F.col(col)
    return F.when(c > F.lit(threshold), F.lit("important")).when(c <= F.lit(threshold),
                                                                 F.lit("other"))


def slice_rows(df: DataFrame, order_by: Sequence[str], start: int, n: int) -> DataFrame:
    """Rows ``start .. start+n-1`` in ``order_by`` order (a top-k)."""
    return df.orderBy(*order_by).offset(start).limit(n) if start else df.orderBy(*order_by).limit(n)


def every_nth(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Rows at positions 0, n, 2n, ... of ``order_by`` order (global
    rank computed without a single-task window)."""
    ranked = global_rank(df, order_by, "__pos")
    return ranked.filter(F.col("__pos") % n == 0).drop("__pos")


def distinct_on(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row (by ``order_by``) of every distinct key.

    A min over a struct led by the ordering columns: a partial aggregate
    per task, so a key holding a third of the rows is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order_by, *[c for c in rest if c not in order_by]]
    packed = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(ordered)])
    g = df.groupBy(*keys).agg(F.min(packed).alias("__row"))
    return g.select(*[F.col(k) for k in keys],
                    *[F.col(f"__row.__{ordered.index(c)}").alias(c) for c in rest]).select(*df.columns)


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of rows, stable per id (md5 rule)."""
    return df.filter(md5_below(id_col, seed, fraction))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42,
             prefilter: bool = True) -> DataFrame:
    """``n`` rows without replacement: the ``n`` smallest md5 keys.
    Rows with a NULL id have no key and are never drawn.

    With ``prefilter`` the table is first cut by an md5 threshold sized to
    keep about 4n rows (one count job), so the final top-k sorts a bounded
    candidate set; it is retried without the cut if too few survive.
    """
    key = md5_key(id_col, seed)
    df = df.filter(F.col(id_col).isNotNull())
    cand = df
    if prefilter:
        total = df.count()
        frac = min(1.0, 4.0 * n / max(total, 1) + 1e-9)
        if frac < 1.0:
            cand = df.filter(md5_below(id_col, seed, frac))
            if cand.count() < n:
                cand = df
    return cand.withColumn("__k", key).orderBy("__k", id_col).limit(n).drop("__k")


def points_by_id(df: DataFrame, id_col: str, ids) -> DataFrame:
    """Rows whose id is listed (a list) or present in an id table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(),
                       id_col, "left_semi")
    return df.filter(F.col(id_col).isin(list(ids)))
