"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL (Spark orders NaN above every number and ``avg``
    propagates it, whereas the panel semantics treat it as missing)."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def row_mean(cols: Sequence[str | Column]) -> Column:
    """P5: mean across columns skipping NULLs; all NULL gives NULL."""
    cs = [col_of(c).cast("double") for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    n = reduce(lambda a, b: a + b,
               [F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1)) for c in cs])
    return F.try_divide(total, F.when(n > 0, n.cast("double")))


def all_not_null(cols: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a & b, [col_of(c).isNotNull() for c in cols])


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL (not an ANSI error)
    for constant inputs, a single pair, or no pairs."""
    a, b = col_of(a).cast("double"), col_of(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    sa = F.stddev_pop(F.when(both, a))
    sb = F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), F.when((sa > 0) & (sb > 0), sa * sb))


def pair_count(a: str | Column, b: str | Column) -> Column:
    return F.count(F.when(col_of(a).isNotNull() & col_of(b).isNotNull(), 1))


def euclidean(u: str | Column, v: str | Column) -> Column:
    """Euclidean distance of two equal-length ``array<double>`` columns."""
    diff2 = F.zip_with(col_of(u), col_of(v), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff2, F.lit(0.0), lambda acc, x: acc + x))


def md5_threshold(fraction: float) -> str:
    """The 8-hex-digit prefix below which ``fraction`` of md5 keys fall."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    return format(min(int(fraction * 16 ** 8), 16 ** 8 - 1), "08x") if fraction < 1 else "g"


def md5_below(id_col: str | Column, seed: int, fraction: float) -> Column:
    """A stable pseudo-random row filter keeping about ``fraction`` of rows.

    It is a function of the row id and the seed only, so it survives
    repartitioning and task retries, and DuckDB repeats it exactly:
    ``md5(id || '-' || seed) < threshold`` as strings.
    """
    return md5_key(id_col, seed) < F.lit(md5_threshold(fraction))


def md5_key(id_col: str | Column, seed: int) -> Column:
    """Hex md5 of ``id || '-' || seed``: an ordering key for samples."""
    return F.md5(F.concat(col_of(id_col).cast("string"), F.lit(f"-{seed}")))
