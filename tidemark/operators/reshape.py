"""Wide panel <-> long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import slice_rows


def panel_columns(prefix: str, years: Sequence[int], tides: Sequence[str]) -> list[str]:
    return [f"{prefix}{y}{t}" for y in years for t in tides]


def to_series(df: DataFrame, id_cols: Sequence[str], years: Sequence[int],
              tides: Sequence[str] = ("H", "L"), prefix: str = "NDVI_",
              value_col: str = "value") -> DataFrame:
    """Wide ``{prefix}{year}{tide}`` columns -> rows (id, year, tide, value).

    NULL cells are kept as rows with a NULL value.
    """
    cols = [c for c in panel_columns(prefix, years, tides) if c in df.columns]
    long = df.unpivot(list(id_cols), cols, "__name", value_col)
    pat = rf"^{prefix}(\d+)([A-Za-z]+)$"
    return long.select(*id_cols,
                       F.regexp_extract("__name", pat, 1).cast("long").alias("year"),
                       F.regexp_extract("__name", pat, 2).alias("tide"),
                       F.col(value_col).cast("double").alias(value_col))


def yearly_trend(df: DataFrame, id_col: str, years: Sequence[int],
                 tides: Sequence[str] = ("H", "L"), prefix: str = "NDVI_",
                 ids: DataFrame | None = None) -> DataFrame:
    """Per point and year, the NULL-skipping mean over tides.

    ``ids`` (a one-column table, e.g. the erosion points) restricts the
    points with a semi join before the unpivot.
    """
    if ids is not None:
        df = df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col,
                     "left_semi")
    s = to_series(df, [id_col], years, tides, prefix)
    return s.groupBy(id_col, "year").agg(F.avg("value").alias("mean_value"))


def heat_matrix(df: DataFrame, id_col: str, order_by: Sequence[str], start: int, n: int,
                years: Sequence[int], tide: str, prefix: str = "NDVI_") -> DataFrame:
    """A slice of points x years of one tide, columns renamed to the year."""
    part = slice_rows(df, order_by, start, n)
    return part.select(F.col(id_col),
                       *[F.col(f"{prefix}{y}{tide}").alias(f"y{y}") for y in years
                         if f"{prefix}{y}{tide}" in df.columns])


def series_with_forecast(df: DataFrame, id_cols: Sequence[str], years: Sequence[int],
                         tide: str, pred_col: str, forecast_year: int,
                         prefix: str = "NDVI_") -> DataFrame:
    """Actual series of one tide plus the prediction as an extra point
    at ``forecast_year``, flagged ``is_predicted``."""
    actual = to_series(df, id_cols, years, [tide], prefix).withColumn(
        "is_predicted", F.lit(False))
    pred = df.select(*id_cols, F.lit(int(forecast_year)).cast("long").alias("year"),
                     F.lit(tide).alias("tide"), F.col(pred_col).cast("double").alias("value"),
                     F.lit(True).alias("is_predicted"))
    return actual.unionByName(pred)
