"""Readers and writers.

All readers take an explicit schema: no types are inferred, so a read is one
scan with column pruning and filter push-down.  CSV columns are found by the
names in the header line, whatever their order; only that line is read first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import nan_to_null


def without_nan(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL: missing values stay missing (Spark orders
    NaN above every number and ``avg`` would propagate it)."""
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    return df.select(*[nan_to_null(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (``{sf_dir}/{name}.parquet``)."""
    return without_nan(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One CSV source with a header line, its columns matched by name.

    The read schema follows the header (columns that ``schema`` lacks are
    read as strings and left out); a file of another header fails the read.
    """
    header = spark.read.option("header", True).csv(path).columns  # the header line only
    known = {f.name: f for f in schema.fields}
    missing = [n for n in known if n not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    in_file = T.StructType([T.StructField(h, known[h].dataType if h in known else T.StringType())
                            for h in header])
    return (spark.read.schema(in_file).option("header", True).option("enforceSchema", False)
            .option("nullValue", "").option("mode", "PERMISSIVE").csv(path)
            .select(*[F.col(f"`{n}`") for n in schema.names]))


def _csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reduce(DataFrame.unionByName, [_csv_by_name(spark, p, schema) for p in paths])


def read_table(spark: SparkSession, path: str | Sequence[str],
               schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A table from CSV (header line, columns by name, empty field =
    NULL) or parquet; floating NaN becomes NULL.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV needs an explicit schema (no inference)")
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        return without_nan(_csv(spark, path, schema))
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return without_nan(r.format(fmt).load(path))


def read_sensor(spark: SparkSession, paths: str | Sequence[str],
                schema: T.StructType, time_col: str = "time",
                units_marker: str = "UTC",
                timestamp_format: str | None = None) -> DataFrame:
    """Sensor CSV whose second physical line holds units.

    Every column is read as a string, the units row (``time == 'UTC'``) is
    dropped by content (so it is split-safe: no reliance on line position
    within a file split), then values are converted with the ``try_`` forms
    so a malformed field becomes NULL instead of failing the job.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True)
                            for f in schema.fields])
    raw = _csv(spark, paths, as_text)
    raw = raw.filter(F.col(time_col).isNull()
                     | (F.trim(F.col(time_col)) != F.lit(units_marker)))
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(nan_to_null(c.try_cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(c.alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            ts = (F.try_to_timestamp(c, F.lit(timestamp_format))
                  if timestamp_format else F.try_to_timestamp(c))
            out.append(ts.cast(f.dataType).alias(f.name))
        else:
            out.append(c.try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def union_sources(dfs: Iterable[DataFrame]) -> DataFrame:
    """S3: UNION ALL by name; missing columns become NULL, duplicates stay."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_sources needs at least one input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write a table (CSV gets a header line; no index column)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str) -> None:
    """The feature-matrix cache as parquet ``(id, array<double>)``."""
    (df.select(F.col(id_col),
               F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias(vec_col))
     .write.mode("overwrite").parquet(path))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in an explicit order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)
