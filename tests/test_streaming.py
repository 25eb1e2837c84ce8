"""Incremental roll-up: two runs on one stream checkpoint merge their days."""

import datetime as dt
import os
import tempfile

from pyspark.sql import types as T

from tidemark.streaming import daily_extremes_stream, run_to_table

SCHEMA = T.StructType([T.StructField("station", T.StringType()),
                       T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("level", T.DoubleType())])


def test_second_run_merges_updated_and_new_days(spark):
    base = tempfile.mkdtemp()
    src = os.path.join(base, "in")
    d1 = dt.datetime(2024, 1, 1, 6)
    spark.createDataFrame([("A", d1, 1.0), ("A", d1.replace(hour=9), 3.0), ("B", d1, 5.0)],
                          SCHEMA).coalesce(1).write.parquet(os.path.join(src, "f1"))
    table, state = os.path.join(base, "table"), os.path.join(base, "state")

    def run():
        s = daily_extremes_stream(spark, os.path.join(src, "*"), SCHEMA, ["station"], "ts", "level")
        run_to_table(s, table, state, ["station"])
        return {(r.station, str(r.date)): (r.daily_min, r.daily_max)
                for r in spark.read.parquet(table).collect()}

    assert run() == {("A", "2024-01-01"): (1.0, 3.0), ("B", "2024-01-01"): (5.0, 5.0)}
    spark.createDataFrame([("A", d1.replace(hour=12), 0.5), ("A", dt.datetime(2024, 1, 2, 1), 7.0)],
                          SCHEMA).coalesce(1).write.parquet(os.path.join(src, "f2"))
    assert run() == {("A", "2024-01-01"): (0.5, 3.0), ("B", "2024-01-01"): (5.0, 5.0),
                     ("A", "2024-01-02"): (7.0, 7.0)}
