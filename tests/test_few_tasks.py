"""Tables of rounds are written by few tasks, whatever the number of partitions (F1)."""

import glob

from tidemark.operators import graph
from tidemark.operators._util import ROWS_OF_TASK, in_few


def test_rounds_write_few_files(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(old, ("40", "false")):
        spark.conf.set(c, v)
    try:
        ids = spark.range(120)
        edges = ids.filter("id % 10 > 0").selectExpr("id AS src", "id - 1 AS dst")
        tables: list[str] = []
        got = {r.id: r.component for r in graph.connected_components(ids, edges, owned_tables=tables).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == {i: i - i % 10 for i in range(120)}
    assert len(glob.glob(tables[0].removeprefix("file:") + "/part-*")) <= 2


def test_tasks_follow_the_rows(spark):
    wide = spark.range(100).repartition(30)
    assert in_few(wide, 10).rdd.getNumPartitions() == 2
    assert in_few(wide, 5 * ROWS_OF_TASK).rdd.getNumPartitions() == 6
    assert in_few(wide, 100 * ROWS_OF_TASK).rdd.getNumPartitions() == 30
