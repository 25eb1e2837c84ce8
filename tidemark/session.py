"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC calendar, AQE for runtime re-planning
# (partition coalescing, skew-join splitting), Arrow for pandas batches.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "tidemark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library defaults.

    On a cluster ``master`` stays ``None`` and the cluster's own settings
    win for everything not listed in ``DEFAULT_CONF``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used.  Only a local session without it (a test) gets a fresh
    folder of its own: on a cluster a machine's own folder would be read by
    one executor only, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# paths of tables written by the operators now running, innermost last
_OPEN_JOBS: list[list[str]] = []


def cut_lineage(df):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and continue from the written files.

    Like a reliable checkpoint it survives executor loss and keeps lineage
    one step deep; in addition the optimizer's size estimate restarts from
    the real file size (a checkpoint keeps the estimate of the plan it
    replaced, which iterative joins multiply round after round).
    """
    return cut_lineage_path(df)[0]


def cut_lineage_path(df):
    """``cut_lineage`` that also returns the table's folder, so an
    iterative job can drop a round's table once the next one is written."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tidemark-tables/{uuid.uuid4().hex}"
    if _OPEN_JOBS:
        _OPEN_JOBS[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def cut_lineage_counted(df, **figures):
    """``cut_lineage_path`` that also returns the values of aggregate columns
    over the written rows, taken while they are written."""
    from pyspark.sql import Observation
    seen = Observation()
    table, path = cut_lineage_path(df.observe(seen, *[c.alias(n) for n, c in figures.items()]))
    return table, path, seen.get


def leaves_one_table(operator):
    """Decorator for an operator whose first argument and result are
    DataFrames: the result is written, and every other table that the
    operator wrote on the way is deleted."""
    @functools.wraps(operator)
    def run(df, *args, **kwargs):
        spark = df.sparkSession
        written: list[str] = []
        _OPEN_JOBS.append(written)
        try:
            out, path = cut_lineage_path(operator(df, *args, **kwargs))
        except BaseException:
            path = None
            raise
        finally:
            _OPEN_JOBS.pop()
            for p in written:
                if p != path:
                    drop_table(spark, p)
        if _OPEN_JOBS:  # the result is one of the enclosing operator's tables
            _OPEN_JOBS[-1].append(path)
        return out
    return run


def drop_table(spark, path: str | None) -> None:
    """Delete a folder written by ``cut_lineage_path`` (no-op for None)."""
    if not path:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
