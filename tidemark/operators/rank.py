"""Distributed global ranks and exact quantiles.

Neither puts a whole table or group into one task:

* ``global_rank`` range-partitions by the ordering key, checkpoints the
  result so every later job sees the same partitions, counts rows per
  partition (one row per partition reaches the driver) and adds the
  preceding partitions' total to each row's position inside its partition.
* ``column_quantiles`` selects order statistics by repeated histogram
  passes that narrow a value interval around each wanted rank until it
  holds one value, at any table size; the driver sees bucket counts only.
  All columns and ranks share a pass, so there are as many passes as the
  slowest of them needs, whatever the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def global_rank(df: DataFrame, order_by: Sequence[str], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_by`` order.

    ``order_by`` must identify rows (end it with a unique id) for the
    result to be deterministic.
    """
    spark = df.sparkSession
    n_parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (df.repartitionByRange(n_parts, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    counts = {r["__pid"]: r["n"] for r in
              ranged.groupBy("__pid").agg(F.count("*").alias("n")).collect()}
    offsets, acc = {}, 0
    for pid in sorted(counts):
        offsets[pid] = acc
        acc += counts[pid]
    off_map = F.create_map(*[x for pid, o in offsets.items() for x in (F.lit(pid), F.lit(o))]) \
        if offsets else F.lit(None).cast("map<int,bigint>")
    # position inside the partition = id minus the partition's first id
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ranged.withColumn(rank_col, (off_map[F.col("__pid")] + local).cast("long"))
            .drop("__pid", "__mid"))


# Bucket rows that one pass may hand to the driver, all open intervals together.
PASS_CELLS = 65_536


def _order_statistics(vals: DataFrame, state: dict, buckets: int) -> dict:
    """Exact values at ranks of the columns ``v0``, ``v1``, ... of ``vals``.

    ``state`` maps (column place, 0-based rank) to (lo, hi, rows below lo) with
    lo <= value <= hi, both values of the column.  Each pass groups the rows of
    every still-open interval into equal-width buckets (count, min, max per
    bucket: a bounded result, all columns and intervals in one job) and goes on
    with the bucket that holds the wanted rank.  An interval's ends are values
    of the table, so it always falls into two buckets or more, and the passes
    end.
    """
    state = dict(state)
    while True:
        spans = sorted({(c, *s_) for (c, _), s_ in state.items() if s_[0] < s_[1]})
        if not spans:
            return {k: s_[0] for k, s_ in state.items()}
        cells = min(buckets, max(16, PASS_CELLS // len(spans)))
        cases: dict[int, list] = {}
        for i, (c, lo, hi, _) in enumerate(spans):
            v = F.col(f"v{c}")
            width, middle = (hi - lo) / cells, lo / 2 + hi / 2
            at = (F.least(F.floor((v - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(cells - 1))
                  if width > 0 and math.isfinite(width)
                  else ((v > middle) if lo <= middle < hi else (v >= hi)).cast("long"))
            cases.setdefault(c, []).append(((v >= lo) & (v <= hi), F.lit(i), at))
        each = []
        for c, spans_of in cases.items():
            g = b = F
            for inside, place, at in spans_of:
                g, b = g.when(inside, place), b.when(inside, at)
            each.append(F.struct(g.alias("g"), b.alias("b"), F.col(f"v{c}").alias("v")))
        hist: dict[int, list] = {}
        for h in (vals.select(F.inline(F.array(*each))).filter("g IS NOT NULL")
                  .groupBy("g", "b").agg(F.count("*").alias("c"), F.min("v").alias("mn"),
                                         F.max("v").alias("mx")).collect()):
            hist.setdefault(h["g"], []).append(h)
        for i, (c, *span) in enumerate(spans):
            rows = sorted(hist[i], key=lambda h: h["mn"])
            for key in [k for k, s_ in state.items() if k[0] == c and s_ == tuple(span)]:
                acc = span[2]
                for h in rows:
                    if key[1] < acc + h["c"]:
                        state[key] = (h["mn"], h["mx"], acc)
                        break
                    acc += h["c"]


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int],
                     buckets: int = 4096) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of the values of ``col`` that are
    neither NULL nor NaN; None without any."""
    vals = df.select(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")).alias("v0"))
    st = vals.agg(F.min("v0").alias("lo"), F.max("v0").alias("hi"), F.count("v0").alias("n")).first()
    if st["n"] == 0:
        return {int(r): None for r in ranks}
    found = _order_statistics(vals, {(0, int(r)): (st["lo"], st["hi"], 0) for r in ranks}, buckets)
    return {r: v for (_, r), v in found.items()}


def column_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]],
                     buckets: int = 4096) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles (position ``(n-1)q`` among the values
    that are neither NULL nor NaN), exact, for every column of ``wanted``; None
    for a column without values.

    The value columns are persisted (memory, spilling to disk) for the few
    passes, so the input plan runs once.
    """
    from pyspark import StorageLevel
    cols = list(wanted)
    if not cols:
        return {}
    null = F.lit(None).cast("double")
    vals = df.select(*[F.nanvl(F.col(c).cast("double"), null).alias(f"v{i}")
                       for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = vals.agg(*[e.alias(f"{n}{i}") for i in range(len(cols)) for n, e in (
            ("lo", F.min(f"v{i}")), ("hi", F.max(f"v{i}")), ("n", F.count(f"v{i}")))]).first()
        need, state = {}, {}
        for i, c in enumerate(cols):
            for q in wanted[c] if st[f"n{i}"] else ():
                pos = (st[f"n{i}"] - 1) * q
                need[i, q] = (math.floor(pos), math.ceil(pos), pos - math.floor(pos))
                state.update({(i, r): (st[f"lo{i}"], st[f"hi{i}"], 0) for r in need[i, q][:2]})
        found = _order_statistics(vals, state, buckets)
    finally:
        vals.unpersist()
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(wanted[c]) for c in cols}
    for (i, q), (lo, hi, part) in need.items():
        low, high = found[i, lo], found[i, hi]
        out[cols[i]][q] = low + part * (high - low) if part else low
    return out


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], **kw) -> dict[float, float | None]:
    """``column_quantiles`` of one column."""
    return column_quantiles(df, {col: qs}, **kw)[col]
