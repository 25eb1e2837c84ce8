"""Bandwidth estimate and mean shift with bin seeding.

The bandwidth sample (at most ``n_samples`` rows, the operator's parameter) is
broadcast.  Mean shift keeps points, seeds, means and centres in tables: seeds
meet blocks of near points whose balls lie in their reach, and in a round each
walks as many steps as the points allow that a task may hold for it.  The
centres are an ordered independent set found in rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import euclidean
from tidemark.operators.cells import MATRIX, SLACK, in_chunks, balls, blocks, near_pairs
from tidemark.operators.clean import sample_n
from tidemark.operators.rank import global_rank
from tidemark.session import cut_lineage, cut_lineage_counted, cut_lineage_path, drop_table

PIECE = 1024      # seeds, means or balls of one side that a task compares
WALK = 1 << 21    # numbers in the points that a task holds for one seed
COPIES = 32       # times that a round hands out the points' numbers to the seeds, and
LEAST = 1 << 25   # the numbers that it may hand out in any case
WAYS = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.0)   # bandwidths that a seed may go in a round


def _matrix(pdf: pd.DataFrame, col: str = "vec") -> np.ndarray:
    return np.stack(pdf[col].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))


def _kth_distance(x: np.ndarray, r: np.ndarray, k: int, chunk: int) -> np.ndarray:
    """Distance of every row of ``x`` to its ``k``-th nearest of ``r``."""
    step, r2, out = min(chunk, max(1, MATRIX // len(r))), (r * r).sum(1), np.empty(len(x))
    for s in range(0, len(x), step):
        # |x - r|^2 by products: one piece of the matrix at a time
        xc = x[s:s + step]
        d2 = xc @ r.T
        d2 *= 2.0
        np.subtract((xc * xc).sum(1)[:, None] + r2[None, :], d2, out=d2)
        np.maximum(d2, 0.0, out=d2).partition(k - 1, axis=1)
        out[s:s + step] = np.sqrt(d2[:, k - 1])
    return out


def estimate_bandwidth(vectors: DataFrame, quantile: float = 0.2, n_samples: int = 50_000,
                       seed: int = 42, chunk: int = 256) -> float:
    """Mean distance from each sampled point to its k-th nearest
    sampled point (itself included), k = int(n_sample * quantile).

    The sample (P16, md5 order) is bounded by ``n_samples`` and broadcast;
    the per-point order statistic is computed by the tasks that hold the
    query points, and averaged by an aggregate.  ``chunk`` bounds the rows of
    a task's distance matrix, which never has more than about ``MATRIX`` cells.
    """
    # the sample comes out of one sorted partition: deal it over the tasks
    # that compute its distances
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    samp = cut_lineage(sample_n(vectors, "id", n_samples, seed).repartition(parts, "id"))
    sample_rows = samp.select("vec").collect()          # at most n_samples rows
    if not sample_rows:
        return float("nan")
    ref = np.stack([np.asarray(r["vec"], dtype=float) for r in sample_rows])
    m = len(ref)
    k = max(1, int(m * quantile))
    ref_b = vectors.sparkSession.sparkContext.broadcast(ref)

    def fn(it):
        for pdf in it:
            yield pd.DataFrame({"kd": _kth_distance(_matrix(pdf), ref_b.value, k, chunk)})

    kd = samp.select("vec").mapInPandas(fn, "kd double")
    return float(kd.agg(F.avg("kd")).first()[0])


def bin_seeds(vectors: DataFrame, bandwidth: float, min_bin_freq: int = 1) -> DataFrame:
    """C14 seeding: occupied grid cells of side ``bandwidth`` (point / bw
    rounded half to even, as NumPy rounds), cell centre = cell * bw."""
    cell = F.transform("vec", lambda x: F.bround(x / F.lit(bandwidth), 0))
    g = vectors.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("freq"))
    return g.filter(F.col("freq") >= min_bin_freq).select(
        F.transform("cell", lambda c: c * F.lit(bandwidth)).alias("seed"))


def _pieces(df: DataFrame, key: str, n: int, name: str, other: str, n_other: int) -> DataFrame:
    """``df`` dealt over its pieces (``name``), once for each piece of the
    other side (``other``)."""
    size = lambda m: max(1, math.ceil(m / PIECE))
    return (df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(size(n))).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(size(n_other) - 1)))))


def _reached(d: np.ndarray, radius: np.ndarray, bandwidth: float, way: float):
    """Which balls with centres at the distances ``d`` a seed's ball may reach
    while the seed is no farther than ``way`` from here, and which it holds
    altogether all the while."""
    return d * (1 - SLACK) - radius <= bandwidth + way, (d + radius) * (1 + SLACK) < bandwidth - way


def _rows_cut(bandwidth: float):
    """The points of the blocks that each seed's edge may cut on each of ``WAYS``."""
    def fn(seeds: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
        if seeds.empty or balls.empty:
            return pd.DataFrame({"sid": pd.Series([], dtype="int64"), "cut": pd.Series([], dtype="object")})
        radius, n, rows = balls["radius"].to_numpy(), balls["n"].to_numpy(), []
        for _, d in in_chunks(_matrix(seeds), _matrix(balls, "centre"), "euclidean"):
            each = (_reached(d, radius, bandwidth, w * bandwidth) for w in WAYS)
            rows.append(np.stack([(near & ~inside) @ n for near, inside in each], 1))
        return pd.DataFrame({"sid": seeds["sid"].to_numpy(), "cut": list(np.concatenate(rows))})
    return fn


def _ways(seeds: DataFrame, n_seeds: int, balls: DataFrame, n_balls: int, bandwidth: float,
          most_rows: int) -> DataFrame:
    """``seeds`` with the longest ``way`` on which no more than ``most_rows``
    points have to be looked at; NULL where even a single step has more."""
    left = _pieces(seeds.select("sid", "vec"), "sid", n_seeds, "x", "y", n_balls)
    right = _pieces(balls, "block", n_balls, "y", "x", n_seeds)
    cut = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(
        _rows_cut(bandwidth), "sid long, cut array<long>")
    total = cut.groupBy("sid").agg(*[F.sum(F.col("cut")[j]).alias(f"c{j}") for j in range(len(WAYS))])
    way = F.coalesce(*[F.when(F.col(f"c{j}") <= F.lit(most_rows), F.lit(w * bandwidth)) for j, w in enumerate(WAYS)])
    return seeds.join(total.select("sid", way.alias("way")), "sid")


def _touch(bandwidth: float):
    """A row for each block that a seed's ball may reach on its way, and
    whether it holds the block altogether."""
    def fn(seeds: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("sid", "sx", "sblock", "inside", "svec")}
        if len(seeds) and len(balls):
            centre, radius, block = _matrix(balls, "centre"), balls["radius"].to_numpy(), balls["block"].to_numpy()
            for sid, x, vec, way in zip(seeds["sid"], seeds["x"], seeds["vec"], seeds["way"], strict=True):
                d = np.sqrt(((centre - vec) ** 2).sum(1))
                near, inside = _reached(d, radius, bandwidth, way)
                near = np.flatnonzero(near)
                out["sid"] += [sid] * len(near)
                out["sx"] += [x] * len(near)
                out["sblock"] += block[near].tolist()
                out["inside"] += inside[near].tolist()
                out["svec"] += [vec] * len(near)
        return pd.DataFrame(out)
    return fn


def _touched(seeds: DataFrame, n_seeds: int, balls: DataFrame, n_balls: int, bandwidth: float) -> DataFrame:
    left = _pieces(seeds.select("sid", "vec", "way"), "sid", n_seeds, "x", "y", n_balls)
    right = _pieces(balls, "block", n_balls, "y", "x", n_seeds)
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(
        _touch(bandwidth), "sid long, sx int, sblock long, inside boolean, svec array<double>")


def _in_reach(bandwidth: float):
    """Sums of a block's points in reach of each seed; a block inside a
    seed's ball is summed once for all such seeds."""
    def fn(seeds: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(seeds) and len(points):
            x = _matrix(points)
            total = x.sum(0)
            for sid, inside, vec in zip(seeds["sid"], seeds["inside"], seeds["svec"], strict=True):
                if inside:
                    rows.append((sid, len(x), total))
                    continue
                near = ((x - vec) ** 2).sum(1) <= bandwidth * bandwidth
                if near.any():
                    rows.append((sid, int(near.sum()), x[near].sum(0)))
        return pd.DataFrame(rows, columns=["sid", "cnt", "total"])
    return fn


def _shifted(seeds: DataFrame, n_seeds: int, points: DataFrame, balls: DataFrame, n_balls: int,
             bandwidth: float, dims: int, max_iter: int) -> DataFrame:
    """``seeds`` after one step, whatever the number of points in their reach."""
    touch = _touched(seeds.withColumn("way", F.lit(0.0)), n_seeds, balls, n_balls, bandwidth)
    # a block meets its seeds in pieces
    at = points.withColumn("x", F.lit(0))
    if n_seeds > PIECE:
        at = points.join(touch.select(F.col("sblock").alias("block"), F.col("sx").alias("x")).distinct(), "block")
    sums = touch.groupBy("sblock", "sx").cogroup(at.groupBy("block", "x")).applyInPandas(
        _in_reach(bandwidth), "sid long, cnt long, total array<double>")
    total = sums.groupBy("sid").agg(F.sum("cnt").alias("cnt"), *[
        F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(dims)])
    mean = total.select("sid", "cnt", F.array(*[F.col(f"s{j}") / F.col("cnt") for j in range(dims)]).alias("mean"))
    return seeds.join(mean, "sid").select(
        "sid", F.col("mean").alias("vec"), "cnt", (F.col("steps") + 1).alias("steps"),
        ((euclidean("vec", "mean") > 1e-3 * bandwidth) & (F.col("steps") < max_iter)).alias("active"))


def _packed(points: DataFrame) -> DataFrame:
    """``(block, n, total, points)``: a block's points in one value."""
    def pack(p: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(p)
        return pd.DataFrame({"block": p["block"].iloc[:1], "n": [len(x)], "total": [x.sum(0)],
                             "points": [x.tobytes()]})
    return points.select("block", "vec").groupBy("block").applyInPandas(
        pack, "block long, n long, total array<double>, points binary")


def _walk(bandwidth: float, max_iter: int):
    """One seed's steps, until it converges or leaves its way."""
    near = bandwidth / 16

    def length(v):
        return np.sqrt((v * v).sum(-1))

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        start, way, steps = np.asarray(p["vec"].iloc[0], float), p["way"].iloc[0], int(p["steps"].iloc[0])
        inside = p["inside"].to_numpy(bool)
        whole, n_whole = sum(p["total"][inside], np.zeros(len(start))), int(p["n"][inside].sum())
        x = np.concatenate([np.zeros(0), *map(np.frombuffer, p["points"][~inside])]).reshape(-1, len(start))
        m, here, active, cnt = start, None, True, 0
        while active and length(m - start) <= way * (1 - 1e-6):
            if here is None or length(m - here) > near * (1 - 1e-6):
                # the points that every ball about here holds, and those that some hold
                here, d = m, length(x - m)
                held, some = d * (1 + SLACK) < bandwidth - near, d * (1 - SLACK) <= bandwidth + near
                total, n, edge = whole + x[held].sum(0), n_whole + int(held.sum()), x[some & ~held]
            mine = ((edge - m) ** 2).sum(1) <= bandwidth * bandwidth
            cnt = n + int(mine.sum())
            if not cnt:
                break
            mean = (total + edge[mine].sum(0)) / cnt
            active = bool(length(mean - m) > 1e-3 * bandwidth) and steps < max_iter
            m, steps = mean, steps + 1
        rows = [(p["sid"].iloc[0], m, cnt, steps, active)] if cnt else []
        return pd.DataFrame(rows, columns=["sid", "vec", "cnt", "steps", "active"])
    return fn


def _walked(seeds: DataFrame, n_seeds: int, packed: DataFrame, balls: DataFrame, n_balls: int,
            bandwidth: float, max_iter: int) -> DataFrame:
    """``seeds`` at the end of their ways; each meets the blocks that its
    ball's edge may cut on its way, and the sums of those that it holds."""
    touch = _touched(seeds, n_seeds, balls, n_balls, bandwidth).select("sid", F.col("sblock").alias("block"), "inside")
    met = touch.join(packed, "block").select("sid", "inside", "n", F.when(F.col("inside"), F.col("total")).alias("total"),
                                             F.when(~F.col("inside"), F.col("points")).alias("points"))
    # few bytes may stand for many steps: no merging of small partitions
    parts = max(1, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.join(seeds, "sid").repartition(parts, "sid").groupBy("sid").applyInPandas(
        _walk(bandwidth, max_iter), "sid long, vec array<double>, cnt long, steps long, active boolean")


def _least_near(bandwidth: float):
    """The smallest rank of the others' rows within the bandwidth."""
    def fn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            x, rank = _matrix(b, "rvec"), b["rrank"].to_numpy()
            for r, vec in zip(a["rank"], a["vec"], strict=True):
                near = np.sqrt(((x - vec) ** 2).sum(1)) <= bandwidth
                if near.any():
                    rows.append((r, rank[near].min()))
        return pd.DataFrame(rows, columns=["rank", "least"])
    return fn


def _absorb(means: DataFrame, n: int, bandwidth: float) -> DataFrame:
    """The means that stay when each, in the order of ``rank``, absorbs later
    ones within the bandwidth: ``(rank, vec, cnt)``.

    In every round the means without an earlier open one in reach stay, and
    those in reach of one that stays go.  Means meet by blocks of near ones,
    in pieces; no pair is written.
    """
    points, _ = blocks(means.withColumnRenamed("rank", "id"), PIECE, n_rows=n)
    points = points.withColumnRenamed("id", "rank")
    balls_ = cut_lineage(balls(points))
    pairs = near_pairs(balls_.withColumn("reach", F.lit(float(bandwidth))), balls_)
    same = balls_.select(F.col("block").alias("qb"), F.col("block").alias("rb"))
    pairs = cut_lineage(pairs.unionByName(same))
    open_, path = cut_lineage_path(points)
    stay = None

    def least(a: DataFrame, b: DataFrame) -> DataFrame:
        q = a.select("rank", "vec", F.col("block").alias("qb")).join(pairs, "qb")
        r = b.select(F.col("rank").alias("rrank"), F.col("vec").alias("rvec"), F.col("block").alias("rb")).join(
            pairs, "rb")
        found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(
            _least_near(bandwidth), "rank long, least long")
        return found.groupBy("rank").agg(F.min("least").alias("least"))

    while True:
        first = least(open_, open_).filter(F.col("least") == F.col("rank")).select("rank")
        first = cut_lineage(open_.join(first, "rank"))
        kept = first.select("rank", "vec", "cnt")
        stay = kept if stay is None else stay.unionByName(kept)
        gone = least(open_, first).select("rank")
        rest, new_path, seen = cut_lineage_counted(open_.join(gone, "rank", "left_anti"), n=F.count(F.lit(1)))
        drop_table(means.sparkSession, path)
        open_, path = rest, new_path
        if not seen["n"]:
            drop_table(means.sparkSession, path)
            return stay


def _nearest_centre(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    if q.empty or c.empty:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64"),
                             "label": pd.Series([], dtype="int32")})
    c = c.sort_values("label")
    centre, x = _matrix(c, "centre"), _matrix(q)
    step = max(1, MATRIX // centre.size)
    best = np.concatenate([((x[lo:lo + step, None, :] - centre[None]) ** 2).sum(-1).argmin(1)
                           for lo in range(0, len(x), step)])
    return pd.DataFrame({"id": q["id"].to_numpy(), "d": ((x - centre[best]) ** 2).sum(1),
                         "label": c["label"].to_numpy()[best]})


def mean_shift(vectors: DataFrame, bandwidth: float, max_iter: int = 300,
               min_bin_freq: int = 1, block_rows: int | None = None):
    """C14: flat-kernel mean shift from bin seeds.

    Each seed moves to the mean of the points within ``bandwidth`` until it
    moves at most 1e-3 * bandwidth or ``max_iter`` rounds pass.  Converged
    means, by descending (support, coordinates), absorb later means within
    the bandwidth; every point takes the label of its nearest centre.

    Points lie in blocks of near ones (``cells``): a seed takes the sums of the
    blocks that its ball holds whole, looks into those that its edge may cut,
    and skips all others.  In a round a seed gets the blocks for a way of some
    bandwidths and takes all steps on it; the way is as long as the limits on
    the points in a task and in a round allow.  Where not even one step's
    points fit, the blocks' tasks add up their shares of a single step.
    Seeds, means and centres are tables.

    Returns ``(labels(id, label), centres(label, centre, support))``.
    """
    spark = vectors.sparkSession
    first = vectors.select(F.size("vec").alias("n")).head()
    if first is None:
        empty = spark.createDataFrame([], "id long, label int")
        return empty, spark.createDataFrame([], "label int, centre array<double>, support long")
    dims = first["n"]
    # in few dimensions small blocks have small balls, and an edge cuts few points
    points, _ = blocks(vectors.select("id", "vec"), block_rows or min(2000, max(250, 32 * dims)))
    balls_, balls_path, of = cut_lineage_counted(balls(points), n=F.count(F.lit(1)), rows=F.sum("n"))
    seeds = bin_seeds(points, bandwidth, min_bin_freq).withColumnRenamed("seed", "vec")
    seeds, path, count = cut_lineage_counted(
        seeds.select(F.monotonically_increasing_id().alias("sid"), "vec", F.lit(0).cast("long").alias("cnt"),
                     F.lit(0).cast("long").alias("steps"), F.lit(True).alias("active")), active=F.count(F.lit(1)))
    packed = packed_path = None
    while count["active"]:
        most = min(WALK, max(COPIES * of["rows"] * dims, LEAST) // count["active"]) // dims
        now, now_path, of_now = cut_lineage_counted(
            _ways(seeds.filter("active").select("sid", "vec", "steps"), count["active"], balls_, of["n"], bandwidth, most),
            walks=F.count("way"), steps=F.count_if(F.col("way").isNull()))
        nxt = seeds.filter("NOT active")
        if of_now["walks"]:
            if packed is None:
                packed, packed_path = cut_lineage_path(_packed(points))
            nxt = nxt.unionByName(_walked(now.filter("way IS NOT NULL"), of_now["walks"], packed, balls_, of["n"],
                                          bandwidth, max_iter))
        if of_now["steps"]:
            nxt = nxt.unionByName(_shifted(now.filter("way IS NULL").drop("way"), of_now["steps"], points, balls_,
                                           of["n"], bandwidth, dims, max_iter))
        nxt, nxt_path, count = cut_lineage_counted(nxt, active=F.count_if(F.col("active")))
        drop_table(spark, now_path)
        drop_table(spark, path)
        seeds, path = nxt, nxt_path
    order = [(-F.col("cnt")).alias("__minus"), *[(-F.col("vec")[j]).alias(f"__v{j}") for j in range(dims)]]
    keyed = seeds.select("sid", "vec", "cnt", *order)
    ranked = global_rank(keyed, ["__minus", *[f"__v{j}" for j in range(dims)], "sid"], "rank").select(
        "rank", "vec", "cnt")
    stay = cut_lineage(_absorb(ranked, ranked.count(), bandwidth))
    centres = cut_lineage(global_rank(stay, ["rank"], "label").select(
        F.col("label").cast("int").alias("label"), F.col("vec").alias("centre"), F.col("cnt").alias("support")))
    n_centres = centres.count()

    # centres that may be the nearest of a point of each block
    left = _pieces(balls_.select("block", "centre", "radius"), "block", of["n"], "x", "y", n_centres)
    right = _pieces(centres.select("label", F.col("centre").alias("place")), "label", n_centres, "y", "x", of["n"])

    def bound(b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if b.empty or c.empty:
            return pd.DataFrame({"block": pd.Series([], dtype="int64"), "far": pd.Series([], dtype="float64")})
        d = np.concatenate([m for _, m in in_chunks(_matrix(b, "centre"), _matrix(c, "place"), "euclidean")])
        return pd.DataFrame({"block": b["block"].to_numpy(), "far": d.min(1) + b["radius"].to_numpy()})

    far = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(
        bound, "block long, far double").groupBy("block").agg(F.min("far").alias("far"))

    def near(b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if b.empty or c.empty:
            return pd.DataFrame({"cblock": pd.Series([], dtype="int64"), "label": pd.Series([], dtype="int32"),
                                 "centre": pd.Series([], dtype="object")})
        place = _matrix(c, "place")
        d = np.concatenate([m for _, m in in_chunks(_matrix(b, "centre"), place, "euclidean")])
        i, j = np.nonzero(d * (1 - SLACK) - b["radius"].to_numpy()[:, None]
                          <= b["far"].to_numpy()[:, None] * (1 + SLACK))
        return pd.DataFrame({"cblock": b["block"].to_numpy()[i], "label": c["label"].to_numpy()[j],
                             "centre": list(place[j])})

    some = left.join(far, "block").groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(
        near, "cblock long, label int, centre array<double>")
    found = points.groupBy("block").cogroup(some.groupBy("cblock")).applyInPandas(
        _nearest_centre, "id long, d double, label int")
    labels = cut_lineage(found.select("id", "label"))
    for old in (path, balls_path, packed_path):
        drop_table(spark, old)
    return labels, centres


def standardise_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Per-dimension z-score (population std, constant -> 0) of an array column."""
    st = vectors.agg(*[e for j in range(dims) for e in (
        F.avg(F.col("vec")[j]).alias(f"m{j}"), F.stddev_pop(F.col("vec")[j]).alias(f"s{j}"))])
    j_ = vectors.crossJoin(F.broadcast(st))
    z = F.array(*[F.when(F.col(f"s{j}") > 0, (F.col("vec")[j] - F.col(f"m{j}")) / F.col(f"s{j}"))
                  .otherwise(F.lit(0.0)) for j in range(dims)])
    return j_.select("id", z.alias("vec"))
