"""k-nearest-neighbour graph.

The exact graph is a join of blocks of near points (``cells``): a point is
first compared with its own block, which bounds the distance of its k-th
neighbour, then with the blocks that the triangle inequality leaves within
that bound.  Blocks meet in tiles (``cells.tiled``): a ``cogroup`` task holds
two tiles of bounded size, goes through their pairs of blocks in NumPy chunks,
nearest first, and lowers the bounds as it finds neighbours.  Where points lie
in clusters or in few dimensions most pairs of blocks are never looked at;
points without any structure in many dimensions are all compared, as every
exact method must.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cells
from tidemark.operators.cells import METRICS, distances
from tidemark.session import cut_lineage, leaves_one_table

EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType(), False),
    T.StructField("dst", T.LongType(), False),
    T.StructField("dist", T.DoubleType(), False),
])


def as_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>) with NULL vectors dropped."""
    return df.select(F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias("vec")) \
        .filter(F.col("vec").isNotNull())


def _near_rows(rough: cells.Rough | cells.RoughSums, lo: int, qv, rv, rid, bound, kk: int, metric: str):
    """Places in ``q`` and ``r`` and distances of the ``kk`` nearest of a piece
    of ``q``: rough distances leave a few candidates a row, whose exact distances
    decide (ties by the lower id)."""
    d, own, wrong = rough.parts(lo, lo + max(1, cells.MATRIX // max(1, len(rid))))
    cut = rough.above(rough.limits(bound[lo:lo + len(d)] * (1 + 2 * cells.SLACK)) + wrong - own, d.dtype)
    at, to = np.divmod(np.flatnonzero(d <= cut[:, None]), d.shape[1])
    many = np.flatnonzero(np.bincount(at, minlength=len(d)) > 4 * kk)     # the bound leaves too many
    if kk < len(rid) and len(many):
        kth = np.partition(d[many], kk - 1, axis=1)[:, kk - 1]
        cut[many] = np.minimum(cut[many], rough.above(kth + 2.0 * wrong[many], d.dtype))
        close = d[at, to] <= cut[at]
        at, to = at[close], to[close]
    if d.dtype != np.float64 and len(at) > 8 * kk * len(d):      # too coarse for these points
        return None
    at = at + lo
    dist = cells.pair_distances(qv, rv, at, to, metric)
    near = dist <= bound[at] * (1 + cells.SLACK)
    at, to, dist = at[near], to[near], dist[near]
    order = np.lexsort((rid[to], dist, at))
    at, to, dist = at[order], to[order], dist[order]
    place = _places(at)
    return at[place < kk], to[place < kk], dist[place < kk]


def _places(at: np.ndarray) -> np.ndarray:
    """Place of each entry among the equal ones of a sorted array."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][:len(at)])
    return np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))


def _topk(qid, qv, bound, names, rv, k: int, metric: str, chunk: int = 32, order=None) -> pd.DataFrame:
    """The ``k`` nearest of ``r`` for every row of ``q``, no farther than its
    ``bound``, row by row; ties by the lower ``order``, that of ``names``
    unless given."""
    rid = names if order is None else order
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    kk = min(k, len(rid))
    kinds = {"euclidean": (lambda: cells.Rough(qv, rv, np.float32), lambda: cells.Rough(qv, rv)),
             "manhattan": (lambda: cells.RoughSums(qv, rv),)}
    for kind in kinds.get(metric, ()) if kk and len(qid) else ():
        rough = kind()
        found = []
        for lo in range(0, len(qid) if rough.finite else 0, max(1, cells.MATRIX // len(rid))):
            found.append(_near_rows(rough, lo, qv, rv, rid, bound, kk, metric))
            if found[-1] is None:
                break
        if found and found[-1] is not None:
            at, to, dist = (np.concatenate(x) for x in zip(*found, strict=True))
            return pd.DataFrame({"src": qid[at], "dst": names[to], "dist": dist})
    srcs, dsts, dists = [[x] for x in none]
    for s in range(0, len(qid) if kk else 0, chunk):
        d = distances(qv[s:s + chunk], rv, metric)
        # order by (distance, id): lexsort on the id then the distance
        for i in range(d.shape[0]):
            row = d[i]
            cut = bound[s + i] * (1 + cells.SLACK)
            if kk < len(row):
                part = np.argpartition(row, kk - 1)[:kk]
                cut = min(cut, row[part].max())
            cand = np.nonzero(row <= cut)[0]     # keep ties at the cut
            sel = cand[np.lexsort((rid[cand], row[cand]))[:kk]]
            srcs.append(np.full(len(sel), qid[s + i], dtype=np.int64))
            dsts.append(names[sel])
            dists.append(row[sel])
    return pd.DataFrame({"src": np.concatenate(srcs), "dst": np.concatenate(dsts),
                         "dist": np.concatenate(dists)})


def _pair_topk(k: int, metric: str = "euclidean"):
    """``_topk`` of rows ``(id, vec)``, those of ``q`` perhaps with a ``bound``."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        qv, rv = (np.stack(x["vec"].to_numpy()).astype(float) if len(x) else np.zeros((0, 0)) for x in (q, r))
        bound = q["bound"].to_numpy(dtype=float) if "bound" in q else np.full(len(q), np.inf)
        return _topk(q["id"].to_numpy(dtype=np.int64), qv, bound, r["id"].to_numpy(dtype=np.int64), rv, k, metric)
    return fn


def _tile_topk(k: int, metric: str):
    """The ``k`` nearest of a tile of ``r`` for the rows of a tile of ``q``,
    from other blocks than their own and no farther than their ``bound``."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        src, dst, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(q) and len(r):
            qv, rv = (np.stack(x.to_numpy()).astype(float) for x in (q["vec"], r["rvec"]))
            qid, rid, rb = (x.to_numpy(dtype=np.int64) for x in (q["id"], r["rid"], r["rb"]))
            bound = q["bound"].fillna(np.inf).to_numpy(dtype=float, copy=True)
            best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
            for mine, theirs in cells.meetings(q["qb"].to_numpy(), qv, bound, rb, rv, metric):
                new = _topk(np.arange(len(mine)), qv[mine], bound[mine], np.arange(len(theirs)), rv[theirs], k, metric,
                            order=rid[theirs])
                at, to, d = (new[c].to_numpy() for c in ("src", "dst", "dist"))
                rows, place = np.unique(at), _places(at)
                if not len(rows):
                    continue
                more, ids = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1, np.int64)
                line = np.searchsorted(rows, at)
                more[line, place], ids[line, place] = d, rid[theirs[to]]
                rows = mine[rows]
                more, ids = np.concatenate([best[rows], more], 1), np.concatenate([who[rows], ids], 1)
                first = np.lexsort((ids, more, ids < 0))[:, :k]     # empty places last
                best[rows], who[rows] = np.take_along_axis(more, first, 1), np.take_along_axis(ids, first, 1)
                full = rows[who[rows, k - 1] >= 0]
                bound[full] = np.minimum(bound[full], best[full, k - 1])
            at, place = np.nonzero(who >= 0)
            src, dst, dist = qid[at], who[at, place], best[at, place]
        return pd.DataFrame({"src": src, "dst": dst, "dist": dist})
    return fn


def _nearest(partial: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each point's partial lists, with their ranks."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def block_pairs(points: DataFrame, own: DataFrame, k: int, metric: str) -> DataFrame:
    """``(qb, rb)``: other blocks that may hold one of the ``k`` nearest of a
    point of ``qb``; ``own`` are the lists found in the points' own blocks."""
    bounds = (own.groupBy("src").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("n"))
              .select(F.col("src").alias("id"), F.when(F.col("n") == k, F.col("d")).alias("bound")))
    reach = (points.join(bounds, "id").groupBy("block")
             .agg(F.when(F.count(F.when(F.col("bound").isNull(), 1)) == 0, F.max("bound")).alias("reach")))
    balls = cut_lineage(cells.balls(points, metric).join(reach, "block"))
    return cells.near_pairs(balls, balls.drop("reach"), metric, least=k)


@leaves_one_table
def knn_edges(vectors: DataFrame, k: int, block_rows: int = 2000,
              n_rows: int | None = None, metric: str = "euclidean") -> DataFrame:
    """The k nearest neighbours of every point, the point itself
    included (distance 0), by one of ``METRICS``; ties broken by the lower id.

    ``vectors`` is ``(id, vec)``.  Returns ``(src, dst, dist, rank)`` with
    rank 1..k per src.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    n = n_rows if n_rows is not None else vectors.count()
    points, n_blocks = cells.blocks(vectors, block_rows, metric, n)
    search = _pair_topk(k, metric=metric)
    own = points.groupBy("block").applyInPandas(
        lambda p: search(p[["id", "vec"]], p[["id", "vec"]]), EDGE_SCHEMA)
    if n_blocks == 1:
        return _nearest(own, k)
    own = cut_lineage(own)
    pairs = cut_lineage(block_pairs(points, own, k, metric))
    bounds = (own.groupBy("src").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("n"))
              .select(F.col("src").alias("id"), F.when(F.col("n") == k, F.col("d")).alias("bound")))
    q = points.join(bounds, "id").withColumnRenamed("block", "qb")
    r = points.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), F.col("block").alias("rb"))
    dims = points.select(F.size("vec").alias("n")).head()["n"]
    other = cells.tiled(q, r, pairs, n_blocks, n * dims).applyInPandas(_tile_topk(k, metric), EDGE_SCHEMA)
    return _nearest(own.unionByName(other), k)


def knn_radius(edges: DataFrame, k: int) -> DataFrame:
    """Distance to the k-th neighbour (self counted) per point."""
    return edges.filter(F.col("rank") == k).select(F.col("src").alias("id"),
                                                  F.col("dist").alias("knn_radius"))


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Keep u-v only when v lists u and u lists v; self loops and
    zero-distance pairs are dropped (a sparse elementwise minimum drops
    zeros).  Both directions are returned."""
    e = edges.filter((F.col("src") != F.col("dst")) & (F.col("dist") > 0)).select(
        "src", "dst", "dist")
    rev = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                   F.col("dist").alias("rdist"))
    return e.join(rev, ["src", "dst"]).select(
        "src", "dst", F.least("dist", "rdist").alias("dist"))


def remove_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector, keeping the lowest id."""
    return vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")




def _leaf_topk(k: int):
    inner = _pair_topk(k)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf[["id", "vec"]]
        return inner(part, part)
    return fn


@leaves_one_table
def approx_knn_edges(vectors: DataFrame, k: int, trees: int = 4, leaf_rows: int = 2000,
                     seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """C1, approximate, for point sets too large for the exact blocked join.

    Each of ``trees`` random-projection trees splits every node at the
    approximate median of a random-sign projection (ties split by a hash of
    the id, so repeated values cannot pile into one leaf) until leaves hold
    at most ``leaf_rows`` points; neighbours are searched inside each leaf
    (a bounded group, top-k per point only) and the trees' candidates are
    merged to the k nearest.  Same output as ``knn_edges``.
    """
    n = n_rows if n_rows is not None else vectors.count()
    depth = max(0, math.ceil(math.log2(max(1.0, n / leaf_rows))))
    v = vectors.select("id", "vec")
    dims = len(v.select("vec").first()["vec"])
    partial = None
    for t in range(trees):
        cur = v.withColumn("node", F.lit(0).cast("long"))
        for level in range(depth):
            signs = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.when(
                F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.col("node"), j), F.lit(2)) == 0,
                F.lit(1.0)).otherwise(F.lit(-1.0)))
            proj = F.aggregate(F.zip_with("vec", signs, lambda a, b: a * b), F.lit(0.0),
                               lambda acc, x: acc + x)
            cur = cur.withColumn("proj", proj)
            med = cur.groupBy("node").agg(F.percentile_approx("proj", 0.5).alias("med"))
            side = (F.col("proj") > F.col("med")) | (
                (F.col("proj") == F.col("med"))
                & (F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(t), F.lit(level), F.col("id")),
                          F.lit(2)) == 0))
            cur = cur.join(F.broadcast(med) if 2 ** level <= 65536 else med, "node") \
                .select("id", "vec", (F.col("node") * 2 + side.cast("long")).alias("node"))
            cur = cut_lineage(cur)
        leaf = cur.groupBy("node").applyInPandas(_leaf_topk(k), EDGE_SCHEMA)
        partial = leaf if partial is None else partial.unionByName(leaf)
    top = (partial.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
           .groupBy("src")
           .agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "dst"))), 1, k).alias("nb")))
    merged = top.select("src", F.explode("nb").alias("e")).select(
        "src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"))
    return merged.withColumn(
        "rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))
