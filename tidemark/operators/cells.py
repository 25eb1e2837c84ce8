"""Blocks of near points, and which of them can matter to each other.

Points go to the nearest of some pivots (an md5 sample of at most
``MAX_PIVOTS`` points, the only thing that is broadcast), and a cell of more
than ``block_rows`` points is dealt over several blocks.  A block's ball
(centre and radius) bounds all distances to its points by the triangle
inequality, so pairs of blocks are ruled out by comparing their balls.  Blocks that are
left meet in tiles of many blocks, so that a point is copied once a tile and
not once a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

METRICS = ("euclidean", "manhattan", "chebyshev", "cosine")
MAX_PIVOTS = 4096
BALLS = 1024          # balls of one side that a task compares
MATRIX = 1 << 20      # cells of a matrix of rough distances
SLACK = 1e-9          # of rounding in bounds
TILE = 1 << 21        # numbers in the vectors of one side of a task
TILES = 8             # a side at least, so that there are tasks to share out


def distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix of two sets of vectors."""
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - np.nan_to_num(q @ r.T / norms)
    diff = q[:, None, :] - r[None, :, :]
    if metric == "euclidean":
        return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    diff = np.abs(diff)
    return diff.sum(2) if metric == "manhattan" else diff.max(2)


class Rough:
    """Euclidean distances between rows of ``q`` and ``r`` by one matrix
    product, with a bound of their rounding: what it rules out needs no exact
    distance.  Values that are not finite rule nothing out.  With ``dtype``
    float32 the product takes half the time and its bound is wider."""

    def __init__(self, q: np.ndarray, r: np.ndarray, dtype=np.float64):
        self.origin = r.mean(0) if len(r) else 0.0
        q, r = q - self.origin, r - self.origin
        self.qq, rr = (np.einsum("ij,ij->i", x, x) for x in (q, r))
        # of the products' and the shift's rounding, generously; a factor on squares
        self.eps = (16 if dtype == np.float64 else 4) * (q.shape[1] + 8) * float(np.finfo(dtype).eps)
        shift = np.abs(self.origin).max(initial=0.0) * math.sqrt(q.shape[1])
        self.most = rr.max(initial=0.0) + shift * shift
        top = 1e300 if dtype == np.float64 else 1e30
        self.tiny = float(np.finfo(dtype).tiny) * (1 if dtype == np.float64 else q.shape[1] + 8)
        self.finite = bool((self.qq < top).all() and (rr < top).all() and self.most < top)
        if self.finite:
            self.q = np.concatenate([-2.0 * q, np.ones((len(q), 1))], 1).astype(dtype)
            self.r = np.ascontiguousarray(np.concatenate([r, rr[:, None]], 1).astype(dtype).T)

    def parts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances of the rows from ``lo`` to ``hi`` less the rows'
        own squares, these squares, and by how much each row's distances may
        be wrong."""
        own = self.qq[lo:hi]
        return self.q[lo:hi] @ self.r, own, self.eps * (own + self.most) + self.tiny

    def limits(self, bound: np.ndarray) -> np.ndarray:
        """``bound`` in the measure of ``parts``."""
        return np.square(bound)

    @staticmethod
    def above(cut: np.ndarray, dtype) -> np.ndarray:
        """``cut`` as ``dtype``, not under it by its own rounding."""
        return np.nextafter(cut.astype(dtype), dtype.type(np.inf))

    def squares(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the rows from ``lo`` to ``hi``, and by how much
        each row's may be wrong."""
        d, own, wrong = self.parts(lo, hi)
        return d + own[:, None], wrong


class RoughSums:
    """Manhattan distances between rows of ``q`` and ``r`` in whole numbers, as
    ``Rough`` has Euclidean ones: values become 16-bit multiples of one step,
    and a distance is twice the sum of the larger values less both rows' sums.
    A row's error is that of rounding to the step."""

    LEVELS = 32_000   # that the values of a row add up to at most
    CELLS = 1 << 18   # of a matrix that stays in a processor's cache

    def __init__(self, q: np.ndarray, r: np.ndarray):
        n = q.shape[1]
        self.finite = bool(n and len(q) and len(r) and np.isfinite(q).all() and np.isfinite(r).all())
        if not self.finite:
            return
        low = np.minimum(q.min(0), r.min(0))
        with np.errstate(over="ignore"):
            spans = np.maximum(q.max(0), r.max(0)) - low
            step = float(spans.sum()) / (self.LEVELS - 2 * n)
        self.finite = n <= self.LEVELS // 8 and 0 < step < 1e300 and step > 1e-290
        if not self.finite:
            return
        self.unit = 2.0 * step
        # half a step a value, on either side; the halved sum; shifts of values far from zero
        far = max(np.abs(low).max(), np.abs(low + spans).max()) / step
        self.wrong = 0.5 * n * (1 + 1e-6) + 1.0 + 16 * n * far * float(np.finfo(float).eps)
        self.q, self.r = (np.ascontiguousarray(np.rint((x - low) / step).astype(np.int16).T) for x in (q, r))
        self.own = self.q.sum(0, dtype=np.int64) / -2.0
        self.start = -(self.r.sum(0, dtype=np.int64) // 2).astype(np.int16)

    def parts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.own[lo:hi]
        out = np.empty((len(own), self.r.shape[1]), np.int16)
        rows = max(1, self.CELLS // out.shape[1])
        most = np.empty((min(rows, len(own)), out.shape[1]), np.int16)
        for a in range(0, len(own), rows):
            piece = out[a:a + rows]
            piece[:] = self.start
            for x, y in zip(self.q[:, lo + a:lo + a + len(piece)], self.r, strict=True):
                piece += np.maximum(x[:, None], y, out=most[:len(piece)])
        return out, own, np.full(len(own), self.wrong)

    def limits(self, bound: np.ndarray) -> np.ndarray:
        return bound / self.unit

    @staticmethod
    def above(cut: np.ndarray, dtype) -> np.ndarray:
        most = np.iinfo(dtype)
        return np.clip(np.floor(cut) + 1, most.min, most.max).astype(dtype)


def pair_distances(q: np.ndarray, r: np.ndarray, at: np.ndarray, to: np.ndarray,
                   metric: str = "euclidean") -> np.ndarray:
    """Distances (Euclidean or Manhattan) of the rows ``at`` of ``q`` and
    ``to`` of ``r``, by the same sums as ``distances``."""
    out = np.empty(len(at))
    for lo in range(0, len(at), 1 << 14):
        diff = (q[at[lo:lo + (1 << 14)]] - r[to[lo:lo + (1 << 14)]])[None]
        out[lo:lo + (1 << 14)] = (np.abs(diff).sum(2) if metric == "manhattan"
                                  else np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)))[0]
    return out


def in_chunks(q: np.ndarray, r: np.ndarray, metric: str, cells_at_once: int = 1 << 21):
    """Distance matrices of pieces of ``q``, each of bounded size."""
    step = max(1, cells_at_once // max(1, r.size))
    for lo in range(0, len(q), step):
        yield lo, distances(q[lo:lo + step], r, metric)


def blocks(vectors: DataFrame, block_rows: int = 2000, metric: str = "euclidean",
           n_rows: int | None = None) -> tuple[DataFrame, int]:
    """``(id, vec, block)`` as a table, and the number of pivots; all columns
    of ``vectors`` are kept."""
    n = n_rows if n_rows is not None else vectors.count()
    n_pivots = min(MAX_PIVOTS, max(1, math.ceil(n / block_rows)))
    if n_pivots == 1:
        return cut_lineage(vectors.withColumn("block", F.lit(0).cast("long"))), 1
    sample = vectors.select("vec").orderBy(F.md5(F.col("id").cast("string"))).limit(n_pivots).collect()
    pivots = vectors.sparkSession.sparkContext.broadcast(np.array([r["vec"] for r in sample], float))

    def assign(batches):
        for b in batches:
            v = np.stack(b["vec"].to_numpy()).astype(float)
            rough = {"euclidean": Rough, "manhattan": RoughSums}[metric](v, pivots.value) if metric in (
                "euclidean", "manhattan") else None
            step = max(1, MATRIX // len(pivots.value))
            # a point between two pivots may go to either
            cell = np.concatenate(
                [rough.parts(lo, lo + step)[0].argmin(1) for lo in range(0, len(v), step)] if rough is not None
                and rough.finite else [d.argmin(1) for _, d in in_chunks(v, pivots.value, metric)])
            yield b.assign(cell=cell.astype(np.int64))

    schema = vectors.withColumn("cell", F.lit(0).cast("long")).schema
    placed = cut_lineage(vectors.mapInPandas(assign, schema))
    # one row for each pivot
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return cut_lineage(placed.join(F.broadcast(parts), "cell").withColumn(
        "block", F.col("cell") + part * F.lit(n_pivots)).drop("cell", "parts")), n_pivots


def balls(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(block, centre, radius, n)`` of every block."""
    def ball(p: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(p["vec"].to_numpy()).astype(float)
        centre = v.mean(0)
        return pd.DataFrame({"block": p["block"].iloc[:1], "centre": [centre],
                             "radius": [max(d.max() for _, d in in_chunks(v, centre[None], metric))],
                             "n": [len(v)]})
    return points.select("block", "vec").groupBy("block").applyInPandas(
        ball, "block long, centre array<double>, radius double, n long")


def near_pairs(a: DataFrame, b: DataFrame, metric: str = "euclidean", least: int = 1) -> DataFrame:
    """``(qb, rb)``: pairs of different blocks where a point of ``a`` may lie
    within ``reach`` (a column of ``a``) of one of ``b``.

    Where ``reach`` is NULL it is taken from the balls: as far as blocks that
    hold ``least`` points together.  Cosine distance has no triangle
    inequality, there every pair stays.  Balls are compared in square pieces
    of ``BALLS``; only the pairs that stay are written.
    """
    if metric == "cosine":
        return a.select(F.col("block").alias("qb")).join(
            b.select(F.col("block").alias("rb")), F.col("qb") != F.col("rb"))
    pieces = max(1, math.ceil(max(a.count(), b.count()) / BALLS))
    piece = F.pmod(F.xxhash64("block"), F.lit(pieces)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    left = a.withColumn("x", piece).withColumn("y", every)
    # names of its own: both sides come from one table
    right = b.select(F.col("block").alias("rblock"), F.col("centre").alias("rcentre"),
                     F.col("radius").alias("rradius"), F.col("n").alias("rn"), piece.alias("y")).withColumn("x", every)

    def matrix(p, q):
        d = np.concatenate([m for _, m in in_chunks(np.stack(p["centre"].to_numpy()),
                                                     np.stack(q["rcentre"].to_numpy()), metric)])
        return d, p["radius"].to_numpy()[:, None] + q["rradius"].to_numpy()[None, :]

    def far(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Distances within which ``least`` points of this piece lie."""
        p = p[p["reach"].isna()] if len(p) else p
        if p.empty or q.empty:
            return pd.DataFrame({"block": pd.Series([], dtype="int64"), "far": pd.Series([], dtype="float64"),
                                 "n": pd.Series([], dtype="int64")})
        d, radii = matrix(p, q)
        most, n = d + radii, q["rn"].to_numpy()
        order = np.argsort(most, axis=1, kind="stable")
        held = np.cumsum(n[order], axis=1)
        rows = []
        for i, block in enumerate(p["block"]):
            stop = min(int(np.searchsorted(held[i], least)) + 1, len(n))
            rows += [(block, most[i, j], n[j]) for j in order[i, :stop]]
        return pd.DataFrame(rows, columns=["block", "far", "n"])

    if not a.filter("reach IS NULL").isEmpty():
        near = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(
            far, "block long, far double, n long")
        # at most ``least`` rows of a piece for each block
        def reach(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("far")
            enough = np.flatnonzero(p["n"].cumsum().to_numpy() >= least)
            return pd.DataFrame({"block": p["block"].iloc[:1], "found": [
                p["far"].iloc[enough[0]] if len(enough) else np.inf]})
        found = near.groupBy("block").applyInPandas(reach, "block long, found double")
        left = left.join(found, "block", "left").withColumn("reach", F.coalesce("reach", "found")).drop("found")

    def close(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"qb": pd.Series([], dtype="int64"), "rb": pd.Series([], dtype="int64")})
        d, radii = matrix(p, q)
        reach = p["reach"].fillna(np.inf).to_numpy()[:, None]
        i, j = np.nonzero(d * (1 - SLACK) - radii * (1 + SLACK) <= reach)
        qb, rb = p["block"].to_numpy()[i], q["rblock"].to_numpy()[j]
        return pd.DataFrame({"qb": qb[qb != rb], "rb": rb[qb != rb]})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(close, "qb long, rb long")


def tiled(q: DataFrame, r: DataFrame, pairs: DataFrame, n_pivots: int, numbers: int):
    """Cogroups of the rows of ``q`` and ``r`` whose blocks meet in ``pairs``
    (``qb``, ``rb``), a tile of blocks of either side at a time.

    ``numbers`` is the count of all vectors' numbers: a side has about ``TILE``
    of them, or less where there would be fewer than ``TILES`` tiles.  A row is
    copied once for each tile that it meets.
    """
    n = max(TILES, math.ceil(numbers / TILE))

    def tile(col):
        # the parts of one cell go to different tiles
        return F.pmod(F.pmod(F.col(col), F.lit(n_pivots)) + F.floor(F.col(col) / F.lit(n_pivots)), F.lit(n)).cast("int")

    left = q.join(pairs.select("qb", tile("qb").alias("qt"), tile("rb").alias("rt")).distinct(), "qb")
    right = r.join(pairs.select("rb", tile("qb").alias("qt"), tile("rb").alias("rt")).distinct(), "rb")
    return left.groupBy("qt", "rt").cogroup(right.groupBy("qt", "rt"))


def _by_block(block: np.ndarray):
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, starts[1:]), strict=True))


def meetings(qblock: np.ndarray, qv: np.ndarray, bound: np.ndarray, rblock: np.ndarray, rv: np.ndarray,
             metric: str = "euclidean"):
    """Rows of ``q`` and of ``r`` that lie in different blocks and may lie
    within the q row's ``bound`` of each other, a block of ``q`` with a block
    of ``r`` at a time, the nearest first.  The caller may lower ``bound``
    between them."""
    theirs = _by_block(rblock)
    if metric != "cosine":
        centres = np.stack([rv[rows].mean(0) for _, rows in theirs])
        radii = np.array([max(d.max() for _, d in in_chunks(rv[rows], c[None], metric))
                          for (_, rows), c in zip(theirs, centres, strict=True)])
    for name, mine in _by_block(qblock):
        if metric == "cosine":
            yield from ((mine, rows) for other, rows in theirs if other != name)
            continue
        gap = np.concatenate([d for _, d in in_chunks(qv[mine], centres, metric)]) * (1 - SLACK) - radii * (1 + SLACK)
        for j in np.argsort(gap.min(0), kind="stable"):
            near = mine[~(gap[:, j] > bound[mine] * (1 + SLACK))]
            if theirs[j][0] != name and len(near):
                yield near, theirs[j][1]
