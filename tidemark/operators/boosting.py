"""Boosted regression trees (M6) on histograms of binned features.

Squared error with second-order gain, an L2 weight on leaf values and a
direction for missing values learned at every split (Chen & Guestrin, 2016).

* Cut points are quantiles of each feature from Spark's quantile sketch, all
  features in one aggregate.  The hessian of squared error is 1 for every row,
  so the sketch's weights are all equal.  A feature with at most 255 distinct
  values is cut at every one of them.
* Rows are binned once into a written table: one byte a feature, one block an
  Arrow batch.  Every level of a tree is one job: each task adds up gradient
  and count per (node, feature, bin) of its blocks, further tasks add up the
  tasks' arrays, and the driver is sent one sum a job to read the splits from,
  whose size is bounded by nodes x features x 256, whatever the row count and
  the number of tasks.  Of two siblings
  only the one with fewer rows is summed; the other is the rest of the parent.
* Several targets are fitted in the same jobs, each on its own features.
* A row's prediction so far is kept beside its block and moved forward in the
  first job of a round; every ``refresh`` rounds it is computed anew from the
  written table by all trees, so that a lost executor never costs more rounds
  than that and no lineage grows.

NULL and NaN features are missing; rows with a NULL or NaN target train no
tree of that target; without any row the prediction is NULL.  A missing value
goes right where no training row at the split was missing.  Equal gains: first
feature, then lowest cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators._util import sum_of_parts
from tidemark.operators.models import training_partitions
from tidemark.session import cut_lineage_path, drop_table

CUTS = 254             # at most, so that every bin and the one of missing values fit a byte


@dataclass
class Tree:
    """Nodes in heap order; ``feature`` is -1 at leaves."""
    feature: np.ndarray
    split: np.ndarray          # bins up to it go left
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n))

    def leaves(self, bins: np.ndarray, missing: np.ndarray, levels: int) -> np.ndarray:
        """Node of every column of ``bins`` after ``levels`` steps."""
        rows = np.arange(bins.shape[1])
        node = np.zeros(bins.shape[1], np.int64)
        for _ in range(levels):
            f = self.feature[node]
            b = bins[np.maximum(f, 0), rows]
            left = np.where(b == missing[f], self.missing_left[node], b <= self.split[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node


@dataclass
class BoostedModel:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree]

    def predict_bins(self, bins: np.ndarray) -> np.ndarray:
        out, missing = np.full(bins.shape[1], self.base), missing_bins(self.cuts)
        for t in self.trees:
            out += t.value[t.leaves(bins, missing, self.depth)]
        return out


def missing_bins(cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of missing values of every feature, one above its last."""
    return np.array([len(c) + 1 for c in cuts], np.int64)


def _binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features) doubles -> (features, rows) bins."""
    out = np.empty(values.shape[::-1], np.uint8)
    for i, c in enumerate(cuts):
        v = values[:, i]
        out[i] = np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v, side="right"))
    return out


class Layout:
    """Places of one target's (feature, bin) cells in a flat histogram, and
    the features grouped by their number of bins, so that few-valued ones are
    not padded to the widest."""

    def __init__(self, features: Sequence[int], cuts: Sequence[np.ndarray]):
        self.features = np.asarray(features, np.int64)
        widths = np.array([len(cuts[f]) + 2 for f in features], np.int64)
        self.start = np.concatenate([[0], np.cumsum(widths)[:-1]])
        self.cells = int(widths.sum())
        self.groups = []
        for low, high in ((0, 8), (8, 64), (64, CUTS + 2)):
            inside = np.flatnonzero((widths > low) & (widths <= high))
            if len(inside):
                step = np.arange(widths[inside].max() - 1)
                at = np.where(step < (widths[inside] - 1)[:, None], self.start[inside][:, None] + step, self.cells)
                self.groups.append((inside, at, self.start[inside] + widths[inside] - 1))
        self.first = slice(0, int(widths[0]))


def _best_splits(hist: np.ndarray, layout: Layout, l2: float, min_child: float):
    """For every node of (2, nodes, cells): gain, feature's place, bin,
    whether missing values go left, and gradient and count of the left side."""
    m = hist.shape[1]
    total_g, total_h = hist[:, :, layout.first].sum(2)
    base = total_g * total_g / (total_h + l2)
    padded = np.concatenate([hist, np.zeros((2, m, 1))], 2)
    best = [(-np.inf, 0, 0, False, 0.0, 0.0)] * m
    for inside, at, missing in layout.groups:
        known = np.cumsum(padded[:, :, at], 3)
        side = np.stack([known, known + padded[:, :, missing][..., None]], 4)
        gl, hl = side
        gr, hr = total_g[:, None, None, None] - gl, total_h[:, None, None, None] - hl
        gain = np.where((hl >= min_child) & (hr >= min_child),
                        gl * gl / (hl + l2) + gr * gr / (np.maximum(hr, 0) + l2) - base[:, None, None, None],
                        -np.inf).reshape(m, -1)
        top = gain.argmax(1)
        for i in range(m):
            f, b, left = np.unravel_index(top[i], side.shape[2:])
            found = (gain[i, top[i]], int(inside[f]), int(b), bool(left), gl[i, f, b, left], hl[i, f, b, left])
            if found[0] > best[i][0] or (found[0] == best[i][0] and found[1] < best[i][1]):
                best[i] = found
    return best


def _histograms(state, work, levels: int, missing: np.ndarray):
    """Sum over all rows of gradient and count per (built node, feature, bin),
    one array a target.  ``work``: (target place, its layout, tree, slot of
    each node or -1, number of slots)."""
    def run(blocks):
        acc = [np.zeros((2, slots * lay.cells)) for _, lay, _, _, slots in work]
        for bins, y, margin in blocks:
            for a, (k, lay, tree, slot_of, slots) in zip(acc, work):
                slot = slot_of[tree.leaves(bins, missing, levels)]
                rows = np.flatnonzero((slot >= 0) & ~np.isnan(y[k]))
                cell = ((slot[rows] * lay.cells)[None, :] + lay.start[:, None]
                        + bins[lay.features[:, None], rows[None, :]]).ravel()
                grad = np.tile((margin[k] - y[k])[rows], len(lay.features))
                a[0] += np.bincount(cell, grad, a.shape[1])
                a[1] += np.bincount(cell, minlength=a.shape[1])
        yield acc

    def add(a, b):
        return [x + y for x, y in zip(a, b)]

    total = sum_of_parts(state.mapPartitions(run), add)
    return [t.reshape(2, slots, lay.cells) for t, (_, lay, _, _, slots) in zip(total, work)]


def _grow(state, layouts: Sequence[Layout], missing: np.ndarray, depth: int, step: float, l2: float,
          min_child: float, min_gain: float) -> list[Tree]:
    """The next tree of every target, one job a level."""
    trees = [Tree.empty(depth) for _ in layouts]
    size = len(trees[0].feature)
    known: list[dict[int, np.ndarray]] = [{} for _ in layouts]         # histograms of the level above
    build: list[dict[int, int | None]] = [{0: None} for _ in layouts]  # node to sum -> its sibling
    for level in range(depth):
        work = []
        for k, lay in enumerate(layouts):
            if build[k]:
                slot_of = np.full(size, -1, np.int64)
                slot_of[list(build[k])] = np.arange(len(build[k]))
                work.append((k, lay, trees[k], slot_of, len(build[k])))
        if not work:
            break
        for (k, lay, tree, _, _), total in zip(work, _histograms(state, work, level, missing)):
            here = {}
            for i, (node, sibling) in enumerate(build[k].items()):
                here[node] = total[:, i]
                if sibling is not None:
                    rest = known[k][(node - 1) // 2] - total[:, i]
                    rest[0][rest[1] == 0] = 0.0
                    here[sibling] = rest
            known[k], build[k] = here, {}
            nodes = sorted(here)
            found = _best_splits(np.stack([here[n] for n in nodes], 1), lay, l2, min_child)
            for node, (gain, f, b, left_too, lg, lh) in zip(nodes, found):
                g, h = here[node][:, lay.first].sum(1)
                if node == 0 and h > 0:
                    tree.value[0] = -step * g / (h + l2)
                if not gain > min_gain:
                    continue
                left = 2 * node + 1
                tree.feature[node], tree.split[node], tree.missing_left[node] = lay.features[f], b, left_too
                tree.value[left] = -step * lg / (lh + l2)
                tree.value[left + 1] = -step * (g - lg) / (h - lh + l2)
                build[k].update({left: left + 1} if 2 * lh <= h else {left + 1: left})
    return trees


def fit(df: DataFrame, targets: Mapping[str, Sequence[str]], rounds: int = 100, depth: int = 5,
        step: float = 0.1, l2: float = 1.0, min_child: float = 1.0, min_gain: float = 1e-6,
        accuracy: int = 10_000, refresh: int = 10) -> dict[str, BoostedModel]:
    """One model for every target, each on its listed features.

    ``accuracy`` is the sketch's: ranks of the cut points are off by at most
    the rows divided by it.
    """
    names = list(targets)
    feats = list(dict.fromkeys(c for cs in targets.values() for c in cs))
    place = {c: i for i, c in enumerate(feats)}

    def number(c):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    d = df.select(*[number(c).alias(f"f{i}") for i, c in enumerate(feats)],
                  *[number(c).alias(f"y{k}") for k, c in enumerate(names)])
    quantiles = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    st = d.agg(F.count("*").alias("n"),
               *[F.avg(f"y{k}").alias(f"y{k}") for k in range(len(names))],
               *[F.percentile_approx(f"f{i}", quantiles, accuracy).alias(f"f{i}")
                 for i in range(len(feats))]).first()
    cuts = [np.unique(st[f"f{i}"] or [])[1:] for i in range(len(feats))]
    models = {t: BoostedModel(feats, cuts, float("nan") if st[f"y{k}"] is None else st[f"y{k}"], depth, [])
              for k, t in enumerate(names)}
    fitted = [k for k in range(len(names)) if st[f"y{k}"] is not None]
    if not fitted or not feats:
        return models
    chosen = [models[names[k]] for k in fitted]
    missing = missing_bins(cuts)
    layouts = [Layout([place[c] for c in targets[names[k]]], cuts) for k in fitted]

    def blocks(batches):
        for pdf in batches:
            if len(pdf):
                v = pdf.to_numpy(dtype=np.float64)
                yield pd.DataFrame({"n": [len(v)], "bins": [_binned(v[:, :len(feats)], cuts).tobytes()],
                                    "y": [np.ascontiguousarray(v[:, len(feats):].T[fitted]).tobytes()]})

    parts = training_partitions(st["n"], df.sparkSession.sparkContext.defaultParallelism, 10_000)
    table, path = cut_lineage_path(d.repartition(parts).mapInPandas(blocks, "n long, bins binary, y binary"))

    def opened(row):
        return (np.frombuffer(row.bins, np.uint8).reshape(-1, row.n),
                np.frombuffer(row.y, np.float64).reshape(-1, row.n))

    def afresh(so_far):
        def run(row):
            bins, y = opened(row)
            return bins, y, np.stack([m.predict_bins(bins) for m in so_far])
        return rows.map(run)

    def forward(trees):
        def run(block):
            bins, y, margin = block
            return bins, y, margin + np.stack([t.value[t.leaves(bins, missing, depth)] for t in trees])
        return state.map(run)

    rows = table.coalesce(parts).rdd
    state, trees = None, []
    try:
        for r in range(rounds):
            before, state = state, (forward(trees) if r % refresh else afresh(chosen))
            state.persist(StorageLevel.MEMORY_AND_DISK)
            trees = _grow(state, layouts, missing, depth, step, l2, min_child, min_gain)
            if before is not None:
                before.unpersist()
            for m, t in zip(chosen, trees):
                m.trees.append(t)
    finally:
        if state is not None:
            state.unpersist()
        drop_table(df.sparkSession, path)
    return models


def predict(df: DataFrame, model: BoostedModel, out: str) -> DataFrame:
    """``df`` with the model's prediction, a map-only pass."""
    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        values = x.to_numpy(dtype=np.float64)
        return pd.Series(model.predict_bins(_binned(values, model.cuts)))

    p = run(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(model.features)]))
    return df.withColumn(out, F.nanvl(p, F.lit(None).cast("double")))
