"""Exact neighbours by blocks of near points: brute force and work counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, cpf, knn


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)],
                                 "id long, vec array<double>").repartition(4)


def brute(ids, x, k, metric):
    d = cells.distances(x, x, metric)
    return {(int(ids[i]), int(ids[j]), rank + 1): d[i, j] for i in range(len(ids))
            for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:k])}


def points(seed, n, dims):
    r = np.random.default_rng(seed)
    centres = r.uniform(-50, 50, (12, dims))
    x = np.round(centres[r.integers(0, 12, n)] + r.normal(0, 1, (n, dims)), 1)
    x[: n // 10] = x[n // 2]            # repeated points
    x[-3:] = 1000 * np.arange(1, 4)[:, None]   # far from all
    return r.permutation(10 * n)[:n], x


@pytest.mark.parametrize("metric, dims, k, block_rows", [("euclidean", 2, 5, 20), ("manhattan", 3, 4, 25),
                                                         ("chebyshev", 2, 30, 10), ("cosine", 4, 3, 100)])
def test_knn_against_brute_force(spark, metric, dims, k, block_rows):
    ids, x = points(1, 300, dims)
    got = {(r.src, r.dst, r["rank"]): r.dist for r in
           knn.knn_edges(frame(spark, x, ids), k, block_rows, metric=metric).collect()}
    want = brute(ids, x, k, metric)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


def test_most_pairs_are_never_compared(spark):
    ids, x = points(2, 4000, 2)
    p, n_pivots = cells.blocks(frame(spark, x, ids), 50)
    p = p.persist()
    search = knn._pair_topk(5)
    own = p.groupBy("block").applyInPandas(lambda a: search(a, a), knn.EDGE_SCHEMA).persist()
    sizes = p.groupBy("block").count()
    pairs = knn.block_pairs(p, own, 5, "euclidean")
    compared = (pairs.join(sizes.withColumnRenamed("block", "qb").withColumnRenamed("count", "a"), "qb")
                .join(sizes.withColumnRenamed("block", "rb").withColumnRenamed("count", "b"), "rb")
                .agg(F.sum(F.col("a") * F.col("b"))).first()[0]) + sizes.agg(F.sum(F.col("count") ** 2)).first()[0]
    p.unpersist()
    own.unpersist()
    assert n_pivots == 80 and compared < 0.2 * 4000 ** 2


def test_fewer_points_than_neighbours(spark):
    e = knn.knn_edges(frame(spark, np.eye(3)), 5, block_rows=1).collect()
    assert len(e) == 9 and {r["rank"] for r in e} == {1, 2, 3}
    assert knn.knn_edges(frame(spark, np.zeros((0, 2))), 5).count() == 0


@pytest.mark.parametrize("seed, dims, block_rows", [(4, 5, 40)])
def test_denser_parent_against_brute_force(spark, seed, dims, block_rows):
    ids, x = points(seed, 300, dims)
    v = frame(spark, x, ids)
    edges, _, nodes = cpf.build_graph(v, 4, block_rows=block_rows)
    info = {r.id: (r.component, r.knn_radius) for r in nodes.collect() if r.component is not None}
    at = {int(i): x[n] for n, i in enumerate(ids)}
    got = {r.id: (r.parent, r.best_distance) for r in
           cpf.denser_parent(v, edges, nodes, block_rows=block_rows).collect()}
    assert got.keys() == info.keys()
    for i, (c, r) in info.items():
        mine = [j for j, (cj, _) in info.items() if cj == c]
        denser = [j for j in mine if info[j][1] < r]
        root = min(mine, key=lambda j: (info[j][1], j))
        d = {j: float(np.sqrt(((at[i] - at[j]) ** 2).sum())) for j in denser}
        want = min(d, key=lambda j: (d[j], j)) if d else root
        assert got[i][0] == want
        assert got[i][1] == (pytest.approx(d[want]) if d else np.inf if i == root else
                             pytest.approx(float(np.sqrt(((at[i] - at[root]) ** 2).sum()))))


def test_recall_of_the_approximate_search(spark):
    """The registered query's parameters, over vectors without structure."""
    v = knn.as_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding").persist()
    exact = {(r.src, r.dst) for r in knn.knn_edges(v, 5).collect()}
    found = {(r.src, r.dst) for r in knn.approx_knn_edges(v, 5, trees=10, leaf_rows=400).collect()}
    v.unpersist()
    assert len(exact & found) >= 0.9 * len(exact)


def test_rough_distances_keep_every_neighbour(spark):
    """The matrix product leaves candidates only; exact distances, far from the
    origin and among ties, are those of all pairs."""
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(400, 6)), np.round(rng.normal(size=(400, 2)), 1) + 1e6):
        rough = cells.Rough(x[:150], x)
        d, wrong = rough.squares(0, 150)
        exact = cells.distances(x[:150], x, "euclidean")
        assert (np.abs(d - exact ** 2) <= wrong[:, None]).all()
        got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in knn.knn_edges(
            frame(spark, x), 4, block_rows=60).collect()}
        for i, row in enumerate(cells.distances(x, x, "euclidean")):
            want = sorted((d, j) for j, d in enumerate(row))[:4]
            assert [got[i, n + 1] for n in range(4)] == [(j, d) for d, j in want]


def test_a_point_is_copied_once_a_tile(spark):
    """Without structure all blocks meet; a row goes to each tile of the other
    side, however many blocks there are."""
    x = np.random.default_rng(8).normal(size=(1200, 16))
    p, n_pivots = cells.blocks(frame(spark, x), 20)
    blocks = p.select("block").distinct()
    pairs = blocks.toDF("qb").crossJoin(blocks.toDF("rb")).filter("qb <> rb").localCheckpoint()
    q, r = p.select("id", F.col("block").alias("qb")), p.select(F.col("id").alias("rid"), F.col("block").alias("rb"))
    seen = cells.tiled(q, r, pairs, n_pivots, 1200 * 16).applyInPandas(
        lambda a, b: a.iloc[:1][[]].assign(q=len(a), r=len(b)), "q long, r long")
    got = seen.agg(F.sum("q"), F.sum("r"), F.count("*"), F.max("q")).first()
    assert blocks.count() >= 60
    assert got[0] == got[1] == 1200 * cells.TILES and got[2] == cells.TILES ** 2
    assert got[3] < 3 * 1200 / cells.TILES


def test_points_too_close_for_single_precision(spark):
    """Clusters far smaller than their distance from each other, many equal
    distances: the neighbours are those of all pairs."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(4, 3)) * 100, 60, 0) + np.round(rng.normal(size=(240, 3)), 1) * 1e-6
    got = {(r.src, r.dst, r["rank"]): r.dist for r in knn.knn_edges(frame(spark, x), 6, block_rows=24).collect()}
    assert got == brute(range(240), x, 6, "euclidean")


def test_denser_parent_across_tiles(spark):
    """Each point's nearest denser point of its component, by all pairs."""
    rng = np.random.default_rng(10)
    x, c, radius = rng.normal(size=(300, 5)), rng.integers(0, 3, 300), np.round(rng.uniform(1, 2, 300), 2)
    nodes = spark.createDataFrame([(i, int(c[i]), float(radius[i])) for i in range(300)],
                                  "id long, component long, knn_radius double")
    edges = spark.createDataFrame([], knn.EDGE_SCHEMA)
    got = {r.id: (r.parent, r.best_distance) for r in cpf.denser_parent(frame(spark, x), edges, nodes, 15).collect()}
    d = cells.distances(x, x, "euclidean")
    for i in range(300):
        near = sorted((d[i, j], j) for j in range(300) if c[j] == c[i] and radius[j] < radius[i])
        if near:
            assert got[i] == (near[0][1], near[0][0])
    assert len(got) == 300
