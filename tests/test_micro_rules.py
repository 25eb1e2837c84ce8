"""Hand-made micro tables for the NULL, tie and edge rules (FIXTURES part C)."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import row_mean, safe_corr
from tidemark.operators import clean, enrich, graph, knn, models, stats
from tidemark.operators import cpf
from tidemark.sources import io


def test_units_line_dropped_and_empty_source(spark):
    d = tempfile.mkdtemp()
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w") as f:
        f.write("time,station_id,level\nUTC,,metres\n2020-01-01T00:00:00,S1,1.5\n"
                "2020-01-01T06:00:00,S1,2.5\n")
    with open(b, "w") as f:
        f.write("time,station_id,level\nUTC,,metres\n")
    schema = T.StructType([T.StructField("time", T.TimestampType()),
                           T.StructField("station_id", T.StringType()),
                           T.StructField("level", T.DoubleType())])
    df = io.union_sources([io.read_sensor(spark, p, schema) for p in (a, b)])
    rows = df.orderBy("time").collect()
    assert len(rows) == 2 and rows[0]["level"] == 1.5 and rows[0]["station_id"] == "S1"


def test_null_group_key_dropped(spark):
    df = spark.createDataFrame([("S1", "2020-01-01 00:00:00", 1.0), (None, "2020-01-01 01:00:00", 9.0)],
                               "s string, t string, v double").withColumn("t", F.to_timestamp("t"))
    out = enrich.daily_extremes(df, ["s"], "t", "v").collect()
    assert len(out) == 1 and out[0]["daily_max"] == 1.0


def test_row_mean_skips_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(row_mean(["a", "b"])).collect()]
    assert got == [1.0, None, 2.0]


def test_strict_erosion_threshold(spark):
    # binary-exact values: a change of exactly the threshold is not erosion
    df = spark.createDataFrame([(1, 1.0, 0.75), (2, 1.0, 0.5), (3, None, 0.5), (4, 1.0, None)],
                               "id int, a double, b double")
    out = clean.detect_erosion(df, ["a"], ["b"], -0.25).select("id").collect()
    assert [r.id for r in out] == [2]


def test_pivot_gap_is_null(spark):
    df = spark.createDataFrame([("S1", 2020, 1.0), ("S1", 2021, 2.0), ("S2", 2020, 3.0)],
                               "s string, year int, v double")
    out = enrich.pivot_years(df, ["s"], {"v": "P"}, years=[2020, 2021]).orderBy("s").collect()
    assert out[1]["P2021"] is None and out[0]["P2021"] == 2.0


def test_nearest_tie_takes_lower_site_id(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double")
    sites = spark.createDataFrame([(7, 1.0, 0.0, "b"), (3, -1.0, 0.0, "a")],
                                  "sid int, sx double, sy double, val string")
    out = enrich.nearest_join(pts, sites, ["x", "y"], ["sx", "sy"], "sid", ["val"]).first()
    assert out["nearest_sid"] == 3 and out["val"] == "a"
    grid = enrich.nearest_join(pts, sites, ["x", "y"], ["sx", "sy"], "sid", ["val"],
                               max_broadcast=0, cell=0.3).first()
    assert grid["nearest_sid"] == 3


def test_full_join_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1.0), (1.0, 2.0)], "k double, a double")
    b = spark.createDataFrame([(None, 5.0)], "k double, b double")
    out = enrich.full_outer_on(a, b, ["k"]).collect()
    assert len(out) == 2
    assert any(r["k"] is None and r["a"] == 1.0 and r["b"] == 5.0 for r in out)


def test_name_case_collision_avoided(spark):
    base = spark.createDataFrame([(1, 10.0)], "id int, Longitude double")
    row = spark.createDataFrame([(99.0, 3.0)], "longitude double, w double")
    out = enrich.broadcast_row(base, row.select("w"))
    assert set(out.columns) == {"id", "Longitude", "w"}


def test_one_row_group_and_constant_corr(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("b", 3.0, 5.0)],
                               "g string, x double, c double")
    gs = {r.g: r for r in stats.group_mean_std(df, "g", "x").collect()}
    assert gs["a"]["std"] is None
    r = df.agg(safe_corr("x", "c").alias("r"), safe_corr("x", "x").alias("s")).first()
    assert r["r"] is None and abs(r["s"] - 1) < 1e-12
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert one.agg(safe_corr("x", "y")).first()[0] is None


def test_sigma_and_tukey_fences(spark):
    vals = [1.0] * 20 + [100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, r double")
    assert [r.id for r in stats.tukey_outliers(df, "r").collect()] == [20]
    assert [r.id for r in stats.sigma_outliers(df, "r", 3).collect()] == [20]
    flat = spark.createDataFrame([(i, 2.0) for i in range(5)], "id int, r double")
    assert stats.tukey_outliers(flat, "r").count() == 0
    assert stats.sigma_outliers(flat, "r", 3).count() == 0


def test_histogram_max_in_last_bin_and_constant(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10]], "v double")
    h = {r.bin: r["count"] for r in stats.histogram(df, "v", 5).collect()}
    assert [h[i] for i in range(5)] == [2, 1, 0, 0, 1]   # as numpy.histogram
    c = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    h = {r.bin: r["count"] for r in stats.histogram(c, "v", 20).collect()}
    assert h[10] == 2


def test_direction_rules(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)], "a double, p double")
    hi = [r[0] for r in df.select(clean.direction("a", "p", "H")).collect()]
    lo = [r[0] for r in df.select(clean.direction("a", "p", "L")).collect()]
    assert hi == [None, "accretion", "erosion"] and lo == [None, "erosion", "accretion"]


def test_standardise_constant_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = models.standardise(df, ["a", "c"]).orderBy("a").collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.c for r in out] == [0.0, 0.0]


def test_explained_variance_vs_r2_on_shift(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "y double, p double")
    m = models.regression_metrics(df, "y", "p").first()
    assert abs(m["explained_variance"] - 1.0) < 1e-12 and m["r2"] < 1.0


def test_one_hot_null_and_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    out = models.one_hot(df, "s", drop_first=True).collect()
    assert out[0].asDict() == {"s_b": 1} and out[2].asDict() == {"s_b": 0}


def test_knn_self_and_too_few_points(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], "id long, vec array<double>")
    e = knn.knn_edges(v, 1)
    assert all(r.src == r.dst and r.dist == 0 for r in e.collect())
    edges, mutual, nodes = cpf.build_graph(v, 5)
    assert all(r.component is None for r in nodes.collect())


def test_mutual_graph_rules(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 2.0), (4, 5, 0.0), (5, 4, 0.0)],
                              "src long, dst long, dist double")
    got = sorted((r.src, r.dst) for r in knn.mutual_edges(e).collect())
    assert got == [(1, 2), (2, 1)]


def test_components_singleton_pair_chain(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    e = spark.createDataFrame([(2, 3), (4, 5), (5, 6), (6, 7), (7, 8)], "src long, dst long")
    c = {r.id: r.component for r in
         graph.component_outliers(graph.connected_components(v, e), 1).collect()}
    assert c[1] is None and c[2] == c[3] == 2 and all(c[i] == 4 for i in range(4, 9))


def test_chain_roots(spark):
    p = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 6), (7, 6)],
                              "id long, parent long")
    r = {x.id: x.root for x in graph.chain_roots(p).collect()}
    assert r == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}


def test_densest_tie_has_one_root(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, vec array<double>")
    nodes = spark.createDataFrame([(1, 9, 1.0), (2, 9, 1.0), (3, 9, 2.0)],
                                  "id long, component long, knn_radius double")
    edges = spark.createDataFrame([], "src long, dst long, dist double, rank int")
    par = {r.id: (r.parent, r.best_distance) for r in cpf.denser_parent(v, edges, nodes).collect()}
    assert par[1] == (1, math.inf) and par[2] == (1, 1.0) and par[3][0] == 2


def test_peak_score_zero_over_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 4.0)], "best_distance double, knn_radius double")
    got = [r.peak for r in cpf.peak_score(df).collect()]
    assert got[0] == math.inf and got[1] == math.inf and got[2] == 0.5


def test_merge_near_clusters_and_zero_density(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "id long, label int")
    table = spark.createDataFrame(
        [(0, 1, [0.0], 1.0), (1, 1, [0.1], 1.05), (2, 1, [9.0], 0.0), (3, 1, [9.1], 0.0)],
        "label int, size long, centroid array<double>, density double")
    out = {r.id: r.label for r in cpf.merge_clusters(labels, table, 0.5, 0.1).collect()}
    assert out == {1: 1, 2: 1, 3: 2, 4: 3}


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np
    from tidemark.operators.rank import exact_quantiles
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = exact_quantiles(df, "v", [0.25, 0.5, 0.75], buckets=4)
    for p in (0.25, 0.5, 0.75):
        assert abs(q[p] - float(np.quantile(vals, p))) < 1e-12


def test_global_rank_is_dense_and_ordered(spark):
    from tidemark.operators.rank import global_rank
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id"))
    r = global_rank(df.repartition(5), ["k", "id"], "pos", partitions=7).collect()
    assert sorted(x.pos for x in r) == list(range(1000))
    assert all(x.pos == x.k for x in r)


def test_nearest_colocated_sites_and_dense_cell(spark):
    # two sites at the same place: the lower id wins in both paths; a dense
    # cluster of sites forces the grid to shrink its cells
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 9.0, 9.0)], "pid int, x double, y double")
    rows = [(5, 0.0, 0.0), (2, 0.0, 0.0), (9, 10.0, 10.0)]
    rows += [(100 + i, 5.0 + i * 1e-3, 5.0) for i in range(200)]
    sites = spark.createDataFrame(rows, "sid int, sx double, sy double")
    for kw in ({}, {"max_broadcast": 0, "max_per_cell": 8}):
        out = {r.pid: r.nearest_sid for r in
               enrich.nearest_join(pts, sites, ["x", "y"], ["sx", "sy"], "sid", [], **kw).collect()}
        assert out == {1: 2, 2: 9}


def test_csv_nan_becomes_null(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("id,v\n1,NaN\n2,2.5\n3,\n")
    df = io.read_table(spark, p, "id int, v double", fmt="csv")
    got = {r.id: r.v for r in df.collect()}
    assert got == {1: None, 2: 2.5, 3: None}
    assert df.agg(F.avg("v")).first()[0] == 2.5


def test_global_rank_with_a_hot_value(spark):
    from tidemark.operators.rank import exact_quantiles, global_rank
    # a third of the rows share one value: ranks stay a permutation, ties by id
    df = spark.range(0, 3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("v"))
    r = global_rank(df, ["v", "id"], "pos", partitions=6).collect()
    assert sorted(x.pos for x in r) == list(range(3000))
    order = [x.id for x in sorted(r, key=lambda x: x.pos)]
    expect = [x.id for x in sorted(df.collect(), key=lambda x: (x.v, x.id))]
    assert order == expect
    import numpy as np
    vals = [x.v for x in df.collect()]
    q = exact_quantiles(df, "v", [0.1, 0.5], buckets=8)
    assert abs(q[0.1] - float(np.quantile(vals, 0.1))) < 1e-9
    assert abs(q[0.5] - float(np.quantile(vals, 0.5))) < 1e-9


def test_feature_sets_pick_column_families(spark):
    from tidemark.operators.features import feature_set
    cols = ["OBJECTID", "Longitude", "Latitude", "FID", "NDVI_2015H", "NDVI_2016L",
            "NDVI_2024H", "NDVI_2024L", "WaveHeight2013", "SigWaveHeight2014", "AvgLowTide2015"]
    df = spark.createDataFrame([tuple([1] + [0.0] * (len(cols) - 1))],
                               ", ".join(f"{c} {'long' if c == 'OBJECTID' else 'double'}" for c in cols)
                               ).withColumn("STRATCODE", F.lit("A"))
    t = ["NDVI_2024H", "NDVI_2024L"]
    base, _ = feature_set(df, "base", t)
    places = ["Longitude", "Latitude"]
    rest = ["NDVI_2015H", "NDVI_2016L", "WaveHeight2013", "SigWaveHeight2014", "AvgLowTide2015"]
    assert base == places + rest
    assert feature_set(df, "no_sediment_class", t)[0] == [*places, "FID", *rest]
    assert feature_set(df, "all_wave_no_sediment", t)[0] == places + rest
    assert feature_set(df, "all_wave_with_code", t)[0] == [*places, "FID", *rest]
    with_class, v = feature_set(df, "basic_wave_with_class", t)
    assert with_class == [*places, "FID", *rest] and v.sediment_class
    code, v = feature_set(df, "basic_wave_with_code", t)
    assert code == [*places, "FID", *rest] and v.white == 1e-4
    cls, v = feature_set(df, "all_wave_with_class", t)
    assert cls == ["NDVI_2016L", "WaveHeight2013"] and v.sediment_class and v.steps == 200


def test_approx_knn_single_leaf_is_exact_and_hot_values_split(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(120, 3))
    pts[:40] = 0.5                      # a third of the points identical
    v = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)],
                              "id long, vec array<double>")
    exact = sorted((r.src, r.dst, r.rank) for r in knn.knn_edges(v, 4).collect())
    one_leaf = sorted((r.src, r.dst, r.rank) for r in
                      knn.approx_knn_edges(v, 4, trees=1, leaf_rows=1000).collect())
    assert one_leaf == exact
    approx = knn.approx_knn_edges(v, 4, trees=3, leaf_rows=20).collect()
    assert sorted({r.src for r in approx}) == list(range(120))
    got = {(r.src, r.dst) for r in approx}
    assert len(got & {(s, d) for s, d, _ in exact}) / len(exact) > 0.5


def test_mean_shift_empty_input(spark):
    import math as _m
    from tidemark.operators import meanshift
    v = spark.createDataFrame([], "id long, vec array<double>")
    assert _m.isnan(meanshift.estimate_bandwidth(v))
    labels, centres = meanshift.mean_shift(v, 1.0)
    assert labels.count() == 0 and centres.count() == 0


def test_training_partitions_rule():
    from tidemark.operators.models import training_partitions
    assert training_partitions(12_000, 8) == 6
    assert training_partitions(500, 8) == 1
    assert training_partitions(10 ** 9, 8) == 1000
    assert training_partitions(10 ** 9, 8000) == 8000


def test_knn_edges_count_and_projections(spark):
    import numpy as np

    from tidemark.operators import knn
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(60, 3))
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vec array<double>")
    for metric in knn.METRICS:
        for block_rows in (17, 2000):
            e = knn.knn_edges(v, 4, block_rows=block_rows, metric=metric)
            assert e.count() == 240
            for c in e.columns:
                assert len(e.select(c).collect()) == 240
            assert {(r.src, r.dst) for r in e.select("src", "dst").collect() if r.src == r.dst} == {
                (i, i) for i in range(60)}
    d = np.abs(pts[:, None] - pts[None]).sum(2)
    e = {(r.src, r["rank"]): r.dst for r in knn.knn_edges(v, 4, 17, metric="manhattan").collect()}
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert all(e[i, k + 1] == want[i, k] for i in range(60) for k in range(4))


def test_sample_n_never_draws_null_ids(spark):
    from tidemark.operators.clean import sample_n
    df = spark.range(100).selectExpr("CASE WHEN id < 10 THEN NULL ELSE id END AS id")
    one, two = (sorted(r.id for r in sample_n(df, "id", 10, prefilter=p).collect())
                for p in (True, False))
    assert one == two and len(one) == 10


def test_nearest_join_without_sites(spark):
    from tidemark.operators.enrich import nearest_join
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id long, x double, y double")
    sites = spark.createDataFrame([], "sid long, sx double, sy double, level double")
    r = nearest_join(points, sites, ["x", "y"], ["sx", "sy"], "sid").first()
    assert r.id == 1 and r.nearest_sid is None and r.level is None and r.nearest_dist is None


def test_impute_mean_of_integers(spark):
    from tidemark.operators.clean import impute_mean
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v int")
    assert sorted(r.v for r in impute_mean(df).collect())[1] == 5 / 3


def test_csv_columns_by_name(spark, tmp_path):
    from tidemark.sources import io
    (tmp_path / "one.csv").write_text("id,b,a\n1,10,20\n")
    (tmp_path / "two.csv").write_text("a,more,id,b\n21,x,2,\n")
    paths = [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]
    rows = io.read_table(spark, paths, "id long, a double, b double", fmt="csv").collect()
    assert [tuple(r) for r in rows] == [(1, 20.0, 10.0), (2, 21.0, None)]
    with pytest.raises(ValueError, match="no column c"):
        io.read_table(spark, paths, "id long, c double", fmt="csv")


def test_parquet_nan_is_missing(spark, tmp_path):
    from tidemark.sources import io
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(path)
    assert io.read_table(spark, path).filter("v IS NULL").count() == 1
    assert io.load_table(spark, str(tmp_path), "t").filter("v IS NULL").count() == 1


def test_order_statistics_on_ties_and_extremes(spark):
    from tidemark.operators.rank import order_statistics
    vals = [1e308, -1e308, 0.0, 5e-324, 1.0, 1.0, 1.0, 2.0, -0.0, 3.0] * 7
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    want = sorted(vals)
    got = order_statistics(df, "v", range(0, len(vals), 6), buckets=4)
    assert got == {r: want[r] for r in range(0, len(vals), 6)}


def test_operators_leave_one_table(spark):
    import numpy as np

    from tidemark.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/tidemark-tables"
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(size=(40, 2)))],
                              "id long, vec array<double>")
    for run in (lambda: cpf.cpf_fit(v, [4]), lambda: knn.approx_knn_edges(v, 3, trees=2, leaf_rows=10)):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = run()
        assert len(set(os.listdir(folder)) - before) == 1
        assert out.count() == len(out.collect()) > 0
