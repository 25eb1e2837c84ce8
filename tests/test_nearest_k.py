"""J3 with several nearest sites against plain loops."""

import math
import random

import pytest

from tidemark.operators import enrich


@pytest.mark.parametrize("k, n_sites, cell", [(3, 40, 0.5), (5, 4, None), (2, 1, 3.0)])
def test_k_nearest_sites(spark, k, n_sites, cell):
    r = random.Random(n_sites)
    points = [(i, r.choice([None, r.uniform(-5, 5)]) if i % 9 == 0 else r.uniform(-5, 5), r.uniform(-5, 5))
              for i in range(60)] + [(99, 500.0, -500.0)]
    sites = [(j, round(r.uniform(-5, 5)), round(r.uniform(-5, 5)), f"v{j}") for j in range(n_sites)]
    sites += [(100 + j, sites[0][1], sites[0][2], "same") for j in range(3 if n_sites > 10 else 0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    s = spark.createDataFrame([(a, float(b), float(c), d) for a, b, c, d in sites], "sid long, x double, y double, v string")
    out = enrich.nearest_join(p, s, ["x", "y"], ["x", "y"], "sid", ["v"], cell=cell, k=k)
    got = sorted((x.id, x["rank"] or 0, x.nearest_sid, x.v) for x in out.collect())
    want = []
    for i, a, b in points:
        if a is None:
            want.append((i, 0, None, None))
            continue
        near = sorted((math.dist((a, b), (q[1], q[2])), q[0], q[3]) for q in sites)[:k]
        want += [(i, n + 1, sid, v) for n, (_, sid, v) in enumerate(near)]
    assert got == sorted(want)


def test_no_sites(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    s = spark.createDataFrame([], "sid long, x double, y double, v string")
    assert [x["rank"] for x in enrich.nearest_join(p, s, ["x", "y"], ["x", "y"], "sid", k=2).collect()] == [None]
