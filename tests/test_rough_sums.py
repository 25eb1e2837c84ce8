"""Manhattan neighbours by whole-number distances first (F2)."""

import numpy as np
import pytest

from tidemark.operators import cells, knn

KINDS = {
    "normal": lambda rng, s: rng.normal(size=s),
    "ties": lambda rng, s: rng.integers(0, 3, s).astype(float),
    "far from zero": lambda rng, s: rng.normal(size=s) * 1e-9 + 1e6,
    "one point": lambda rng, s: np.ones(s),
    "an outlier": lambda rng, s: np.where(rng.random(s) < 0.01, 1e12, rng.normal(size=s)),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("bounded", [False, True])
def test_same_as_brute_force(kind, bounded):
    rng = np.random.default_rng(7)
    for n, m, dims, k in ((1, 1, 1, 1), (90, 140, 64, 5), (60, 300, 3, 4), (40, 3, 9, 5)):
        q, r, ids = KINDS[kind](rng, (n, dims)), KINDS[kind](rng, (m, dims)), rng.permutation(m)
        d = cells.distances(q, r, "manhattan")
        bound = np.quantile(d, 0.2, axis=1) if bounded else np.full(n, np.inf)
        got = knn._topk(np.arange(n), q, bound, ids, r, k, "manhattan")
        want = [(i, ids[j], d[i, j]) for i in range(n) for j in np.lexsort((ids, d[i]))[:k]
                if d[i, j] <= bound[i] * (1 + cells.SLACK)]
        assert list(zip(got.src, got.dst, got.dist)) == want
        rough = cells.RoughSums(q, r)
        if rough.finite:
            part, own, wrong = rough.parts(0, n)
            assert (np.abs(part + own[:, None] - rough.limits(d)) <= wrong[:, None]).all()


def test_few_exact_distances(monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 64))
    exact = []
    pairs = cells.pair_distances
    monkeypatch.setattr(cells, "pair_distances", lambda q, r, at, *a: exact.append(len(at)) or pairs(q, r, at, *a))
    monkeypatch.setattr(knn, "distances", lambda q, r, metric: exact.append(len(q) * len(r)) or cells.distances(q, r, metric))
    knn._topk(np.arange(900), v, np.full(900, np.inf), np.arange(900), v, 5, "manhattan")
    assert sum(exact) < 900 * 40


def test_values_that_are_not_finite():
    v = np.array([[0.0, 1.0], [np.inf, 0.0], [0.5, 1.0], [0.0, 3.0]])
    got = knn._topk(np.arange(4), v[[0, 2, 3]], np.full(3, np.inf), np.arange(4), v, 2, "manhattan")
    assert got.dst.tolist() == [0, 2, 1 + 1, 0, 3, 0]
