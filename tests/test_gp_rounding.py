"""Rounding of the statistics does not end a GP fit (test_gp_interpolates_with_small_noise)."""

import numpy as np
import pytest

from tidemark.operators import gp


@pytest.mark.parametrize("parts", [1, 2, 5, 25])
def test_sums_in_any_order_give_a_model(parts):
    x = np.linspace(0, 3, 25)[:, None]
    y = np.sin(x[:, 0])
    mean = y.mean()
    phi = gp._rbf(x, x, 0.7)
    A = np.zeros((25, 25))
    b = np.zeros(25)
    for rows in np.array_split(np.arange(25), parts):
        A += phi[rows].T @ phi[rows]
        b += phi[rows].T @ (y[rows] - mean)
    A = gp._whole(gp._half(A), 25)
    f, B, K, binv_b = gp._bound(A, b, float(((y - mean) ** 2).sum()), 25, phi + 1e-8 * np.eye(25), 1.0, 1e-6,
                              mend=True)
    assert np.isfinite(f)
    assert np.abs(mean + phi @ binv_b / 1e-6 - y).max() < 1e-3


def test_a_matrix_that_is_not_definite_stays_refused():
    assert gp._definite(np.diag([1.0, -1e-3]), True)[1] is None
    B = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert (gp._definite(B, True)[0] == B).all()
