"""Distribution functions for test statistics.

Applied on the driver to a single aggregated row (a t or F statistic and its
degrees of freedom), or vectorised with NumPy inside Arrow batches
(``norm_ppf``).  SciPy is not available, so the tails are written here from
the textbook definitions: the regularised incomplete beta function by its
continued fraction (modified Lentz), and the normal quantile by Acklam's
rational approximation refined with one Halley step.
"""

from __future__ import annotations

import math

import numpy as np


def _betacf(a: float, b: float, x: float, max_iter: int = 500,
            eps: float = 3e-16) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or not math.isfinite(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    if math.isnan(t):
        return None
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f: float | None, d1: float | None, d2: float | None) -> float | None:
    """Upper-tail p-value of an F statistic."""
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return None
    if math.isnan(f):
        return None
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


# Coefficients of Acklam's rational approximation to the
# standard normal quantile (a: numerator, b: denominator of the central
# region; c, d: the tails), and the lower/upper region break point.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile, vectorised (|error| < 1e-12 after the
    refinement step)."""
    p = np.asarray(p, dtype=np.float64)
    x = np.full(p.shape, np.nan)
    lo = (p > 0) & (p < _P_LOW)
    hi = (p > 1 - _P_LOW) & (p < 1)
    mid = (p >= _P_LOW) & (p <= 1 - _P_LOW)
    if lo.any():
        q = np.sqrt(-2 * np.log(p[lo]))
        x[lo] = ((((((_C[0] * q + _C[1]) * q + _C[2]) * q + _C[3]) * q + _C[4]) * q + _C[5])
                 / ((((_D[0] * q + _D[1]) * q + _D[2]) * q + _D[3]) * q + 1))
    if hi.any():
        q = np.sqrt(-2 * np.log1p(-p[hi]))
        x[hi] = -((((((_C[0] * q + _C[1]) * q + _C[2]) * q + _C[3]) * q + _C[4]) * q + _C[5])
                  / ((((_D[0] * q + _D[1]) * q + _D[2]) * q + _D[3]) * q + 1))
    if mid.any():
        q = p[mid] - 0.5
        r = q * q
        x[mid] = ((((((_A[0] * r + _A[1]) * r + _A[2]) * r + _A[3]) * r + _A[4]) * r + _A[5]) * q
                  / (((((_B[0] * r + _B[1]) * r + _B[2]) * r + _B[3]) * r + _B[4]) * r + 1))
    x[p == 0] = -np.inf
    x[p == 1] = np.inf
    ok = np.isfinite(x)
    if ok.any():
        xv = x[ok]
        erfc = np.vectorize(math.erfc, otypes=[np.float64])
        e = 0.5 * erfc(-xv / math.sqrt(2.0)) - p[ok]
        u = e * math.sqrt(2 * math.pi) * np.exp(xv * xv / 2.0)
        x[ok] = xv - u / (1 + xv * u / 2.0)
    return x
