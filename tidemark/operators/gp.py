"""Sparse Gaussian-process regression (M7), collapsed form.

Same prior and likelihood as a sparse variational GP with a constant mean,
a scaled RBF kernel and Gaussian noise, but with the variational
distribution in closed form (Titsias, 2009) and fixed inducing points (an
md5 sample of the training rows), so only three numbers are searched:

* one distributed pass computes the sufficient statistics A = sum phi phi',
  b = sum phi y, y'y, n with phi = k(Z, x) (m values per row; every task sums
  its rows, further tasks add up the upper halves of the tasks' m x m matrices
  and the driver is sent one sum) for a few lengthscales;
* the collapsed bound is evaluated on the driver for a grid of lengthscale,
  output scale and noise (all m x m algebra), the best triple starts L-BFGS on
  their logarithms.  Every evaluation is one pass, whose tasks also sum the
  derivatives of A and b by the lengthscale; the bound never falls;
* prediction is a map-only pass with the m x m posterior broadcast.

The white-noise kernel of some reference variants only adds
``white * outputscale`` to the predictive variance, modelled as such.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators._util import sum_of_parts
from tidemark.operators.clean import sample_n
from tidemark.operators.models import training_partitions


def _rbf(a: np.ndarray, b: np.ndarray, ls: float) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-0.5 * np.maximum(d2, 0.0) / (ls * ls))


def _pack(arrs: list[np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, *arrs)
    return buf.getvalue()


def _unpack(blob: bytes) -> list[np.ndarray]:
    z = np.load(io.BytesIO(blob))
    return [z[f"arr_{i}"] for i in range(len(z.files))]


def _half(a: np.ndarray) -> np.ndarray:
    """The upper half of a symmetric matrix, row by row."""
    return a[np.triu_indices(len(a))]


def _whole(half: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = half
    return out + np.triu(out, 1).T


def _added(rows: DataFrame) -> list[np.ndarray]:
    """Sum of the packed arrays of all tasks, one of which reaches the driver."""
    return sum_of_parts(rows.rdd.map(lambda r: _unpack(bytes(r["blob"]))),
                        lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


@dataclass
class SparseGP:
    features: list[str]
    z: np.ndarray
    lengthscale: float
    outputscale: float
    noise: float
    mean: float
    jitter: float
    white: float
    w: np.ndarray            # sigma^-2 B^-1 b  (predictive mean weights)
    c: np.ndarray            # Kmm^-1 - B^-1    (variance correction)
    bound: float


def sufficient_stats(df: DataFrame, features: Sequence[str], target: str, z: np.ndarray,
                     lengthscales: Sequence[float], mean: float):
    """Per lengthscale: (A, b) with unit output scale, plus y'y and n."""
    feats = list(features)
    zb = df.sparkSession.sparkContext.broadcast(z)
    lss = list(lengthscales)

    def fn(it):
        zz = zb.value
        m = len(zz)
        acc = [np.zeros((m, m)) for _ in lss] + [np.zeros(m) for _ in lss]
        yy, n = 0.0, 0
        for pdf in it:
            x = pdf[feats].to_numpy(dtype=np.float64)
            y = pdf[target].to_numpy(dtype=np.float64) - mean
            for i, ls in enumerate(lss):
                phi = _rbf(x, zz, ls)
                acc[i] += phi.T @ phi
                acc[len(lss) + i] += phi.T @ y
            yy += float(y @ y)
            n += len(y)
        halves = [_half(a) for a in acc[:len(lss)]]
        yield pd.DataFrame({"blob": [_pack(halves + acc[len(lss):] + [np.array([yy, n])])]})

    rows = df.select(*feats, target).mapInPandas(fn, "blob binary")
    tot = _added(rows)
    L = len(lss)
    return [_whole(h, len(z)) for h in tot[:L]], tot[L:2 * L], float(tot[-1][0]), int(tot[-1][1])


def _definite(B: np.ndarray, mend: bool):
    """``B`` and its Cholesky factor.  K + A / noise is positive definite, but
    its rounding can outweigh the jitter: to ``mend`` it the diagonal is raised
    by the least part of that rounding which helps.  The factor is None beyond it."""
    rounding = len(B) * float(np.finfo(float).eps) * float(np.trace(B))
    for part in (0.0, 2.0 ** -8, 2.0 ** -6, 2.0 ** -4, 2.0 ** -2, 1.0) if mend else (0.0,):
        raised = B + part * rounding * np.eye(len(B))
        try:
            return raised, np.linalg.cholesky(raised)
        except np.linalg.LinAlgError:
            continue
    return B, None


def _bound(A, b, yy, n, kmm, s2, noise, mend=False):
    """Titsias' collapsed lower bound for output scale s2 and noise; -inf where
    a matrix is not positive definite, also not ``mend``ed (``_definite``)."""
    A_s, b_s = A * s2 * s2, b * s2
    K = kmm * s2
    B = K + A_s / noise
    try:
        Lk = np.linalg.cholesky(K)
    except np.linalg.LinAlgError:
        return -np.inf, None, None, None
    B, Lb = _definite(B, mend)
    if Lb is None:
        return -np.inf, None, None, None
    logdet = 2 * np.log(np.diag(Lb)).sum() - 2 * np.log(np.diag(Lk)).sum() + n * np.log(noise)
    binv_b = np.linalg.solve(B, b_s)
    quad = yy / noise - (b_s @ binv_b) / (noise * noise)
    kinv_a = np.linalg.solve(K, A_s)
    trace = (n * s2 - np.trace(kinv_a)) / noise
    f = -0.5 * (n * np.log(2 * np.pi) + logdet + quad + trace)
    return f, B, K, binv_b


def gradient_stats(df: DataFrame, features: Sequence[str], target: str, z: np.ndarray,
                   lengthscale: float, mean: float):
    """(A, b, dA, db) with unit output scale; dA and db are the derivatives by
    the logarithm of the lengthscale.  One pass."""
    feats = list(features)
    zb = df.sparkSession.sparkContext.broadcast(z)

    def fn(it):
        zz = zb.value
        m = len(zz)
        acc = [np.zeros((m, m)), np.zeros(m), np.zeros((m, m)), np.zeros(m)]
        for pdf in it:
            y = pdf[target].to_numpy(dtype=np.float64) - mean
            phi, slope = _rbf_slope(pdf[feats].to_numpy(dtype=np.float64), zz, lengthscale)
            cross = slope.T @ phi
            for a, v in zip(acc, (phi.T @ phi, phi.T @ y, cross + cross.T, slope.T @ y)):
                a += v
        yield pd.DataFrame({"blob": [_pack([_half(acc[0]), acc[1], _half(acc[2]), acc[3]])]})

    rows = df.select(*feats, target).mapInPandas(fn, "blob binary")
    A, by, dA, db = _added(rows)
    zb.unpersist()
    return [_whole(A, len(z)), by, _whole(dA, len(z)), db]


def _rbf_slope(a: np.ndarray, b: np.ndarray, ls: float):
    """The kernel and its derivative by the logarithm of the lengthscale."""
    k = _rbf(a, b, ls)
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return k, k * np.maximum(d2, 0.0) / (ls * ls)


def bound_gradient(stats, yy: float, n: int, z: np.ndarray, theta: np.ndarray, jitter: float):
    """The collapsed bound and its gradient at the logarithms ``theta`` of
    lengthscale, output scale and noise; -inf where a matrix is not positive
    definite.  With k = R + jitter, c = s2 / noise and C = k + c A the bound is
    -1/2 (n log 2 pi noise + log|C| - log|k| + (yy - c b'C^-1 b) / noise
    + c (n - tr k^-1 A))."""
    A, b, dA, db = stats
    ls, s2, noise = np.exp(theta)
    r, dk = _rbf_slope(z, z, ls)
    k, c = r + jitter * np.eye(len(z)), s2 / noise
    C = k + c * A
    try:
        lk, lc = np.linalg.cholesky(k), np.linalg.cholesky(C)
    except np.linalg.LinAlgError:
        return -np.inf, np.zeros(3)
    ik, ic = np.linalg.inv(k), np.linalg.inv(C)
    u = np.linalg.solve(C, b)
    bu, uau, rest = b @ u, u @ A @ u, n - (ik * A).sum()
    g = (n * np.log(2 * np.pi * noise) + 2 * np.log(np.diag(lc)).sum() - 2 * np.log(np.diag(lk)).sum()
         + (yy - c * bu) / noise + c * rest)
    dC = dk + c * dA
    by_ls = ((ic * dC).sum() - (ik * dk).sum() - c / noise * (2 * u @ db - u @ dC @ u)
             + c * ((ik @ dk @ ik * A).sum() - (ik * dA).sum()))
    by_s2 = c * (ic * A).sum() - c / noise * (bu - c * uau) + c * rest
    by_noise = (n - c * (ic * A).sum() + (2 * c * bu - c * c * uau - yy) / noise - c * rest)
    return -0.5 * g, -0.5 * np.array([by_ls, by_s2, by_noise])


def climb(value, start: np.ndarray, steps: int, tolerance: float = 1e-6, memory: int = 6):
    """L-BFGS ascent with halved steps; ``value(x)`` gives function and
    gradient.  The function never falls; ends after ``steps`` steps, or when a
    step gains less than ``tolerance`` of the function's size."""
    x = np.asarray(start, float)
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * -(s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.abs(g).max()))
        for (s, y), a in zip(pairs, reversed(kept)):
            # pairs hold the descent's curvature with the sign of the ascent
            d = d - s * (a + (y @ d) / (s @ y))
        if d @ g <= 0:
            d, pairs = g / max(1.0, float(np.abs(g).max())), []
        d = d * min(1.0, 2.0 / max(float(np.abs(d).max()), 1e-300))
        length = 1.0
        while True:
            fn, gn = value(x + length * d)
            if fn >= f + 1e-4 * length * (d @ g) or length < 1e-3:
                break
            length /= 2
        if not fn > f:
            break
        s, y = length * d, gn - g
        if s @ y < -1e-12:
            pairs = [*pairs[-(memory - 1):], (s, y)]
        gained, x, f, g = fn - f, x + s, fn, gn
        if gained <= tolerance * abs(f):
            break
    return x, f


def fit(df: DataFrame, features: Sequence[str], target: str, id_col: str,
        n_inducing: int = 500, seed: int = 42, lengthscales: Sequence[float] | None = None,
        outputscales: Sequence[float] | None = None, noises: Sequence[float] | None = None,
        jitter: float = 1e-4, white: float = 0.0, steps: int | None = None) -> SparseGP:
    """M7 training on the rows of ``df`` (rows with NULLs skipped).

    ``steps`` bounds the L-BFGS steps after the grid: 20, or 0 (the grid's
    best point as it is) where the caller names a grid.
    """
    feats = list(features)
    if steps is None:
        steps = 0 if lengthscales or outputscales or noises else 20
    d = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in [*feats, target]]).dropna()
    st = d.agg(F.avg(target).alias("m"), F.var_pop(target).alias("v"), F.count(F.lit(1)).alias("n")).first()
    # every task of a pass hands on its matrices
    d = d.coalesce(training_partitions(st["n"], d.sparkSession.sparkContext.defaultParallelism))
    mean, var_y = float(st["m"]), float(st["v"] or 1.0) or 1.0
    zrows = sample_n(d, id_col, n_inducing, seed).select(*feats).collect()
    z = np.array([[float(r[c]) for c in feats] for r in zrows])
    dim = max(1, len(feats))
    lss = list(lengthscales or [0.5 * np.sqrt(dim), np.sqrt(dim), 2 * np.sqrt(dim)])
    s2s = list(outputscales or [var_y])
    nzs = list(noises or [0.01 * var_y, 0.1 * var_y, 0.5 * var_y])
    As, bs, yy, n = sufficient_stats(d, feats, target, z, lss, mean)
    for mend in (False, True):      # only where no point of the grid is definite as it is
        f, ls, s2, nz, A, b = max(
            ((_bound(As[i], bs[i], yy, n, _rbf(z, z, l) + jitter * np.eye(len(z)), s, e, mend)[0], l, s, e, As[i], bs[i])
             for i, l in enumerate(lss) for s in s2s for e in nzs), key=lambda t: t[0])
        if f > -np.inf:
            break
    if steps:
        seen: dict[float, list] = {}   # statistics of the last lengthscale

        def value(theta):
            if theta[0] not in seen:
                seen.clear()
                seen[theta[0]] = gradient_stats(d, feats, target, z, float(np.exp(theta[0])), mean)
            return bound_gradient(seen[theta[0]], yy, n, z, theta, jitter)

        theta, _ = climb(value, np.log([ls, s2, nz]), steps)
        if theta[0] not in seen:
            value(theta)
        ls, s2, nz = map(float, np.exp(theta))
        A, b = seen[theta[0]][:2]
    f, B, K, binv_b = _bound(A, b, yy, n, _rbf(z, z, ls) + jitter * np.eye(len(z)), s2, nz, mend=True)
    w = binv_b / nz
    c = np.linalg.inv(K) - np.linalg.inv(B)
    return SparseGP(feats, z, ls, s2, nz, mean, jitter, white, w, c, float(f))


def predict(df: DataFrame, model: SparseGP, out_prefix: str = "gp_") -> DataFrame:
    """Predictive mean, variance (noise and white term included) and a
    mean +- 2 sd band, one map-only pass."""
    spark = df.sparkSession
    mb = spark.sparkContext.broadcast(model)
    cols = df.columns
    schema = (df.schema.simpleString()[len("struct<"):-1]
              + f",{out_prefix}mean:double,{out_prefix}var:double,"
                f"{out_prefix}lower:double,{out_prefix}upper:double")

    def fn(it):
        m = mb.value
        for pdf in it:
            x = pdf[m.features].to_numpy(dtype=np.float64)
            ok = ~np.isnan(x).any(1)
            mu = np.full(len(pdf), np.nan)
            var = np.full(len(pdf), np.nan)
            if ok.any():
                ks = _rbf(x[ok], m.z, m.lengthscale) * m.outputscale
                mu[ok] = m.mean + ks @ m.w
                var[ok] = (m.outputscale - np.einsum("ij,jk,ik->i", ks, m.c, ks)
                           + m.noise + m.white * m.outputscale)
                var[ok] = np.maximum(var[ok], 0.0)
            sd = np.sqrt(var)
            out = pdf[cols].copy()
            out[f"{out_prefix}mean"] = mu
            out[f"{out_prefix}var"] = var
            out[f"{out_prefix}lower"] = mu - 2 * sd
            out[f"{out_prefix}upper"] = mu + 2 * sd
            yield out

    return df.mapInPandas(fn, schema)
