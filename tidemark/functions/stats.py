"""Statistics that neither Spark nor numpy have: ridge with leave-one-out choice of its penalty, the tail of Student's t,
autocorrelation-robust errors of a mean. Pure numpy, for small ordered samples or one cross-section at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 with ties averaged; NaN stays NaN."""
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    v, where, n = np.unique(x[ok], return_inverse=True, return_counts=True)
    top = np.cumsum(n)
    out[ok] = (top - (n - 1) / 2.0)[where] if len(v) else []
    return out


def ridge_loo(x: np.ndarray, y: np.ndarray, penalties: Sequence[float]) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, penalty) of the ridge on columns of mean 0; the intercept is not penalised.

    The penalty has the least mean squared leave-one-out error, which needs no refits: with the singular value
    decomposition of x the error of row i is its residual / (1 - leverage). Of equal errors the smaller penalty wins.
    """
    mean = float(y.mean())
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    uy = u.T @ (y - mean)
    best = (math.inf, None, 0.0)
    for a in penalties:
        shrink = s**2 / (s**2 + a)
        left = (y - mean) - u @ (shrink * uy)
        lever = 1.0 / len(y) + (u**2) @ shrink
        error = float(np.mean((left / np.maximum(1 - lever, 1e-12)) ** 2))
        if error < best[0]:
            best = (error, vt.T @ (s / (s**2 + a) * uy), a)
    return best[1], mean, best[2]


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Chance that Student's t with df degrees of freedom is beyond |t| on either side."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def mean_test(series: Sequence[float], lags: int) -> tuple[float, float, float]:
    """(mean, t, p) of an ordered series with Bartlett-weighted autocovariances up to `lags`; with no lags the usual
    standard error with n - 1. NaN t and p for fewer than two values or no variation."""
    x = np.asarray(series, dtype=float)
    n = len(x)
    if n < 2:
        return (float(x.mean()) if n else math.nan), math.nan, math.nan
    e = x - x.mean()
    if lags <= 0:
        var = float(e @ e) / (n - 1) / n
    else:
        var = float(e @ e)
        for k in range(1, min(lags, n - 1) + 1):
            var += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:-k])
        var /= n * n
    if var <= 0:
        return float(x.mean()), math.nan, math.nan
    t = float(x.mean()) / math.sqrt(var)
    return float(x.mean()), t, t_two_sided(t, n - 1)
