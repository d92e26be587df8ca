"""Student's t distribution, vectorised over numpy arrays."""

from __future__ import annotations

import math

import numpy as np


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction in Lentz's form."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if not inside.any():
        return out
    p, q, z = a[inside], b[inside], x[inside]
    flip = z > (p + 1) / (p + q + 2)
    p, q, z = np.where(flip, q, p), np.where(flip, p, q), np.where(flip, 1 - z, z)
    tiny = 1e-300
    nonzero = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / nonzero(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / nonzero(1 + even * d), nonzero(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / nonzero(1 + odd * d), nonzero(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) * h / p
    out[inside] = np.where(flip, 1 - value, value)
    return out


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a t statistic; 1 where t is not a number."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    p = betainc(df / 2, np.full_like(df, 0.5), np.where(np.isnan(x), 1.0, x))
    return np.where(np.isnan(t) | np.isnan(df), 1.0, p)
