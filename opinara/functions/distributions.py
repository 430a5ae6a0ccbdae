"""Normal, t and F tail probabilities: single numbers, and arrays for tables of many models."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


@functools.lru_cache(maxsize=65536)
def t_quantile(p: float, df: float) -> float:
    """Quantile for p > 0.5, by bisection on the tail probability."""
    if df <= 0:
        return math.nan
    target, lo, hi = 2.0 * (1.0 - p), 0.0, 2.0
    while t_two_sided(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_two_sided(mid, df) > target else (lo, mid)
    return (lo + hi) / 2.0


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return _NORMAL.cdf(z)


def normal_quantile(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _NORMAL.inv_cdf(p)


def _gammas(values: np.ndarray) -> np.ndarray:
    each, back = np.unique(values, return_inverse=True)
    return np.array([math.lgamma(v) for v in each.tolist()])[back]


def _beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """:func:`_beta_fraction` of arrays; elements leave the loop as they settle."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    out = np.ones(len(x))
    live = np.arange(len(x))
    c, d = np.ones(len(x)), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    out *= d
    for m in range(1, 500):
        p, q, y = a[live], b[live], x[live]
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 / away(1.0 + num * d)
            c = away(1.0 + num / c)
            out[live] *= c * d
        on = np.abs(c * d - 1.0) >= 1e-15
        live, c, d = live[on], c[on], d[on]
        if not len(live):
            break
    return out


def beta_incs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays; NaN where an argument is."""
    shape = np.broadcast_shapes(np.shape(a), np.shape(b), np.shape(x))
    a, b, x = (np.broadcast_to(v, shape).astype(float).ravel() for v in (a, b, x))
    out = np.where(np.isnan(a + b + x), np.nan, np.where(x >= 1.0, 1.0, 0.0))
    at = np.flatnonzero((x > 0) & (x < 1) & (a > 0) & (b > 0))
    a, b, x = a[at], b[at], x[at]
    front = np.exp(_gammas(a + b) - _gammas(a) - _gammas(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
    part = front * _beta_fractions(p, q, y) / p
    out[at] = np.where(low, part, 1.0 - part)
    return out.reshape(shape)


def t_two_sideds(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(df > 0, beta_incs(df / 2.0, 0.5, df / (df + t * t)), np.nan)


def f_uppers(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(d2 > 0, beta_incs(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)), np.nan)


def normal_two_sideds(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z.ravel().tolist()]).reshape(z.shape)
