"""Exact intervals and tests with numpy alone, as functions of counts."""

from __future__ import annotations

import random
from math import exp, lgamma, log

import numpy as np


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (max(abs(1 + numerator * d), 1e-300) * (1 if 1 + numerator * d >= 0 else -1))
        c = 1 + numerator / c
        c = c if abs(c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval; (nan, nan) for n = 0."""
    if n == 0:
        return float("nan"), float("nan")
    tail = (1 - level) / 2
    return 0.0 if k == 0 else beta_quantile(tail, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k)


def jeffreys(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    tail = (1 - level) / 2
    return beta_quantile(tail, k + 0.5, n - k + 0.5), beta_quantile(1 - tail, k + 0.5, n - k + 0.5)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 by 2 table: all tables no more likely than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    whole = _log_choose(n, col)
    p = lambda x: exp(_log_choose(row, x) + _log_choose(n - row, col - x) - whole)
    here = p(a)
    return min(1.0, sum(q for x in range(max(0, col - (n - row)), min(row, col) + 1) if (q := p(x)) <= here * (1 + 1e-7)))


def bootstrap_mean(values: list[float], resamples: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Percentile bootstrap of a mean with Python's own generator; picks sorted means at int(.025 B) and int(.975 B)."""
    if not values:
        return float("nan"), float("nan")
    draw, n = random.Random(seed), len(values)
    means = sorted(sum(values[draw.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[int(0.025 * resamples)], means[int(0.975 * resamples)]


def histogram_bootstrap(values: np.ndarray, counts: np.ndarray, weights: np.ndarray, resamples: int, seed: int) -> tuple[float, float]:
    """The same for units given by a histogram: each resample is one multinomial draw, so its cost is that of the
    distinct units however many there are.  ``sum(values) / sum(weights)`` is the statistic (weights 1: the mean)."""
    n = int(counts.sum())
    if n == 0:
        return float("nan"), float("nan")
    drawn = np.random.default_rng(seed).multinomial(n, counts / n, size=resamples)
    top, bottom = drawn @ values, drawn @ weights
    with np.errstate(invalid="ignore", divide="ignore"):
        stat = np.where(bottom > 0, top / bottom, np.nan)
    return (float("nan"), float("nan")) if np.isnan(stat).all() else tuple(map(float, np.nanpercentile(stat, [2.5, 97.5])))
