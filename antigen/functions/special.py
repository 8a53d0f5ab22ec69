"""Quantiles that Spark lacks, by numeric inversion; used for small tables of parameters only."""

from __future__ import annotations

from math import exp, lgamma, log


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile for p over 0.5."""
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return (df * (1 - x) / x) ** 0.5


def clopper_pearson(x: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    tail = (1 - confidence) / 2
    return (0.0 if x == 0 else beta_quantile(tail, x, n - x + 1)), (1.0 if x == n else beta_quantile(1 - tail, x + 1, n - x))


def wilcoxon_p(w: float, n: int) -> float:
    """The two-sided exact p of the signed-rank statistic min(W+, W-) of n differences without ties: how many of the 2^n
    choices of signs give so small a sum of ranks, counted rank by rank."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(counts) - 1, rank - 1, -1):
            counts[total] += counts[total - rank]
    return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)
