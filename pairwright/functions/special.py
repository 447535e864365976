"""Distribution functions that the tests need, with numpy alone."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) * (f - 1) / a


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The t with a two-sided tail of ``p``."""
    low, high = 0.0, 1.0
    while t_sf2(high, df) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf2(mid, df) > p else (low, mid)
    return (low + high) / 2


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_power(delta: float, df: int, crit: float) -> float:
    """P(|T| > crit) of a noncentral t, by integration over the chi distribution."""
    s = np.linspace(1e-6, 4, 20001)
    log = (df - 1) * np.log(s) - df * s * s / 2
    w = np.exp(log - log.max())
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    inside = cdf(crit * s - delta) - cdf(-crit * s - delta)
    return float(1 - np.trapezoid(w * inside, s) / np.trapezoid(w, s))


def minimal_dz(n: int, alpha: float, power: float = 0.80) -> float:
    """Least standardised paired difference that a two-sided t test of ``n`` pairs finds with ``power``."""
    crit = t_quantile(alpha, n - 1)
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if t_power(mid * math.sqrt(n), n - 1, crit) < power else (low, mid)
    return (low + high) / 2


def wilcoxon_p(w: float, n: int, ties: float = 0.0, zeros: int = 0, exact: bool | None = None) -> float:
    """Two-sided p of the signed-rank statistic W = min(R+, R-).

    Exact (sums of subsets of 1..n) where asked, or for n <= 50 without ties and zeros; else the normal
    approximation without continuity correction, corrected for ties and, after Pratt, for zeros.
    """
    if n == 0:
        return 1.0
    if exact if exact is not None else n <= 50 and ties == 0 and zeros == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: math.floor(w) + 1].sum() / ways.sum()))
    m = n + zeros
    mean = m * (m + 1) / 4 - zeros * (zeros + 1) / 4
    var = m * (m + 1) * (2 * m + 1) / 24 - zeros * (zeros + 1) * (2 * zeros + 1) / 24 - ties / 48
    return normal_sf2((w - mean) / math.sqrt(var)) if var > 0 else 1.0
