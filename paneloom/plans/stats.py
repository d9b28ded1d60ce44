"""Tail probabilities of the normal, t and F distributions for the few result rows on the driver."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return float("nan") if df <= 0 or math.isnan(t) else float(beta_cdf(df / 2, 0.5, df / (df + t * t)))


def f_p(f: float, df1: float, df2: float) -> float:
    return float("nan") if df2 <= 0 else beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, df: int) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    s, half = df / 2, x / 2
    term = total = 1 / s
    for k in range(1, 5000):
        term *= half / (s + k)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-half + s * math.log(half) - math.lgamma(s)))
