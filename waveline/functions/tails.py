"""Tail areas of the t and F distributions for result tables."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_area(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability of a larger absolute t value."""
    return beta_area(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """Probability of a larger F value."""
    return beta_area(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_quantile(share: float, df: float) -> float:
    """The t value with the given share of the distribution below it."""
    if share < 0.5:
        return -t_quantile(1.0 - share, df)
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) / 2.0 < share:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 1.0 - t_two_sided(middle, df) / 2.0 < share:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0
