"""Tail probabilities for the handful of test statistics a report holds."""

from __future__ import annotations

import math
from itertools import count


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz), until
    a term changes nothing. It needs about sqrt(max(a, b)) terms."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in count(1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# From so many degrees of freedom on, F and t differ from their limits, chi-square
# and normal, by less than the cancelling logarithms of beta_cdf would.
_LIMIT = 1e9


def _gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in count(1):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in count(1):
        b += 2
        num = -k * (k - a)
        d = 1 / ((b + num * d) or tiny)
        c = (b + num / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h


def t_two_sided(t: float, df: float) -> float:
    return normal_two_sided(t) if df >= _LIMIT else beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    if df2 >= _LIMIT:
        return _gamma_upper(df1 / 2.0, df1 * f / 2.0)
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)
