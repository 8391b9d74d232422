"""Distribution functions in plain Python: normal, chi-square, Student t, F."""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt
from statistics import NormalDist

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or tiny)
            c = 1 + n / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2)


def t_sf(t: float, v: float) -> float:
    half = 0.5 * beta_inc(v / 2, 0.5, v / (v + t * t))
    return half if t >= 0 else 1 - half


def f_sf(f: float, a: float, b: float) -> float:
    return beta_inc(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def t_ppf(p: float, v: float) -> float:
    """Quantile of Student's t by bisection."""
    if p == 0.5:
        return 0.0
    low, high = -1.0, 1.0
    while t_sf(low, v) < 1 - p:
        low *= 2
    while t_sf(high, v) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, v) > 1 - p else (low, mid)
    return (low + high) / 2
