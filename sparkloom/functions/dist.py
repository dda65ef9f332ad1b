"""Tails of the usual distributions, as small scalar functions for result rows."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

NORMAL = NormalDist()


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Lower regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _stirling_error(n: int) -> float:
    """ln(n!) less Stirling's formula; the series' next term is below 1e-16 from 16 on."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * n * n)) / (n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without loss where they are close."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, i = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * i + 1)
        if more == total:
            return total
        total, i = more, i + 1


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of a fair coin: by integers up to 1000 throws; beyond, the term of ``k`` by its saddle point
    and the smaller ones by their ratios, until they no longer count."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    if n <= 1000:
        return min(1.0, 2 * (sum(math.comb(n, i) for i in range(k + 1)) / 2**n))
    if k == 0:
        return 2 * 0.5**n if n < 1075 else 0.0
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2)
    top = math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))
    total, term, i = 1.0, 1.0, k
    while i > 0:
        term *= i / (n - i + 1)
        i -= 1
        if term < total * 1e-18:
            break
        total += term
    return min(1.0, 2 * top * total)


def wilcoxon_exact(w: float, ranks: list[float]) -> float:
    """Two-sided p of the smaller signed-rank sum, by all sign patterns (up to 20 pairs) or the normal law."""
    n, total = len(ranks), sum(ranks)
    if n == 0:
        return 1.0
    if n <= 20:
        hits = sum(min(s := sum(r for r, on in zip(ranks, signs) if on), total - s) <= w + 1e-9 for signs in itertools.product((0, 1), repeat=n))
        return min(1.0, hits / 2**n)
    var = sum(r * r for r in ranks) / 4
    return normal_sf2((w - total / 2) / math.sqrt(var))


def studentized_range_sf(q: float, k: int) -> float:
    """Upper tail of the studentised range of k normal means, infinite degrees of freedom."""
    steps, low, high = 4000, -8.0, 8.0
    h = (high - low) / steps
    total = 0.0
    for i in range(steps + 1):
        z = low + i * h
        weight = 1 if i in (0, steps) else 4 if i % 2 else 2
        total += weight * NORMAL.pdf(z) * (NORMAL.cdf(z) - NORMAL.cdf(z - q)) ** (k - 1)
    return max(0.0, 1 - k * total * h / 3)


def studentized_range_ppf(p: float, k: int) -> float:
    low, high = 0.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - studentized_range_sf(mid, k) < p else (low, mid)
    return (low + high) / 2
