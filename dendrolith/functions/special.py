"""Distribution functions and quantiles by series, continued fractions and safeguarded Newton steps."""

from __future__ import annotations

from collections.abc import Callable
from math import erf, erfc, exp, inf, lgamma, log, log1p, pi, sqrt

import numpy as np


def pnorm(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * erfc(-(x - mean) / (sd * sqrt(2)))


def qnorm(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return mean + sd * solve(lambda x: pnorm(x) - p, -40.0, 40.0) if 0 < p < 1 else (-inf if p <= 0 else inf)


def solve(f: Callable[[float], float], low: float, high: float) -> float:
    """Root of an increasing function by bisection to the last bits."""
    for _ in range(300):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return high


def pgamma(x: float, shape: float, rate: float = 1.0) -> float:
    """Regularised lower incomplete gamma function."""
    z = x * rate
    if z <= 0:
        return 0.0
    front = exp(-z + shape * log(z) - lgamma(shape))
    if z < shape + 1:
        term = total = 1 / shape
        n = shape
        for _ in range(10_000):
            n += 1
            term *= z / n
            total += term
            if term < total * 1e-16:
                break
        return min(1.0, front * total)
    b, c = z + 1 - shape, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def qgamma(p: float, shape: float, rate: float = 1.0) -> float:
    if p <= 0:
        return 0.0
    if p >= 1:
        return inf
    high = max(1.0, shape)
    while pgamma(high, shape) < p:
        high *= 2
    # small shapes have quantiles near zero: search in logs
    return exp(solve(lambda u: pgamma(exp(u), shape) - p, log(high) - 800, log(high))) / rate


def pbeta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by a continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - pbeta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def qbeta(p: float, a: float, b: float) -> float:
    return solve(lambda x: pbeta(x, a, b) - p, 0.0, 1.0)


def pt(t: float, df: float) -> float:
    tail = 0.5 * pbeta(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def qt(p: float, df: float) -> float:
    high = 2.0
    while pt(high, df) < max(p, 1 - p):
        high *= 2
    return solve(lambda x: pt(x, df) - p, -high, high)


def pchisq(x: float, df: float) -> float:
    return pgamma(x / 2, df / 2)


def qchisq(p: float, df: float) -> float:
    return 2 * qgamma(p, df / 2)


def qexp(p: float, rate: float = 1.0) -> float:
    return -log1p(-p) / rate


def qlnorm(p: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return exp(qnorm(p, mu, sigma))


def qweibull(p: float, shape: float, scale: float = 1.0) -> float:
    return scale * (-log1p(-p)) ** (1 / shape)


def inverse_erf(y: float) -> float:
    return solve(lambda x: erf(x) - y, -6.0, 6.0)


def bell_number(n: int) -> int:
    row = [1]
    for _ in range(n):
        new = [row[-1]]
        for x in row:
            new.append(new[-1] + x)
        row = new
    return row[0]


def combination_at(n: int, k: int, rank: int) -> list[int]:
    """The combination of k out of n with the given lexicographic rank."""
    from math import comb

    out, low = [], 0
    for left in range(k, 0, -1):
        while (block := comb(n - low - 1, left - 1)) <= rank:
            rank -= block
            low += 1
        out.append(low)
        low += 1
    return out


def gauss_laguerre(n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of x^alpha e^-x, from the Jacobi matrix; weights sum to one."""
    k = np.arange(n)
    jacobi = np.diag(2 * k + alpha + 1) + np.diag(np.sqrt(k[1:] * (k[1:] + alpha)), 1) + np.diag(np.sqrt(k[1:] * (k[1:] + alpha)), -1)
    x, v = np.linalg.eigh(jacobi)
    return x, v[0] ** 2


def normal_density(x: float) -> float:
    return exp(-0.5 * x * x) / sqrt(2 * pi)
