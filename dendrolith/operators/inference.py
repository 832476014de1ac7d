"""Optimisers, samplers and variational fits.

One chain or one search is sequential and runs in one place; chains, rungs, replicates and step sizes are independent and
become rows that Spark hands out, each seeded by its number, so that a lost task can be run again with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.functions.special import qgamma, qnorm
from dendrolith.operators.samples import log_mean_exp

LogDensity = Callable[[np.ndarray], float]


@dataclass
class Stop:
    """Limits of an iterative search."""

    iterations: int = 500
    evaluations: int = 100_000
    tolerance: float = 1e-8


def brent(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-9, rounds: int = 200) -> tuple[float, float]:
    """Least value of f in [low, high], for f with one valley there.

    Three points with the lowest in the middle bracket the valley. The vertex of the parabola through them is tried; where it
    is of no use, or the bracket has not halved in two tries, the longer side is cut in the golden ratio instead."""
    cut = (3 - np.sqrt(5)) / 2
    left, right = float(low), float(high)
    middle = left + cut * (right - left)
    at_left, at_middle, at_right = f(left), f(middle), f(right)
    widths = [right - left, right - left]
    for _ in range(rounds):
        width, least = right - left, tolerance * abs(middle) + 1e-12
        if width <= 4 * least:
            break
        bend = (at_left - at_middle) * (right - middle) + (at_right - at_middle) * (middle - left)
        lean = (at_left - at_middle) * (right - middle) ** 2 - (at_right - at_middle) * (middle - left) ** 2
        trial = middle + lean / (2 * bend) if bend > 0 and np.isfinite(bend) and np.isfinite(lean) else middle
        if not left + least < trial < right - least or abs(trial - middle) < least or width > widths[-2] / 2:
            trial = middle + cut * (right - middle) if right - middle > middle - left else middle - cut * (middle - left)
        at_trial = f(trial)
        if trial < middle:
            if at_trial <= at_middle:
                right, at_right, middle, at_middle = middle, at_middle, trial, at_trial
            else:
                left, at_left = trial, at_trial
        elif at_trial <= at_middle:
            left, at_left, middle, at_middle = middle, at_middle, trial, at_trial
        else:
            right, at_right = trial, at_trial
        widths.append(width)
    value, x = min((at_middle, middle), (at_left, left), (at_right, right))
    return float(x), float(value)


def serial_brent(f: LogDensity, x: np.ndarray, bounds: Sequence[tuple[float, float]], stop: Stop | None = None) -> tuple[np.ndarray, float]:
    """Minimise along each coordinate in turn until a round gains less than the tolerance."""
    stop = stop or Stop()
    x, best = np.array(x, dtype=float), f(np.array(x, dtype=float))
    for _ in range(stop.iterations):
        before = best
        for i, (a, b) in enumerate(bounds):
            def along(u: float, i: int = i) -> float:
                y = x.copy()
                y[i] = u
                return f(y)

            u, value = brent(along, a, b)
            if value < best:
                x[i], best = u, value
        if before - best < stop.tolerance:
            break
    return x, best


def numerical_gradient(f: LogDensity, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    out = np.zeros(len(x))
    for i in range(len(x)):
        step = h * max(1.0, abs(x[i]))
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out


def ridders(f: Callable[[float], float], x: float, h: float = 0.1, rounds: int = 10) -> tuple[float, float]:
    """Derivative by extrapolating central differences, with an error estimate."""
    table = np.zeros((rounds, rounds))
    best, error = 0.0, np.inf
    for i in range(rounds):
        table[0, i] = (f(x + h) - f(x - h)) / (2 * h)
        h /= 1.4
        factor = 1.0
        for j in range(1, i + 1):
            factor *= 1.4**2
            table[j, i] = (table[j - 1, i] * factor - table[j - 1, i - 1]) / (factor - 1)
            e = max(abs(table[j, i] - table[j - 1, i]), abs(table[j, i] - table[j - 1, i - 1]))
            if e <= error:
                error, best = e, table[j, i]
    return float(best), float(error)


def hessian(f: LogDensity, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    n = len(x)
    step = h * np.maximum(1.0, np.abs(x))
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            total = 0.0
            for a, b, sign in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)):
                y = x.copy()
                y[i] += a * step[i]
                y[j] += b * step[j]
                total += sign * f(y)
            out[i, j] = out[j, i] = total / (4 * step[i] * step[j])
    return out


def _line(f: LogDensity, x: np.ndarray, fx: float, direction: np.ndarray, slope: float) -> tuple[float, float]:
    t = 1.0
    for _ in range(60):
        value = f(x + t * direction)
        if np.isfinite(value) and value <= fx + 1e-4 * t * slope:
            return t, value
        t *= 0.5
    return 0.0, fx


def bfgs(f: LogDensity, x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray] | None = None, stop: Stop | None = None) -> tuple[np.ndarray, float]:
    stop = stop or Stop()
    gradient = gradient or (lambda y: numerical_gradient(f, y))
    x = np.array(x, dtype=float)
    fx, g, inverse = f(x), gradient(x), np.eye(len(x))
    for _ in range(stop.iterations):
        direction = -inverse @ g
        if direction @ g >= 0:
            inverse, direction = np.eye(len(x)), -g
        t, value = _line(f, x, fx, direction, float(direction @ g))
        if t == 0 or fx - value < stop.tolerance:
            return (x + t * direction, value) if value < fx else (x, fx)
        s = t * direction
        x, fx = x + s, value
        new = gradient(x)
        y, g = new - g, new
        if (sy := float(s @ y)) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    return x, fx


def conjugate_gradient(f: LogDensity, x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray] | None = None, stop: Stop | None = None) -> tuple[np.ndarray, float]:
    stop = stop or Stop()
    gradient = gradient or (lambda y: numerical_gradient(f, y))
    x = np.array(x, dtype=float)
    fx, g = f(x), gradient(x)
    direction = -g
    for _ in range(stop.iterations):
        if direction @ g >= 0:
            direction = -g
        t, value = brent(lambda u, x=x, d=direction: f(x + u * d), 0.0, 1.0 / max(1.0, float(np.abs(direction).max())) * 10)
        if fx - value < stop.tolerance:
            break
        x, fx = x + t * direction, value
        new = gradient(x)
        direction = -new + max(0.0, float(new @ (new - g) / max(g @ g, 1e-300))) * direction
        g = new
    return x, fx


def meta(steps: Sequence[Callable[[np.ndarray], tuple[np.ndarray, float]]], x: np.ndarray, precision: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Run optimisers in turn until a round gains less than the precision."""
    best = np.inf
    for _ in range(rounds):
        before = best
        for step in steps:
            x, best = step(x)
        if before - best < precision:
            break
    return x, best


def adam(gradient: Callable[[np.ndarray, np.random.Generator], np.ndarray], x: np.ndarray, rate: float, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Stochastic ascent."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        g = gradient(x, rng)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate / np.sqrt(k) ** 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


# proposals: (new value, log Hastings ratio)


def scaler(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    s = size + rng.random() * (1 / size - size)
    y = x.copy()
    y[i] *= s
    return y, -np.log(s)


def slider(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    y = x.copy()
    y[i] += size * rng.standard_normal()
    return y, 0.0


def random_walk(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    y = x.copy()
    y[i] += size * (rng.random() - 0.5)
    return y, 0.0


def simplex_exchange(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    j = (i + 1 + rng.integers(len(x) - 1)) % len(x)
    d = size * rng.random()
    y = x.copy()
    y[i], y[j] = y[i] - d, y[j] + d
    return y, 0.0 if y.min() > 0 else -np.inf


def hamiltonian(f: LogDensity, x: np.ndarray, size: float, rng: np.random.Generator, steps: int = 10) -> tuple[np.ndarray, float]:
    """A leapfrog trajectory; the ratio holds the change of the kinetic energy."""
    p = rng.standard_normal(len(x))
    start = 0.5 * p @ p
    y = x.copy()
    p = p + 0.5 * size * numerical_gradient(f, y)
    for k in range(steps):
        y = y + size * p
        p = p + (size if k + 1 < steps else 0.5 * size) * numerical_gradient(f, y)
    return y, float(start - 0.5 * p @ p)


def flip(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Turn an indicator over."""
    y = x.copy()
    y[i] = 1 - y[i]
    return y, 0.0


def shift(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Move a set indicator to an unset place, which keeps their number; without either, nothing moves."""
    y, on = x.copy(), x > 0.5
    if on.all() or not on.any():
        return y, 0.0
    a, b = rng.choice(np.flatnonzero(on)), rng.choice(np.flatnonzero(~on))
    y[a], y[b] = 0.0, 1.0
    return y, 0.0


def interval(low: float, high: float) -> Callable:
    """A slide that is reflected at the ends of [low, high]."""
    def move(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        y, span = x.copy(), high - low
        at = (x[i] - low + size * (rng.random() - 0.5)) % (2 * span)
        y[i] = low + min(at, 2 * span - at)
        return y, 0.0

    return move


def height(parent: np.ndarray, children: list[list[int]]) -> Callable:
    """A new height of an inner node, anywhere between its highest child and its parent; the root's distance to its highest child is scaled."""
    def move(x: np.ndarray, i: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        y, floor = x.copy(), max(x[c] for c in children[i])
        if parent[i] >= 0:
            y[i] = floor + rng.random() * (x[parent[i]] - floor)
            return y, 0.0
        s = np.exp(size * (rng.random() - 0.5))
        y[i] = floor + s * (x[i] - floor)
        return y, float(np.log(s))

    return move


PROPOSALS = {"flip": flip, "shift": shift, "scaler": scaler, "slider": slider, "random_walk": random_walk, "exchange": simplex_exchange}


def tuned(size: float, accepted: bool, k: int, shrinks: bool, target: float = 0.24) -> float:
    """Nudge a proposal's size toward the target acceptance rate."""
    move = ((1 - target) if accepted else -target) / np.sqrt(k + 1)
    if shrinks:  # a scaler moves farther as its size falls
        return float(np.clip(1 / (1 + np.exp(-(np.log(size / (1 - size)) - move))), 0.01, 0.99))
    return float(size * np.exp(move))


def mcmc(log_prior: LogDensity, log_likelihood: LogDensity, start: np.ndarray, rounds: int, every: int = 10, seed: int = 1, beta: float = 1.0, proposal: str = "random_walk", size: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Metropolis-Hastings with the likelihood raised to ``beta``: logged values, their log-likelihoods, acceptance."""
    rng = np.random.default_rng(seed)
    x = np.array(start, dtype=float)
    prior, like = log_prior(x), log_likelihood(x)
    sizes, accepted = np.full(len(x), size), 0
    kept, lls = [], []
    for k in range(rounds):
        i = int(rng.integers(len(x)))
        y, ratio = PROPOSALS[proposal](x, i, sizes[i], rng)
        new_prior = log_prior(y)
        new_like = log_likelihood(y) if np.isfinite(new_prior) else -np.inf
        alpha = new_prior - prior + (beta * (new_like - like) if beta else 0.0) + ratio
        take = alpha >= 0 or np.log(rng.random()) < alpha
        if take:
            x, prior, like = y, new_prior, new_like
            accepted += 1
        sizes[i] = tuned(sizes[i], take, k, proposal == "scaler")
        if k % every == 0:
            kept.append(x.copy())
            lls.append(like)
    return np.array(kept), np.array(lls), accepted / max(rounds, 1)


def run_rungs(spark: SparkSession, log_prior: LogDensity, log_likelihood: LogDensity, start: Sequence[float], betas: Sequence[float], rounds: int, every: int = 10, seed: int = 1) -> DataFrame:
    """(rung, beta, iter, ll, x): tempered chains, one task per rung."""
    rows = spark.createDataFrame([(i, float(b)) for i, b in enumerate(betas)], "rung int, beta double").repartition(len(betas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rung, beta in zip(b.column("rung").to_pylist(), b.column("beta").to_pylist(), strict=True):
                x, ll, _ = mcmc(log_prior, log_likelihood, np.array(start), rounds, every, seed * 1000 + rung, beta)
                n = len(ll)
                yield pa.RecordBatch.from_arrays([pa.array([rung] * n, pa.int32()), pa.array([beta] * n), pa.array(np.arange(n, dtype=np.int64) * every), pa.array(ll), pa.array(list(x), pa.list_(pa.float64()))], names=["rung", "beta", "iter", "ll", "x"])

    return rows.mapInArrow(run, "rung int, beta double, iter long, ll double, x array<double>")


def temperatures(n: int, shape: float = 0.3) -> list[float]:
    """Inverse temperatures at the quantiles of a Beta(shape, 1) distribution."""
    return [(i / (n - 1)) ** (1 / shape) for i in range(n)]


def nested_sampling(draw_prior: Callable[[np.random.Generator], np.ndarray], log_prior: LogDensity, log_likelihood: LogDensity, live: int = 100, steps: int = 20, seed: int = 1, tolerance: float = 1e-3, rounds: int = 100_000) -> dict[str, float]:
    """Evidence and information: the worst live point is replaced by a walk above its likelihood."""
    rng = np.random.default_rng(seed)
    points = [draw_prior(rng) for _ in range(live)]
    lls = np.array([log_likelihood(p) for p in points])
    log_z, h, log_x, width = -np.inf, 0.0, 0.0, 1.0
    for k in range(rounds):
        worst = int(lls.argmin())
        log_w = log_x + np.log1p(-np.exp(-1 / live))
        new_z = np.logaddexp(log_z, log_w + lls[worst])
        h = np.exp(log_w + lls[worst] - new_z) * lls[worst] + (np.exp(log_z - new_z) * (h + log_z) if np.isfinite(log_z) else 0.0) - new_z
        log_z, log_x = new_z, log_x - 1 / live
        if lls.max() + log_x < log_z + np.log(tolerance):
            break
        spread = np.std(points, axis=0) + 1e-12
        x = points[int(rng.integers(live))].copy()
        lp, ll, moved = log_prior(x), -np.inf, 0
        for _ in range(steps):
            y = x + width * spread * rng.standard_normal(len(x))
            new = log_prior(y)
            if np.isfinite(new) and np.log(rng.random()) < new - lp and (value := log_likelihood(y)) > lls[worst]:
                x, lp, ll, moved = y, new, value, moved + 1
        width = float(np.clip(width * np.exp(moved / steps - 0.4), 0.01, 5.0))
        if moved:
            points[worst], lls[worst] = x, ll
    log_z = np.logaddexp(log_z, log_x + np.logaddexp.reduce(lls) - np.log(live))
    return {"log_z": float(log_z), "information": float(h), "error": float(np.sqrt(max(h, 0) / live)), "rounds": k + 1}


def bridge_sampling(samples: np.ndarray, log_posterior: LogDensity, seed: int = 1, rounds: int = 1000) -> float:
    """Log evidence by the optimal bridge to a normal that is fitted to half of the samples."""
    half = len(samples) // 2
    fit, own = samples[:half], samples[half:]
    mean, cov = fit.mean(axis=0), np.atleast_2d(np.cov(fit.T)) + 1e-12 * np.eye(fit.shape[1])
    chol = np.linalg.cholesky(cov)
    rng = np.random.default_rng(seed)
    drawn = mean + rng.standard_normal((len(own), len(mean))) @ chol.T
    log_q = lambda x: -0.5 * (np.linalg.solve(chol, (x - mean).T) ** 2).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * len(mean) * np.log(2 * np.pi)
    l1 = np.array([log_posterior(x) for x in own]) - log_q(own)
    l2 = np.array([log_posterior(x) for x in drawn]) - log_q(drawn)
    shift = float(np.median(l1))
    r = 0.0
    for _ in range(rounds):
        top = np.logaddexp.reduce(l2 - shift - np.logaddexp(l2 - shift, r))
        bottom = np.logaddexp.reduce(-np.logaddexp(l1 - shift, r))
        new = float(top - bottom)
        if abs(new - r) < 1e-10:
            break
        r = new
    return r + shift


def importance_sampling(log_p: np.ndarray, log_q: np.ndarray) -> float:
    """Log evidence from draws of q."""
    return float(np.logaddexp.reduce(log_p - log_q) - np.log(len(log_p)))


def laplace(log_density: LogDensity, mode: np.ndarray) -> float:
    """Log evidence from the curvature at the mode."""
    h = -hessian(log_density, mode)
    sign, det = np.linalg.slogdet(h)
    return float(log_density(mode) + 0.5 * len(mode) * np.log(2 * np.pi) - 0.5 * det) if sign > 0 else float("nan")


def mean_field(log_density: LogDensity, n: int, seed: int = 1, rounds: int = 500, draws: int = 10, rate: float = 0.1, full_rank: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Normal variational fit by reparameterised gradients: mean, Cholesky factor, evidence lower bound."""
    rng = np.random.default_rng(seed)
    tril = np.tril_indices(n, -1)
    size = 2 * n + (len(tril[0]) if full_rank else 0)

    def factor(theta: np.ndarray) -> np.ndarray:
        out = np.diag(np.exp(theta[n : 2 * n]))
        if full_rank:
            out[tril] = theta[2 * n :]
        return out

    def slope(theta: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out, l = np.zeros(size), factor(theta)
        for _ in range(draws):
            e = rng.standard_normal(n)
            g = numerical_gradient(log_density, theta[:n] + l @ e)
            out[:n] += g
            out[n : 2 * n] += g * e * np.exp(theta[n : 2 * n])
            if full_rank:
                out[2 * n :] += np.outer(g, e)[tril]
        out /= draws
        out[n : 2 * n] += 1  # entropy
        return out

    theta = adam(slope, np.zeros(size), rate, rounds, rng)
    l = factor(theta)
    values = [log_density(theta[:n] + l @ rng.standard_normal(n)) for _ in range(200)]
    bound = float(np.mean(values) + theta[n : 2 * n].sum() + 0.5 * n * (1 + np.log(2 * np.pi)))
    return theta[:n], l, bound


def step_size_race(spark: SparkSession, log_density: LogDensity, n: int, rates: Sequence[float], rounds: int = 100, seed: int = 1) -> DataFrame:
    """(rate, bound): short variational fits with each step size, one task each."""
    rows = spark.createDataFrame([(float(r),) for r in rates], "rate double").repartition(len(rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rate in b.column("rate").to_pylist():
                _, _, bound = mean_field(log_density, n, seed, rounds, rate=rate)
                yield pa.RecordBatch.from_arrays([pa.array([rate]), pa.array([bound])], names=["rate", "bound"])

    return rows.mapInArrow(run, "rate double, bound double")


def inclusion(spark: SparkSession, log_density: LogDensity, n: int, chains: int, rounds: int, seed: int = 1, shifts: float = 0.25) -> DataFrame:
    """(item, chain, share): how often each of n indicators is set, in ``chains`` chains of flips and shifts, each a row.

    ``log_density`` scores a vector of zeros and ones; models with more and with fewer items are visited as they weigh. A
    quarter of the rounds is left out as burn-in. A chain is seeded by its number and may be run again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chain in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, chain])
                x = (rng.random(n) < 0.5).astype(float)
                now, held = log_density(x), np.zeros(n)
                for k in range(rounds):
                    y, ratio = (shift if rng.random() < shifts else flip)(x, int(rng.integers(n)), 1.0, rng)
                    new = log_density(y)
                    if np.log(rng.random()) < new - now + ratio:
                        x, now = y, new
                    if 4 * k >= rounds:
                        held += x
                share = held / (rounds - (rounds + 3) // 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([chain] * n), pa.array(share)], names=["item", "chain", "share"])

    return spark.range(chains, numPartitions=chains).mapInArrow(run, "item long, chain long, share double")


#: Variational families on the positive numbers: draws, their log density, from two positive parameters.
FAMILIES = {
    "gamma": (lambda rng, a, b, n: rng.gamma(a, 1 / b, n), lambda x, a, b: a * np.log(b) - lgamma(a) + (a - 1) * np.log(x) - b * x),
    "weibull": (lambda rng, a, b, n: b * rng.weibull(a, n), lambda x, a, b: np.log(a / b) + (a - 1) * np.log(x / b) - (x / b) ** a),
    "lognormal": (lambda rng, a, b, n: np.exp(np.log(a) + b * rng.standard_normal(n)), lambda x, a, b: -0.5 * ((np.log(x) - np.log(a)) / b) ** 2 - np.log(x * b) - 0.5 * np.log(2 * np.pi)),
}


def multi_sample_bounds(spark: SparkSession, log_density: LogDensity, blocks: Sequence[tuple[str, float, float]], draws: int, sets: int, seed: int = 1, per_task: int = 64) -> DataFrame:
    """(draws, bound, error): the evidence bound with ``draws`` draws in a set, E log mean p / q, over ``sets`` sets, and its
    standard error. One draw gives the usual bound; more of them tighten it towards the log evidence.

    ``blocks`` are independent (family, a, b), a coordinate each. Draws are rows (set, log weight), made block by block of
    sets and seeded by the block's number; sets are logarithmic means and the bound their average."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, number])
                m = min(per_task, sets - number * per_task) * draws
                columns = [FAMILIES[f][0](rng, a, c, m) for f, a, c in blocks]
                log_q = sum(FAMILIES[f][1](x, a, c) for (f, a, c), x in zip(blocks, columns, strict=True))
                log_p = np.array([log_density(x) for x in np.stack(columns, axis=1)])
                yield pa.RecordBatch.from_arrays([pa.array(number * per_task + np.arange(m) // draws), pa.array(log_p - log_q)], names=["set", "w"])

    rows = spark.range(-(-sets // per_task)).mapInArrow(run, "set long, w double")
    each = log_mean_exp(rows, F.col("w"), ["set"], "b")
    return each.agg(F.lit(draws).alias("draws"), F.avg("b").alias("bound"), (F.stddev_samp("b") / F.sqrt(F.count("*"))).alias("error"))


def fit_blocks(log_density: LogDensity, families: Sequence[str], start: Sequence[tuple[float, float]] | None = None, draws: int = 400, seed: int = 1, stop: Stop | None = None) -> list[tuple[str, float, float]]:
    """Blocks of FAMILIES that are close to a density on positive coordinates: the one-draw bound over common random numbers,
    raised by ``bfgs`` over the logarithms of the parameters. Draws move smoothly with the parameters, as they are quantiles
    of fixed uniform numbers."""
    u = np.random.default_rng(seed).random((len(families), draws)).clip(1e-6, 1 - 1e-6)
    quantile = {
        "gamma": lambda p, a, b: np.array([qgamma(float(x), a, b) for x in p]),
        "weibull": lambda p, a, b: b * (-np.log1p(-p)) ** (1 / a),
        "lognormal": lambda p, a, b: a * np.exp(b * np.array([qnorm(float(x)) for x in p])),
    }

    def loss(theta: np.ndarray) -> float:
        pairs = np.exp(np.clip(theta, -20, 20)).reshape(-1, 2)
        x = np.stack([quantile[f](p, a, b) for f, p, (a, b) in zip(families, u, pairs, strict=True)], axis=1).clip(1e-12)
        log_q = sum(FAMILIES[f][1](x[:, j], *pairs[j]) for j, f in enumerate(families))
        return float(-np.mean([log_density(row) for row in x] - log_q))

    begin = np.log(np.array(start if start is not None else [(1.0, 1.0)] * len(families), dtype=float)).ravel()
    theta, _ = bfgs(loss, begin, stop=stop or Stop(iterations=60, tolerance=1e-7))
    return [(f, float(a), float(b)) for f, (a, b) in zip(families, np.exp(theta).reshape(-1, 2), strict=True)]


def simulated_annealing(f: LogDensity, neighbour: Callable, start, seed: int = 1, rounds: int = 2000, hot: float = 1.0, cold: float = 1e-3):
    """Least value of f over states that ``neighbour(state, rng)`` proposes, cooling geometrically."""
    rng = np.random.default_rng(seed)
    x, fx = start, f(start)
    best, fbest = x, fx
    for k in range(rounds):
        temperature = hot * (cold / hot) ** (k / max(rounds - 1, 1))
        y = neighbour(x, rng)
        fy = f(y)
        if fy <= fx or rng.random() < np.exp((fx - fy) / temperature):
            x, fx = y, fy
            if fx < fbest:
                best, fbest = x, fx
    return best, fbest


def genetic_search(fitness: Callable[[np.ndarray], float], length: int, classes: int, seed: int = 1, size: int = 40, rounds: int = 60, mutation: float = 0.05) -> tuple[np.ndarray, float]:
    """Greatest fitness over strings of classes: roulette selection, crossover, mutation, the best one survives."""
    rng = np.random.default_rng(seed)
    people = rng.integers(classes, size=(size, length))
    for _ in range(rounds):
        scores = np.array([fitness(p) for p in people])
        weight = np.exp(scores - scores.max())
        order = rng.choice(size, (size, 2), p=weight / weight.sum())
        cut = rng.integers(1, max(length, 2), size)
        mask = np.arange(length)[None, :] < cut[:, None]
        children = np.where(mask, people[order[:, 0]], people[order[:, 1]])
        change = rng.random(children.shape) < mutation
        children[change] = rng.integers(classes, size=int(change.sum()))
        children[0] = people[int(scores.argmax())]
        people = children
    scores = np.array([fitness(p) for p in people])
    return people[int(scores.argmax())], float(scores.max())
