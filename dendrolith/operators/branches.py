"""Likelihoods as functions of one branch, of all branches at once, and of everything a tree's model depends on.

One pass over the patterns, a batch at a time, keeps lower and upper partials of every node. For a branch they give the
likelihood of a pattern at any length t as a sum of exponentials, sum C exp(mu t), with one term per eigenvalue and rate
category: values and derivatives at as many lengths as one likes cost no further pass. A task adds up what its patterns
bring and sends a row per branch and length; a round of optimisation is one job, whatever the number of branches.

The same pass gives adjoints: the derivative of the log-likelihood by every entry of every branch's transition matrix, by
the root's frequencies and by the weights of the rate categories, summed over patterns. From these few numbers the gradient
by lengths, heights, height ratios, clock, site and substitution parameters follows without reading patterns again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.functions.models import SiteRates, SubstitutionModel
from dendrolith.operators import heights as H
from dendrolith.operators.likelihood import PatternTask, TreeArrays, lower_partials

TINY = 1e-300


@dataclass
class Sweep:
    """Partials of one batch: of every node below it (lower), of every branch from above (rest), shares of the categories."""

    lower: list[np.ndarray]
    rest: dict[int, np.ndarray]
    share: np.ndarray
    lnl: np.ndarray
    whole: np.ndarray


def sweep(tree: TreeArrays, tips: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> Sweep:
    """``rest[c]`` (category, pattern, state of the parent) holds all but the subtree below the branch of c, up to a scale."""
    lower, scale, p = lower_partials(tree, tips, model, rates)
    root = len(tree.children) - 1
    whole = lower[root] @ model.freqs
    joint = np.log(np.maximum(whole, TINY)) + scale + np.log(np.maximum(rates.weights, TINY))[:, None]
    lnl = np.logaddexp.reduce(joint, axis=0)
    upper, rest = {root: np.broadcast_to(model.freqs, lower[root].shape)}, {}
    for node in reversed(tree.internal):
        moved = {c: np.einsum("kij,kpj->kpi", p[c], lower[c]) for c in tree.children[node]}
        for c in tree.children[node]:
            own = upper[node]
            for other, m in moved.items():
                if other != c:
                    own = own * m
            rest[c] = own / np.maximum(own.max(axis=2, keepdims=True), TINY)
            if tree.children[c]:
                upper[c] = np.einsum("kpi,kij->kpj", rest[c], p[c])
    return Sweep(lower, rest, np.exp(joint - lnl), lnl, whole)


def exponential_sums(found: Sweep, c: int, length: float, model: SubstitutionModel, rates: SiteRates) -> tuple[np.ndarray, np.ndarray]:
    """C (pattern, term) and mu (term): the likelihood at length t over that at ``length`` is the sum of C exp(mu t)."""
    left, right = found.rest[c] @ model.left, found.lower[c] @ model.right.T
    terms = left * right  # (category, pattern, eigenvalue)
    mu = np.multiply.outer(rates.rates, model.values)
    now = np.real((terms * np.exp(mu * length)[:, None, :]).sum(axis=2))
    terms = terms * (found.share / np.where(np.abs(now) > TINY, now, np.inf))[:, :, None]
    return terms.transpose(1, 0, 2).reshape(terms.shape[1], -1), mu.ravel()


PROFILE = "node int, at int, length double, lnl double, slope double, curvature double"


def profiles(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, lengths: np.ndarray, **alphabet) -> DataFrame:
    """(node, at, length, lnl, slope, curvature): the log-likelihood and its first two derivatives by one branch, the others as
    they are, at each of the lengths (node, number) asked for."""
    branches = list(range(len(tree.children) - 1))
    lengths = np.asarray(lengths, dtype=float)

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        found, weight = sweep(tree, tips, model, rates), b.column("weight").to_numpy()
        base, rows = found.lnl @ weight, []
        for c in branches:
            terms, mu = exponential_sums(found, c, tree.length[c], model, rates)
            grown = np.exp(np.multiply.outer(mu, lengths[c]))
            value, one, two = (np.real(terms @ (mu[:, None] ** k * grown)) for k in range(3))
            value = np.maximum(value, TINY)
            rows.append((base + weight @ np.log(value), weight @ (one / value), weight @ (two / value - (one / value) ** 2)))
        lnl, slope, curvature = (np.concatenate(x) for x in zip(*rows, strict=True))
        n = lengths.shape[1]
        columns = [pa.array(np.repeat(branches, n).astype(np.int32)), pa.array(np.tile(np.arange(n), len(branches)).astype(np.int32)), pa.array(lengths[branches].ravel()), pa.array(lnl), pa.array(slope), pa.array(curvature)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PROFILE.split(", ")])

    rows = PatternTask(tree, sum(not c for c in tree.children), **alphabet).over(patterns, work, PROFILE)
    return rows.groupBy("node", "at", "length").agg(*[F.sum(c).alias(c) for c in ("lnl", "slope", "curvature")])


def newton_steps(profile: DataFrame, low: float = 1e-8, high: float = 100.0) -> DataFrame:
    """(node, length, step): the Newton step of each branch where it is concave, else towards the slope's side by half or
    twice the length."""
    length, slope, curvature = F.col("length"), F.col("slope"), F.col("curvature")
    to = F.when(curvature < 0, length - slope / curvature).when(slope > 0, 2 * length).otherwise(length / 2)
    return profile.select("node", "length", F.least(F.greatest(to, F.lit(low)), F.lit(high)).alias("step"))


#: Lengths that a round tries on each branch, as multiples of the present one.
FACTORS = (0.05, 0.25, 0.6, 0.85, 1.0, 1.15, 1.6, 4.0, 20.0)


def best_lengths(rows: list, n: int, low: float, high: float) -> np.ndarray:
    """The best length tried on each branch, moved by a Newton step that stays between its neighbours."""
    out = np.zeros(n)
    tried: dict[int, list] = {}
    for r in rows:
        tried.setdefault(r["node"], []).append(r)
    for node, own in tried.items():
        own.sort(key=lambda r: r["length"])
        k = max(range(len(own)), key=lambda j: own[j]["lnl"])
        best = own[k]
        to = best["length"]
        if best["curvature"] < 0:
            to -= best["slope"] / best["curvature"]
        elif best["slope"] > 0:
            to *= 1.5
        else:
            to /= 1.5
        floor, ceiling = own[max(k - 1, 0)]["length"], own[min(k + 1, len(own) - 1)]["length"]
        out[node] = min(max(to, floor if k else low, low), ceiling if k + 1 < len(own) else high, high)
    return out


def optimise_lengths(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, rounds: int = 50, tolerance: float = 1e-6, low: float = 1e-8, high: float = 100.0, **alphabet) -> tuple[TreeArrays, float]:
    """The tree with the branch lengths of greatest likelihood, and the log-likelihood.

    Each round is one job: it scores the present lengths, and for every branch its likelihood at FACTORS times its length.
    All branches move at once towards their own best; where that loses, which coupled branches can cause, the next round
    goes half the way back, so that the log-likelihood never falls. A round that gains under ``tolerance`` ends it."""
    now, before, target, share, best = tree.length.clip(low, high), None, None, 1.0, -np.inf
    for _ in range(rounds):
        now_tree = replace(tree, length=now)
        lengths = np.clip(np.multiply.outer(now, FACTORS), low, high)
        rows = profiles(patterns, now_tree, model, rates, lengths, **alphabet).collect()  # branches times factors
        # equal lengths at a bound were one group in the sums of ``profiles`` only if equal in ``at`` too: every row stands
        score = next(r["lnl"] for r in rows if r["at"] == FACTORS.index(1.0))
        if before is not None and score < best - 1e-12 * abs(best):
            share /= 2
            if share < 1e-3:
                now = before
                break
            now = before + share * (target - before)
            continue
        gained, best, before = score - best, score, now
        if gained < tolerance:
            break
        target, share = best_lengths(rows, len(now), low, high), 1.0
        target[-1] = now[-1]
        now = target
    return replace(tree, length=before if before is not None else now), float(best)


ADJOINT = "kind string, node int, category int, up int, down int, value double"


def adjoints(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, **alphabet) -> DataFrame:
    """(kind, node, category, up, down, value): derivatives of the log-likelihood.

    Kind p: by the entry (up, down) of a branch's transition matrix in a category; f: by the root's frequency of ``up``; w: by
    a category's weight; l: the log-likelihood itself. A row per entry and task is all that is shuffled."""
    branches, root = range(len(tree.children) - 1), len(tree.children) - 1
    n_cat, n = len(rates.rates), len(model.freqs)
    p = model.p(np.multiply.outer(tree.length, rates.rates))

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        found, weight = sweep(tree, tips, model, rates), b.column("weight").to_numpy()
        kinds, nodes, cats, ups, downs, values = [], [], [], [], [], []

        def add(kind: str, node: int, value: np.ndarray, shape: tuple[int, int, int]) -> None:
            k, i, j = np.indices(shape).reshape(3, -1)
            for out, v in ((kinds, np.full(len(k), kind)), (nodes, np.full(len(k), node)), (cats, k), (ups, i), (downs, j), (values, value.ravel())):
                out.append(v)

        for c in branches:
            now = np.einsum("kpi,kij,kpj->kp", found.rest[c], p[c], found.lower[c], optimize=True)
            scaled = found.share * weight / np.where(np.abs(now) > TINY, now, np.inf)
            add("p", c, np.einsum("kp,kpi,kpj->kij", scaled, found.rest[c], found.lower[c], optimize=True), (n_cat, n, n))
        share = found.share * weight / np.where(found.whole > TINY, found.whole, np.inf)
        add("f", root, np.einsum("kp,kpi->i", share, found.lower[root]), (1, n, 1))
        add("w", root, (found.share @ weight) / np.maximum(rates.weights, TINY), (n_cat, 1, 1))
        add("l", root, np.array([found.lnl @ weight]), (1, 1, 1))
        columns = [pa.array(np.concatenate(kinds)), *[pa.array(np.concatenate(x).astype(np.int32)) for x in (nodes, cats, ups, downs)], pa.array(np.concatenate(values))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ADJOINT.split(", ")])

    rows = PatternTask(tree, sum(not c for c in tree.children), **alphabet).over(patterns, work, ADJOINT)
    return rows.groupBy("kind", "node", "category", "up", "down").agg(F.sum("value").alias("value"))


@dataclass
class Adjoints:
    """The adjoints of one tree and model as arrays."""

    p: np.ndarray
    freqs: np.ndarray
    weights: np.ndarray
    lnl: float

    @staticmethod
    def of(rows: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates) -> Adjoints:
        n, n_cat = len(model.freqs), len(rates.rates)
        out = Adjoints(np.zeros((len(tree.children), n_cat, n, n)), np.zeros(n), np.zeros(n_cat), 0.0)
        for r in rows.collect():  # branches times categories times squared states
            if r["kind"] == "p":
                out.p[r["node"], r["category"], r["up"], r["down"]] = r["value"]
            elif r["kind"] == "f":
                out.freqs[r["up"]] = r["value"]
            elif r["kind"] == "w":
                out.weights[r["category"]] = r["value"]
            else:
                out.lnl = r["value"]
        return out

    def by_length(self, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
        """Of every branch; the root has none."""
        dp = model.dp(np.multiply.outer(tree.length, rates.rates)) * rates.rates[None, :, None, None]
        return (self.p * dp).sum(axis=(1, 2, 3))

    def by_rates(self, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
        """Of every category's rate."""
        dp = model.dp(np.multiply.outer(tree.length, rates.rates)) * tree.length[:, None, None, None]
        return (self.p * dp).sum(axis=(0, 2, 3))

    def by_q(self, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, dq: np.ndarray, dfreqs: np.ndarray | None = None) -> float:
        """Along a direction of the rate matrix (and of the root's frequencies), by the derivative of the exponential in the eigenbasis."""
        t = np.multiply.outer(tree.length, rates.rates)
        e = np.exp(t[..., None] * model.values)
        gap = model.values[:, None] - model.values[None, :]
        near = np.abs(gap) < 1e-9
        part = np.where(near, t[..., None, None] * e[..., :, None], (e[..., :, None] - e[..., None, :]) / np.where(near, 1.0, gap))
        inner = (model.right @ dq @ model.left) * part
        dp = np.real(np.einsum("ia,...ab,bj->...ij", model.left, inner, model.right, optimize=True))
        return float((self.p * dp).sum() + (0.0 if dfreqs is None else self.freqs @ dfreqs))

    def by_model(self, tree: TreeArrays, rates: SiteRates, build: Callable[[np.ndarray], SubstitutionModel], theta: Sequence[float], h: float = 1e-5) -> np.ndarray:
        """By the parameters of a substitution model. Only rate matrices are differenced, never likelihoods."""
        theta = np.asarray(theta, dtype=float)
        model, out = build(theta), np.zeros(len(theta))
        for i in range(len(theta)):
            step = np.zeros(len(theta))
            step[i] = h * max(1.0, abs(theta[i]))
            up, down = build(theta + step), build(theta - step)
            out[i] = self.by_q(tree, model, rates, (up.q - down.q) / (2 * step[i]), (up.freqs - down.freqs) / (2 * step[i]))
        return out

    def by_site_model(self, tree: TreeArrays, model: SubstitutionModel, build: Callable[[np.ndarray], SiteRates], theta: Sequence[float], h: float = 1e-5) -> np.ndarray:
        """By the parameters of the rate categories: their rates and weights are differenced."""
        theta = np.asarray(theta, dtype=float)
        slopes, out = self.by_rates(tree, model, build(theta)), np.zeros(len(theta))
        for i in range(len(theta)):
            step = np.zeros(len(theta))
            step[i] = h * max(1.0, abs(theta[i]))
            up, down = build(theta + step), build(theta - step)
            out[i] = (slopes @ (up.rates - down.rates) + self.weights @ (up.weights - down.weights)) / (2 * step[i])
        return out


@dataclass
class TimeTree:
    """A tree whose branch lengths are a clock's rate times durations; heights grow towards the root."""

    tree: TreeArrays
    heights: np.ndarray
    rate: float | np.ndarray = 1.0

    @property
    def durations(self) -> np.ndarray:
        above = np.where(self.tree.parent >= 0, self.heights[self.tree.parent], self.heights)
        return above - self.heights

    def timed(self) -> TreeArrays:
        return replace(self.tree, length=self.durations * self.rate)

    def by_height(self, by_length: np.ndarray) -> np.ndarray:
        """Of inner nodes; a branch grows with its parent's height and shrinks with its own."""
        moved = by_length * self.rate
        out = -moved
        out[-1] = 0.0
        np.add.at(out, self.tree.parent[:-1], moved[:-1])
        return np.where([bool(c) for c in self.tree.children], out, 0.0)

    def by_ratio(self, by_length: np.ndarray, jacobian: bool = False) -> np.ndarray:
        """By the height ratios of inner nodes and the root's height; with the log-determinant of that transform if asked."""
        by = self.by_height(by_length)
        if jacobian:
            by = by + H.jacobian_height_gradient(self.tree.children, self.tree.parent, self.heights)
        ratios = H.to_ratios(self.tree.children, self.tree.parent, self.heights)
        return H.ratio_gradient(self.tree.children, self.tree.parent, self.heights, ratios, by)

    def by_rate(self, by_length: np.ndarray) -> float | np.ndarray:
        """By the clock's rate; per branch where every branch has its own."""
        each = by_length * self.durations
        return float(each.sum()) if np.ndim(self.rate) == 0 else each


def length_hessian(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, h: float = 1e-5, **alphabet) -> DataFrame:
    """(a, b, value): second derivatives of the log-likelihood by pairs of branch lengths; diagonal entries are closed, others
    are central differences of closed gradients. All shifted trees are scored in the same pass."""
    from dendrolith.operators.likelihood import branch_gradients

    n = len(tree.children) - 1

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        weight, out = b.column("weight").to_numpy(), np.zeros((n, n))
        for c in range(n):
            step = h * max(1.0, tree.length[c])
            sides = []
            for sign in (1, -1):
                moved = tree.length.copy()
                moved[c] += sign * step
                sides.append(branch_gradients(replace(tree, length=moved), tips, model, rates)[:n] @ weight)
            out[c] = (sides[0] - sides[1]) / (2 * step)
        found = sweep(tree, tips, model, rates)
        for c in range(n):
            terms, mu = exponential_sums(found, c, tree.length[c], model, rates)
            value, one, two = (np.real(terms @ (mu**k * np.exp(mu * tree.length[c]))) for k in range(3))
            out[c, c] = weight @ (two / np.maximum(value, TINY) - (one / np.maximum(value, TINY)) ** 2)
        out = (out + out.T) / 2
        a, z = np.indices((n, n)).reshape(2, -1)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(out.ravel())], names=["a", "b", "value"])

    rows = PatternTask(tree, sum(not c for c in tree.children), **alphabet).over(patterns, work, "a int, b int, value double")
    return rows.groupBy("a", "b").agg(F.sum("value").alias("value"))
