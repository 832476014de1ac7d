"""Likelihood, parsimony and reconstruction over site patterns, partition by partition.

Patterns are rows (pattern, weight); the tree and the model are small and go to every task. A task evaluates all its
patterns at once, node by node in post-order, and Spark adds up the weighted results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.functions.models import SiteRates, SubstitutionModel
from dendrolith.sources.trees import Tree, parse


@dataclass
class TreeArrays:
    """Nodes numbered tips first, parents after their children; the root is last."""

    names: list[str]
    children: list[list[int]]
    parent: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(tree: Tree | str, taxa: Sequence[str]) -> TreeArrays:
        """Tips are numbered in the order of ``taxa``, the order of the states in a pattern."""
        rows = (parse(tree) if isinstance(tree, str) else tree).rows()
        n = sum(r["is_tip"] for r in rows)
        at = {str(t): i for i, t in enumerate(taxa)}
        if sorted(at) != sorted(r["name"] for r in rows if r["is_tip"]):
            raise ValueError("the tree's tips are not the alignment's taxa")
        to = [at[r["name"]] if r["is_tip"] else i for i, r in enumerate(rows)]
        parent, length = np.full(len(rows), -1), np.zeros(len(rows))
        children: list[list[int]] = [[] for _ in rows]
        names = [""] * len(rows)
        for i, r in enumerate(rows):
            names[to[i]] = r["name"]
            length[to[i]] = r["length"] or 0.0
            if r["parent"] is not None:
                parent[to[i]] = to[r["parent"]]
                children[to[r["parent"]]].append(to[i])
        assert n == len(taxa)
        return TreeArrays(names, children, parent, length)

    @property
    def internal(self) -> range:
        return range(len(self.children) - sum(bool(c) for c in self.children), len(self.children))


def tip_vectors(patterns: Sequence[str], n_taxa: int, states: str = "ACGT", sets: dict[str, str] | None = None, width: int = 1) -> np.ndarray:
    """(taxa, patterns, states): ones for the states that a symbol allows; symbols that are not listed allow all."""
    allowed = {s: [s] for s in (states if width == 1 else [])} | {k: list(v) for k, v in (sets or {}).items()}
    own = {s: i for i, s in enumerate(states)}
    table = np.ones((256, len(states)))
    for symbol, members in allowed.items():
        table[ord(symbol)] = 0
        for m in members:
            table[ord(symbol), own[m]] = 1
    codes = np.frombuffer("".join(patterns).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(patterns), n_taxa)
    return table[codes.T]


def lower_partials(tree: TreeArrays, tips: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Partials (category, pattern, state) of every node, log scales (category, pattern), and P (node, category)."""
    p = model.p(np.multiply.outer(tree.length, rates.rates))
    n_cat, n_pat = len(rates.rates), tips.shape[1]
    partials: list[np.ndarray] = [np.broadcast_to(t, (n_cat, *t.shape)) for t in tips]
    scale = np.zeros((n_cat, n_pat))
    for node in tree.internal:
        value = np.ones((n_cat, n_pat, tips.shape[2]))
        for c in tree.children[node]:
            value = value * np.einsum("kij,kpj->kpi", p[c], partials[c])
        top = value.max(axis=2)
        top[top == 0] = 1
        partials.append(value / top[:, :, None])
        scale = scale + np.log(top)
    return partials, scale, p


def pattern_likelihoods(tree: TreeArrays, tips: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
    """Log-likelihood of each pattern and category, without the category's weight: (category, pattern)."""
    partials, scale, _ = lower_partials(tree, tips, model, rates)
    return np.log(np.maximum(partials[-1] @ model.freqs, 1e-300)) + scale


def mixed(by_category: np.ndarray, rates: SiteRates) -> np.ndarray:
    return np.logaddexp.reduce(by_category + np.log(np.maximum(rates.weights, 1e-300))[:, None], axis=0)


def branch_gradients(tree: TreeArrays, tips: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
    """d lnL / d length of every branch and pattern: (node, pattern); the root's row is zero."""
    partials, scale, p = lower_partials(tree, tips, model, rates)
    dp = model.dp(np.multiply.outer(tree.length, rates.rates)) * rates.rates[None, :, None, None]
    upper: dict[int, np.ndarray] = {}
    root = len(tree.children) - 1
    n_cat, n_pat, n = partials[-1].shape
    upper[root] = np.broadcast_to(model.freqs, (n_cat, n_pat, n))
    out = np.zeros((len(tree.children), n_pat))
    for node in reversed(tree.internal):
        moved = {c: np.einsum("kij,kpj->kpi", p[c], partials[c]) for c in tree.children[node]}
        for c in tree.children[node]:
            rest = upper[node]
            for s, m in moved.items():
                if s != c:
                    rest = rest * m
            whole = (rest * moved[c]).sum(axis=2)
            slope = (rest * np.einsum("kij,kpj->kpi", dp[c], partials[c])).sum(axis=2)
            # the scales of both cancel within a category; categories are weighted by their likelihoods
            share = _shares(partials, scale, model, rates)
            out[c] = (share * slope / np.maximum(whole, 1e-300)).sum(axis=0)
            down = np.einsum("kpi,kij->kpj", rest, p[c])
            upper[c] = down / np.maximum(down.max(axis=2, keepdims=True), 1e-300)
    return out


def _shares(partials: list[np.ndarray], scale: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
    joint = np.log(np.maximum(partials[-1] @ model.freqs, 1e-300)) + scale + np.log(np.maximum(rates.weights, 1e-300))[:, None]
    return np.exp(joint - np.logaddexp.reduce(joint, axis=0))


def ancestral_states(tree: TreeArrays, tips: np.ndarray, model: SubstitutionModel, rates: SiteRates) -> np.ndarray:
    """Marginally most probable state of every internal node and pattern."""
    partials, scale, p = lower_partials(tree, tips, model, rates)
    share = _shares(partials, scale, model, rates)
    root = len(tree.children) - 1
    upper = {root: np.broadcast_to(model.freqs, partials[-1].shape)}
    out = []
    for node in reversed(tree.internal):
        joint = upper[node] * partials[node]
        joint = joint / np.maximum(joint.sum(axis=2, keepdims=True), 1e-300)
        out.append((share[:, :, None] * joint).sum(axis=0).argmax(axis=1))
        moved = {c: np.einsum("kij,kpj->kpi", p[c], partials[c]) for c in tree.children[node]}
        for c in tree.children[node]:
            rest = upper[node]
            for s, m in moved.items():
                if s != c:
                    rest = rest * m
            down = np.einsum("kpi,kij->kpj", rest, p[c])
            upper[c] = down / np.maximum(down.max(axis=2, keepdims=True), 1e-300)
    return np.array(out[::-1])


def fitch(tree: TreeArrays, tips: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least number of changes of each pattern, and the state sets (bit masks) of every node."""
    bits = (tips > 0) @ (1 << np.arange(tips.shape[2]))
    sets = list(bits)
    score = np.zeros(tips.shape[1], dtype=np.int64)
    for node in tree.internal:
        kids = tree.children[node]
        now = sets[kids[0]]
        for c in kids[1:]:
            common = now & sets[c]
            score += common == 0
            now = np.where(common == 0, now | sets[c], common)
        sets.append(now)
    return score, sets


def fitch_states(tree: TreeArrays, sets: list[np.ndarray]) -> np.ndarray:
    """A most parsimonious state per node and pattern: the parent's state where allowed, else the lowest."""
    lowest = lambda s: np.log2(s & -s).astype(int)
    out = np.zeros((len(sets), len(sets[0])), dtype=int)
    root = len(sets) - 1
    out[root] = lowest(sets[root])
    for node in range(root - 1, -1, -1):
        above = out[tree.parent[node]]
        out[node] = np.where((sets[node] >> above) & 1, above, lowest(sets[node]))
    return out


class PatternTask:
    """Shared plumbing: patterns come in batches, ``work`` returns named columns."""

    def __init__(self, tree: TreeArrays, n_taxa: int, states: str = "ACGT", sets: dict[str, str] | None = None):
        self.tree, self.n_taxa, self.states, self.sets = tree, n_taxa, states, sets

    def over(self, patterns: DataFrame, work, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    tips = tip_vectors(b.column("pattern").to_pylist(), self.n_taxa, self.states, self.sets)
                    yield work(b, tips)

        return patterns.select("pattern", F.col("weight").cast("double").alias("weight")).mapInArrow(run, schema)


def site_likelihoods(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, **alphabet) -> DataFrame:
    """(pattern, weight, lnl, rate, category): likelihood, posterior mean rate and most probable category."""

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        by = pattern_likelihoods(tree, tips, model, rates)
        lnl = mixed(by, rates)
        post = np.exp(by + np.log(np.maximum(rates.weights, 1e-300))[:, None] - lnl)
        return pa.RecordBatch.from_arrays([b.column("pattern"), b.column("weight"), pa.array(lnl), pa.array(rates.rates @ post), pa.array(post.argmax(axis=0).astype(np.int32))], names=["pattern", "weight", "lnl", "rate", "category"])

    task = PatternTask(tree, sum(not c for c in tree.children), **alphabet)
    return task.over(patterns, work, "pattern string, weight double, lnl double, rate double, category int")


def log_likelihood(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, **alphabet) -> DataFrame:
    return site_likelihoods(patterns, tree, model, rates, **alphabet).agg(F.sum(F.col("weight") * F.col("lnl")).alias("lnl"))


def gradient(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, **alphabet) -> DataFrame:
    """(node, name, slope): the gradient of the log-likelihood by branch lengths; each task sends one row per branch."""

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        slopes = branch_gradients(tree, tips, model, rates) @ b.column("weight").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(slopes), dtype=np.int32)), pa.array(slopes)], names=["node", "slope"])

    task = PatternTask(tree, sum(not c for c in tree.children), **alphabet)
    return task.over(patterns, work, "node int, slope double").groupBy("node").agg(F.sum("slope").alias("slope"))


def reconstruct(patterns: DataFrame, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, states: str = "ACGT", **alphabet) -> DataFrame:
    """(pattern, weight, states): the most probable states of the internal nodes in order, as a string."""

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        found = ancestral_states(tree, tips, model, rates)
        text = ["".join(states[s] for s in column) for column in found.T]
        return pa.RecordBatch.from_arrays([b.column("pattern"), b.column("weight"), pa.array(text)], names=["pattern", "weight", "states"])

    task = PatternTask(tree, sum(not c for c in tree.children), states, **alphabet)
    return task.over(patterns, work, "pattern string, weight double, states string")


def parsimony(patterns: DataFrame, tree: TreeArrays, **alphabet) -> DataFrame:
    """(pattern, weight, score, states): Fitch score and one most parsimonious reconstruction of all nodes."""
    states = alphabet.get("states", "ACGT")

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        score, sets = fitch(tree, tips)
        text = ["".join(states[s] for s in column) for column in fitch_states(tree, sets).T]
        return pa.RecordBatch.from_arrays([b.column("pattern"), b.column("weight"), pa.array(score), pa.array(text)], names=["pattern", "weight", "score", "states"])

    task = PatternTask(tree, sum(not c for c in tree.children), **alphabet)
    return task.over(patterns, work, "pattern string, weight double, score long, states string")


def simulate(spark, tree: TreeArrays, model: SubstitutionModel, rates: SiteRates, n_sites: int, seed: int = 1, states: str = "ACGT", block: int = 10_000) -> DataFrame:
    """(site, pattern): sites drawn along the tree; a block of sites is seeded by its number, whatever task runs it."""
    p = model.p(np.multiply.outer(tree.length, rates.rates)).cumsum(axis=-1)
    root = len(tree.children) - 1
    n_taxa = sum(not c for c in tree.children)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column("id").to_pylist():
                n = min(block, n_sites - number * block)
                rng = np.random.default_rng([seed, number])
                category = rng.choice(len(rates.weights), n, p=rates.weights / rates.weights.sum())
                state = np.zeros((root + 1, n), dtype=int)
                state[root] = rng.choice(len(states), n, p=model.freqs / model.freqs.sum())
                for node in range(root - 1, -1, -1):
                    rows = p[node][category, state[tree.parent[node]]]
                    state[node] = np.minimum((rows < rng.random(n)[:, None]).sum(axis=1), len(states) - 1)
                text = ["".join(states[s] for s in column) for column in state[:n_taxa].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + number * block), pa.array(text)], names=["site", "pattern"])

    return spark.range(-(-n_sites // block)).mapInArrow(run, "site long, pattern string")
