"""Searches over topologies and roots: candidates are rows, scored in parallel, and the best one is kept."""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.functions.models import SiteRates, SubstitutionModel
from dendrolith.operators import cluster, likelihood
from dendrolith.sources.trees import Node, Tree, parse


def spr(tree: Tree) -> list[Tree]:
    """Subtree prunings with every regrafting, for trees whose inner nodes have two children."""
    out = []
    order = tree.postorder()
    for k, (node, parent) in enumerate(order):
        if parent is None or parent is tree.root:
            continue
        for g in range(len(order)):
            twin = Tree(copy.deepcopy(tree.root))
            nodes = twin.postorder()
            cut, above = nodes[k]
            graft, graft_parent = nodes[g]
            under = {id(n) for n, _ in Tree(cut).postorder()}
            if graft_parent is None or id(graft) in under or graft_parent is above or graft is above:
                continue
            grand = next(p for n, p in nodes if n is above)
            rest = [c for c in above.children if c is not cut]
            if len(rest) != 1 or grand is None:
                continue
            rest[0].length = (rest[0].length or 0.0) + (above.length or 0.0)
            grand.children = [rest[0] if c is above else c for c in grand.children]
            half = (graft.length or 0.0) / 2
            joined = Node(length=half, children=[graft, cut])
            graft_parent.children = [joined if c is graft else c for c in graft_parent.children]
            graft.length = half
            out.append(twin)
    return out


def score_trees(patterns: DataFrame, candidates: Sequence[Tree], taxa: Sequence[str], model: SubstitutionModel | None = None, rates: SiteRates | None = None) -> DataFrame:
    """(candidate, score): Fitch scores, or negative log-likelihoods if a model is given, summed over partitions of patterns."""
    texts = [t.newick() for t in candidates]
    names = list(taxa)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [likelihood.TreeArrays.of(parse(t), names) for t in texts]
        for b in batches:
            if not b.num_rows:
                continue
            tips = likelihood.tip_vectors(b.column("pattern").to_pylist(), len(names))
            weight = b.column("weight").to_numpy()
            if model is None:
                scores = [float(likelihood.fitch(a, tips)[0] @ weight) for a in arrays]
            else:
                scores = [-float(likelihood.mixed(likelihood.pattern_likelihoods(a, tips, model, rates), rates) @ weight) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(scores), dtype=np.int32)), pa.array(scores)], names=["candidate", "score"])

    rows = patterns.select("pattern", F.col("weight").cast("double").alias("weight")).mapInArrow(run, "candidate int, score double")
    return rows.groupBy("candidate").agg(F.sum("score").alias("score"))


def climb(patterns: DataFrame, start: Tree, taxa: Sequence[str], moves=cluster.nni, model: SubstitutionModel | None = None, rates: SiteRates | None = None, rounds: int = 50) -> tuple[Tree, float]:
    """Hill climbing: the best neighbour replaces the tree while it scores less."""
    best, score = start, float(score_trees(patterns, [start], taxa, model, rates).first()["score"])
    for _ in range(rounds):
        candidates = moves(best)
        if not candidates:
            break
        top = score_trees(patterns, candidates, taxa, model, rates).orderBy("score", "candidate").first()
        if top["score"] >= score - 1e-9:
            break
        best, score = candidates[top["candidate"]], float(top["score"])
    return best, score


def best_rates(patterns: DataFrame, tree: likelihood.TreeArrays, model: SubstitutionModel, grid: Sequence[float]) -> DataFrame:
    """(pattern, weight, rate): each pattern's best rate of a grid, one likelihood per rate."""
    rates = SiteRates(np.asarray(grid, dtype=float), np.full(len(grid), 1 / len(grid)))

    def work(b: pa.RecordBatch, tips: np.ndarray) -> pa.RecordBatch:
        by = likelihood.pattern_likelihoods(tree, tips, model, rates)
        return pa.RecordBatch.from_arrays([b.column("pattern"), b.column("weight"), pa.array(rates.rates[by.argmax(axis=0)])], names=["pattern", "weight", "rate"])

    task = likelihood.PatternTask(tree, sum(not c for c in tree.children))
    return task.over(patterns, work, "pattern string, weight double, rate double")


def ranked_roots(spark, tree: Tree, dates: dict[str, float]) -> DataFrame:
    """(tip, slope, intercept, r, root_date) of the rooting beside every tip, best correlation first."""
    text, tips = tree.newick(), [t.name for t in tree.tips()]
    rows = spark.createDataFrame([(t,) for t in tips], "tip string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"tip": t} | cluster.root_to_tip(cluster.reroot(parse(text), t), dates) for t in b.column("tip").to_pylist()]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.mapInArrow(run, "tip string, slope double, intercept double, r double, root_date double").orderBy(F.col("r").desc(), "tip")


def rate_clusters(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 50, seed: int = 1) -> tuple[np.ndarray, float]:
    """Tips dealt to k regression lines through alternating fits: classes and residual sum of squares."""
    rng = np.random.default_rng(seed)
    classes = rng.integers(k, size=len(x))
    total = np.inf
    for _ in range(rounds):
        lines = [np.polyfit(x[classes == c], y[classes == c], 1) if (classes == c).sum() > 1 else (0.0, y.mean()) for c in range(k)]
        errors = np.array([(y - np.polyval(line, x)) ** 2 for line in lines])
        classes, new = errors.argmin(axis=0), float(errors.min(axis=0).sum())
        if new >= total - 1e-12:
            break
        total = new
    return classes, total
