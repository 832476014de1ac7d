"""Consensus and pruned trees against plain loops over sets."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from dendrolith.operators import consensus as K
from dendrolith.operators import sweeps as W
from test_sweeps import kids, parents, random_tree, under

TAXA = [f"t{k}" for k in range(70)]


def shuffled(rng, n):
    """A random tree of n taxa, close to a fixed one: a few tips change places."""
    es = random_tree(random.Random(4), n)
    names = [f"t{k}" for k in range(n)]
    for _ in range(rng.choice([0, 0, 1, 2])):
        a, b = rng.sample(range(n), 2)
        names[a], names[b] = names[b], names[a]
    return [(names[int(c[1:])] if c[0] == "t" else c, p, x) for c, p, x in es]


def compatible(a, b):
    return not (a & b) or a <= b or b <= a


@pytest.mark.parametrize(("n", "least"), [(9, 0.0), (70, 0.15)])
def test_greedy_consensus(spark, n, least):
    rng = random.Random(n)
    forest = {t: shuffled(rng, n) for t in range(14)}
    weight = {t: rng.choice([1.0, 2.0, 0.5]) for t in forest}
    rows = [(t, *e) for t, es in forest.items() for e in es]
    edges = spark.createDataFrame(rows, "tree long, child string, parent string, length double")
    taxa = spark.createDataFrame([(t, k) for k, t in enumerate(TAXA[:n])], "name string, at long")
    clades = W.clade_bits(edges, taxa, 2).where("n > 1")
    weighted = K.weights(clades, spark.createDataFrame(list(weight.items()), "tree long, weight double")).cache()

    want: Counter = Counter()
    for t, es in forest.items():
        for node in {p for _, p, _ in es}:
            want[frozenset(under(es, node))] += weight[t] / sum(weight.values())
    as_set = lambda bits: frozenset(f"t{w * 63 + b}" for w in range(2) for b in range(63) if bits[w] >> b & 1)
    got = {as_set(r["bits"]): (r["weight"], r["bits"]) for r in weighted.collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, (v, _) in got.items()}

    taken: list = []
    for s, (w, _) in sorted(got.items(), key=lambda x: (-x[1][0], x[1][1])):
        if w > least and all(compatible(s, x) for x in taken):
            taken.append(s)
    found = K.greedy(weighted, least).cache()
    assert {as_set(r["bits"]) for r in found.collect()} == set(taken)

    tree = {as_set(r["bits"]): r["parent"] and as_set(r["parent"]) for r in K.tree_of(found, taxa).collect()}
    assert set(tree) == set(taken) | {frozenset([t]) for t in TAXA[:n]}
    for s, p in tree.items():
        above = [x for x in taken if s < x]
        assert p == (min(above, key=len) if above else None)


def plain_pruned(es, kept):
    """By removing nodes one at a time."""
    above = parents(es)
    edges = {c: (p, x) for c, (p, x) in above.items() if under(es, c) & kept}
    root = "i0"
    while True:
        count = Counter(p for p, _ in edges.values())
        single = next((n for n in sorted(count) if count[n] == 1), None)
        if single is None:
            return {(c, p): x for c, (p, x) in edges.items()}
        child = next(c for c, (p, _) in edges.items() if p == single)
        x = edges.pop(child)[1]
        if single in edges:
            p, y = edges.pop(single)
            edges[child] = (p, x + y)
        else:
            root = child
    return root


@pytest.mark.parametrize("own", [False, True])
def test_pruned(spark, own):
    rng = random.Random(3)
    forest = {0: random_tree(rng, 25), 1: random_tree(rng, 25, "caterpillar"), 2: random_tree(rng, 6)}
    keep = {t: {n for n in {c for c, _, _ in es} if n[0] == "t" and int(n[1:]) % 3 == (t if own else 1) % 3} for t, es in forest.items()}
    if not own:
        names = {"t1", "t4", "t7", "t19", "t22"}
        keep = {t: names & {c for c, _, _ in es} for t, es in forest.items()}
        kept = spark.createDataFrame([(n,) for n in names], "node string")
    else:
        kept = spark.createDataFrame([(t, n) for t, ns in keep.items() for n in ns], "tree long, node string")
    edges = spark.createDataFrame([(t, *e) for t, es in forest.items() for e in es], "tree long, child string, parent string, length double")
    got: dict = {}
    for r in K.pruned(edges, kept).collect():
        got.setdefault(r["tree"], {})[r["child"], r["parent"]] = r["length"]
    for t, es in forest.items():
        want = plain_pruned(es, keep[t])
        assert {k: pytest.approx(v) for k, v in want.items()} == got.get(t, {})


def test_conflicts(spark):
    sets = [frozenset(s) for s in ({0, 1}, {1, 2}, {0, 1, 2}, {3}, {64, 0}, {64}, {0, 1, 2, 3, 64})]
    word = lambda s, w: sum(1 << k % 63 for k in s if k // 63 == w)
    rows = [(i, j, [word(a, 0), word(a, 1)], [word(b, 0), word(b, 1)]) for (i, a), (j, b) in combinations(enumerate(sets), 2)]
    frame = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    for r in frame.withColumn("bad", K.conflict(F.col("a"), F.col("b"))).collect():
        assert r["bad"] == (not compatible(sets[r["i"]], sets[r["j"]]))
    assert kids([("a", "r", 1.0)], "r") == ["a"]
