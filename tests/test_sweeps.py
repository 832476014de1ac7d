"""Sweeps over collections of trees, and running sums, against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrolith.operators import cluster, heights, scans, sweeps
from dendrolith.sources.trees import Node, Tree


def random_tree(rng: random.Random, n: int, shape: str = "random") -> list[tuple[str, str, float]]:
    """(child, parent, length) of a tree with n tips t0.. and inner nodes i0.., the root i0."""
    open_, edges, inner = ["i0"], [], 1
    parts: list[list[str]] = [[f"t{k}" for k in range(n)]]
    while open_:
        node, tips = open_.pop(), parts.pop()
        at = 1 if shape == "caterpillar" else rng.randint(1, len(tips) - 1)
        for side in (tips[:at], tips[at:]):
            length = rng.choice([0.0, 0.5, 1.0, 2.25]) if rng.random() < 0.3 else rng.random() * 3
            if len(side) == 1:
                edges.append((side[0], node, length))
            else:
                edges.append((f"i{inner}", node, length))
                open_.append(f"i{inner}")
                parts.append(side)
                inner += 1
    return edges


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(3)
    return {0: random_tree(rng, 12), 1: random_tree(rng, 9, "caterpillar"), 2: random_tree(rng, 2), 3: random_tree(rng, 30)}


@pytest.fixture(scope="module")
def edges(spark, forest):
    rows = [(t, *e) for t, es in forest.items() for e in es]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "tree long, child string, parent string, length double").repartition(3).cache()


def parents(es):
    return {c: (p, x) for c, p, x in es}


def kids(es, node):
    return sorted(c for c, p, _ in es if p == node)


def under(es, node):
    below = kids(es, node)
    return {node} if not below else set().union(*(under(es, c) for c in below))


def test_ranks(edges, forest):
    got = {(r["tree"], r["node"]): (r["preorder"], r["postorder"], r["depth"], r["size"]) for r in sweeps.ranks(edges).collect()}
    for t, es in forest.items():
        pre, post = [], []

        def walk(node, depth, es=es, pre=pre, post=post):
            pre.append((node, depth))
            size = 1 + sum(walk(c, depth + 1) for c in kids(es, node))
            post.append((node, size))
            return size

        walk("i0", 0)
        sizes = dict(post)
        for k, (node, depth) in enumerate(pre):
            assert got[t, node] == (k, [n for n, _ in post].index(node), depth, sizes[node])
    assert len(got) == sum(len(es) + 1 for es in forest.values())


def test_clade_bits(spark, edges, forest):
    taxa = spark.createDataFrame([(f"t{k}", k * 7) for k in range(30)], "name string, at long")  # places up to 203: four words
    got = {(r["tree"], r["node"]): (r["bits"], r["n"]) for r in sweeps.clade_bits(edges, taxa, 4).collect()}
    for t, es in forest.items():
        for node in {c for c, _, _ in es} | {"i0"}:
            bits, n = got[t, node]
            tips = under(es, node)
            assert n == len(tips)
            assert {w * 63 + b for w in range(4) for b in range(63) if bits[w] >> b & 1} == {int(x[1:]) * 7 for x in tips}
    with pytest.raises(ValueError, match="not among"):
        sweeps.clade_bits(edges, taxa.where("at < 20"), 4)


def test_loops_are_errors(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "MOST_ROUNDS", 6)
    looped = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "a", 1.0)], "tree long, child string, parent string, length double")
    with pytest.raises(ValueError, match="loop"):
        sweeps.ranks(looped)


def arrays(es):
    """Nodes in an order with parents after children, and the arrays that the single-tree functions take."""
    order, stack = [], ["i0"]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += kids(es, node)
    order.reverse()
    at, above = {n: k for k, n in enumerate(order)}, parents(es)
    parent = np.array([at[above[n][0]] if n in above else -1 for n in order])
    children = [[at[c] for c in kids(es, n)] for n in order]
    far = np.zeros(len(order))
    for k in range(len(order) - 1, -1, -1):
        if parent[k] >= 0:
            far[k] = far[parent[k]] + above[order[k]][1]
    return order, parent, children, far.max() - far


def test_ratios_of_a_collection(edges, forest):
    """Heights to ratios and back, the log-Jacobian and the ratio gradient of all trees at once, against single trees."""
    placed = sweeps.heights_below(sweeps.nodes_of(edges).withColumn("length", F.col("length") + 0.01)).cache()
    inner = sweeps.to_ratios(placed)
    back = {(r["tree"], r["node"]): r["height"] for r in sweeps.from_ratios(inner).collect()}
    ratios = {(r["tree"], r["node"]): r for r in inner.collect()}
    lj = {r["tree"]: r["lj"] for r in sweeps.ratio_log_jacobian(inner).collect()}
    slopes = inner.select("tree", "node", (F.length("node") + F.col("height")).alias("by_height"))
    plain = {(r["tree"], r["node"]): r["slope"] for r in sweeps.ratio_gradients(inner, slopes).collect()}
    whole = {(r["tree"], r["node"]): r["slope"] for r in sweeps.ratio_gradients(inner, slopes, jacobian=True).collect()}
    for t, es in forest.items():
        order, parent, children, h = arrays([(c, p, x + 0.01) for c, p, x in es])
        want = heights.to_ratios(children, parent, h)
        rows = [k for k in range(len(order)) if children[k]]
        by = np.array([len(n) + x if children[k] else 0.0 for k, (n, x) in enumerate(zip(order, h, strict=True))])
        slope = heights.ratio_gradient(children, parent, h, want, by)
        with_j = heights.ratio_gradient(children, parent, h, want, by + heights.jacobian_height_gradient(children, parent, h))
        for k in rows:
            assert ratios[t, order[k]]["ratio"] == pytest.approx(want[k], rel=1e-10)
            assert back[t, order[k]] == pytest.approx(h[k], rel=1e-10)
            assert plain[t, order[k]] == pytest.approx(slope[k], rel=1e-9)
            assert whole[t, order[k]] == pytest.approx(with_j[k], rel=1e-9)
        if len(rows) > 1:
            assert lj[t] == pytest.approx(heights.log_jacobian(children, parent, h), rel=1e-10)


def distances_from(es, node, x):
    """Of every tip, the distance from the point x above ``node``, by walking the tree as a graph."""
    links: dict[str, list] = {}
    for c, p, length in es:
        if c == node:
            links.setdefault("#", []).extend([(c, x), (p, length - x)])
        else:
            links.setdefault(c, []).append((p, length))
            links.setdefault(p, []).append((c, length))
    seen, stack = {"#": 0.0}, ["#"]
    while stack:
        at = stack.pop()
        for to, length in links.get(at, []):
            if to not in seen:
                seen[to] = seen[at] + length
                stack.append(to)
    return {n: d for n, d in seen.items() if n.startswith("t")}


def residual(es, node, x, dates):
    far = distances_from(es, node, x)
    t, d = np.array([dates[k] for k in far if k in dates]), np.array([far[k] for k in far if k in dates])
    slope, intercept = np.polyfit(t, d, 1)
    return float(((d - slope * t - intercept) ** 2).sum()), slope, intercept


def test_roots_on_branches(spark, edges, forest):
    """Every branch of every tree: residuals are the regression's, and no other place on the branch is better."""
    rng = random.Random(8)
    dates = {f"t{k}": 1990 + rng.random() * 20 for k in range(30) if k != 5}
    rows = sweeps.roots_on_branches(edges, spark.createDataFrame(list(dates.items()), "node string, date double")).collect()
    assert len(rows) == sum(len(es) for es in forest.values())
    for r in rows:
        es = forest[r["tree"]]
        if r["tree"] == 2:
            continue
        length = parents(es)[r["node"]][1]
        sse, slope, intercept = residual(es, r["node"], r["distance"], dates)
        assert r["sse"] == pytest.approx(sse, rel=1e-6, abs=1e-7)
        assert (r["slope"], r["intercept"]) == (pytest.approx(slope, rel=1e-6, abs=1e-8), pytest.approx(intercept, rel=1e-6, abs=1e-5))
        assert r["share"] == pytest.approx(r["distance"] / length if length else 0.5)
        others = [residual(es, r["node"], length * s, dates)[0] for s in np.linspace(0, 1, 9)]
        assert r["sse"] <= min(others) + 1e-7


def test_roots_agree_with_rerooting(spark, forest):
    """Rerooted in the middle of the branch beside a tip, the moments are those of the rerooted tree."""
    es = forest[0]
    nodes = {n: Node(n) for n in {c for c, _, _ in es} | {"i0"}}
    for c, p, x in es:
        nodes[c].length = x
        nodes[p].children.append(nodes[c])
    dates = {f"t{k}": float(k * k % 13) for k in range(12)}
    got = cluster.root_to_tip(cluster.reroot(Tree(nodes["i0"]), "t3"), dates)
    sse, slope, _ = residual(es, "t3", parents(es)["t3"][1] / 2, dates)
    assert got["slope"] == pytest.approx(slope)


@pytest.mark.parametrize("by", [["g"], []])
def test_running_sums(spark, by):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k // 2, rng.choice([None, 1, 2, 5]), k) for k in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, k long, v long, id long").repartition(7)
    got = scans.ranked(scans.running(frame, by, ["k", "id"], {"upto": F.col("v")}), by, ["k", "id"]).collect()
    assert len(got) == 400 and set(got[0].asDict()) == {"g", "k", "v", "id", "upto", "rank"}
    for r in got:
        before = [x for x in rows if (not by or x[0] == r["g"]) and (x[1], x[3]) <= (r["k"], r["id"])]
        assert r["upto"] == sum(x[2] or 0 for x in before)
        assert r["rank"] == len(before)
