"""Intervals, proposals, variational bounds, subsplit networks and searches of this round, against closed or enumerated values."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sweeps import random_tree, under

from dendrolith.functions.special import pnorm, qnorm
from dendrolith.operators import inference, resampling, samples, subsplits, sweeps


def test_normal_columns(spark):
    xs = [-6.0, -2.5, -0.3, 0.0, 1.0, 3.3, 6.4]
    rows = spark.createDataFrame([(x, pnorm(x)) for x in xs], "x double, p double")
    for r in rows.select("x", "p", resampling.normal_probability(F.col("x")).alias("got"), resampling.normal_quantile(F.col("p")).alias("q")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-10)
        if abs(r["x"]) < 5:
            assert r["q"] == pytest.approx(qnorm(r["p"]), abs=1e-7)


def test_bca_intervals(spark):
    """As the function on arrays, for groups of different shapes at once, one of them constant."""
    rng = np.random.default_rng(5)
    data = {"skew": rng.exponential(3, 80).round(1), "even": rng.normal(10, 2, 50), "flat": np.full(20, 4.0)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    boots = {g: np.array([rng.choice(vs, len(vs)).mean() for _ in range(300)]) for g, vs in data.items()}
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    boot = spark.createDataFrame([(g, float(v)) for g, vs in boots.items() for v in vs], "g string, value double")
    found = resampling.bca_intervals(boot, resampling.leave_one_out_means(frame, ["g"], "v"), frame.groupBy("g").agg(F.avg("v").alias("value")), ["g"])
    got = {r["g"]: (r["low"], r["high"]) for r in found.collect()}
    for g, vs in data.items():
        jackknife = np.array([(vs.sum() - v) / (len(vs) - 1) for v in vs])
        assert got[g] == pytest.approx(resampling.bca_interval(jackknife, boots[g], vs.mean()))


def test_smoothed_and_effective_sizes(spark):
    """The forms over many tasks agree with those on arrays; chains that mix badly need several rounds of lags."""
    rng = np.random.default_rng(2)
    chains = {"iid": rng.normal(size=3000), "short": np.array([1.0, 2.0]), "one": np.array([3.0])}
    for name, rho in (("slow", 0.99), ("fast", 0.5)):
        x = np.zeros(6000)
        for k in range(1, len(x)):
            x[k] = rho * x[k - 1] + rng.normal()
        chains[name] = x
    rows = [(c, k, float(v)) for c, vs in chains.items() for k, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "c string, k long, v double").repartition(5)
    got = {r["chain"]: (r["n"], r["ess"]) for r in samples.ess(frame, "c", ["k"], "v", lags=16).collect()}
    for c, vs in chains.items():
        assert got[c] == (len(vs), pytest.approx(samples.ess_of(vs), rel=1e-6))
    roots = {r["c"]: r["lml"] for r in samples.smoothed_harmonic_means(frame.where("c in ('iid', 'fast')"), "c", "v", delta=0.3).collect()}
    for c, v in roots.items():
        assert v == pytest.approx(samples.smoothed_harmonic_mean(chains[c], delta=0.3, tolerance=1e-12), abs=1e-5)


@pytest.mark.parametrize(("f", "low", "high", "at"), [(lambda x: (x - 2) ** 2, -5, 9, 2.0), (lambda x: abs(x - 1.5) ** 1.3, 0, 10, 1.5), (lambda x: x - math.log(x), 1e-3, 50, 1.0), (lambda x: x, 2, 5, 2.0), (lambda x: -x, 2, 5, 5.0), (lambda x: math.cosh(x / 30 - 1), -400, 900, 30.0)])
def test_brent(f, low, high, at):
    calls = []
    x, value = inference.brent(lambda u: calls.append(u) or f(u), low, high)
    assert x == pytest.approx(at, abs=1e-5) and value == pytest.approx(f(at), abs=1e-9)
    assert len(calls) < 120


def test_inclusion_frequencies(spark):
    """Variable selection with a closed evidence: chains of flips agree with the sum over all 64 models."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6))
    y = x[:, 0] * 0.6 - 0.35 * x[:, 3] + rng.normal(size=60)

    def density(on: np.ndarray) -> float:
        chosen = x[:, on > 0.5]
        fit = chosen @ np.linalg.lstsq(chosen, y, rcond=None)[0] if chosen.shape[1] else np.zeros(60)
        return float(-30 * np.log(((y - fit) ** 2).sum()) - 0.5 * chosen.shape[1] * np.log(60))

    models = np.array(list(product([0.0, 1.0], repeat=6)))
    scores = np.array([density(m) for m in models])
    weight = np.exp(scores - scores.max())
    want = (models * weight[:, None]).sum(axis=0) / weight.sum()
    got = inference.inclusion(spark, density, 6, 4, 4000).groupBy("item").agg(F.avg("share").alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(want[r["item"]], abs=0.04)


def test_proposals_keep_their_target():
    """A reflected slide on [2, 5] under a linear density, and heights under a uniform one on a small tree."""
    rng = np.random.default_rng(3)
    move, x, seen = inference.interval(2.0, 5.0), np.array([3.0]), []
    for _ in range(20000):
        y, ratio = move(x, 0, 2.0, rng)
        assert 2 <= y[0] <= 5
        if np.log(rng.random()) < np.log(y[0]) - np.log(x[0]) + ratio:
            x = y
        seen.append(x[0])
    assert np.mean(seen) == pytest.approx((125 - 8) / 3 / ((25 - 4) / 2), abs=0.05)
    parent, children = np.array([3, 3, 4, 4, -1]), [[], [], [], [0, 1], [3, 2]]
    move, h, low, tops = inference.height(parent, children), np.array([0.0, 0.0, 0.0, 0.5, 1.0]), [], []
    for k in range(20000):
        y, ratio = move(h, 3 + k % 2, 1.0, rng)
        # density exp(-2 top) on 0 < inner < top
        if np.log(rng.random()) < -2 * (y[4] - h[4]) + ratio:
            h = y
        low.append(h[3] / h[4])
        tops.append(h[4])
    assert np.mean(low) == pytest.approx(0.5, abs=0.02)
    assert np.mean(tops) == pytest.approx(1.0, abs=0.08)  # x exp(-2x) has mean 1
    x = np.array([1.0, 0.0, 1.0, 0.0])
    assert inference.shift(x, 0, 1.0, rng)[0].sum() == 2 and inference.flip(x, 1, 1.0, rng)[0][1] == 1


def test_multi_sample_bounds(spark):
    """Two positive coordinates with a known evidence: more draws a set come closer, from below; the fit is better than its start."""
    def density(x: np.ndarray) -> float:  # 5 gamma(3, 2) times a half-normal
        return float(np.log(5.0) + 3 * np.log(2) - math.lgamma(3) + 2 * np.log(x[0]) - 2 * x[0] - 0.5 * x[1] ** 2 + 0.5 * np.log(2 / np.pi))

    blocks = [("gamma", 2.0, 1.0), ("weibull", 1.2, 1.0)]
    bounds = [inference.multi_sample_bounds(spark, density, blocks, k, 2000, seed=4).first() for k in (1, 5, 50)]
    assert bounds[0]["bound"] < bounds[1]["bound"] < bounds[2]["bound"] < math.log(5) + 3 * bounds[2]["error"]
    assert bounds[2]["bound"] == pytest.approx(math.log(5), abs=0.03)
    grid = np.linspace(1e-4, 40, 40001)
    step = grid[1] - grid[0]
    for name, a, b, p in (("gamma", 2.0, 1.0, lambda x: 3 * np.log(2) - math.lgamma(3) + 2 * np.log(x) - 2 * x), ("weibull", 1.2, 1.0, lambda x: -0.5 * x**2 + 0.5 * np.log(2 / np.pi))):
        q = inference.FAMILIES[name][1](grid, a, b)
        assert np.exp(q).sum() * step == pytest.approx(1.0, abs=1e-3)
        bounds.append(float((np.exp(q) * (p(grid) - q)).sum() * step))
    assert bounds[0]["bound"] == pytest.approx(math.log(5) + bounds[3] + bounds[4], abs=5 * bounds[0]["error"] + 0.01)
    fitted = inference.fit_blocks(density, ["gamma", "lognormal"], draws=150)
    assert fitted[0][1:] == (pytest.approx(3, rel=0.15), pytest.approx(2, rel=0.15))
    assert inference.multi_sample_bounds(spark, density, fitted, 1, 1000).first()["bound"] > bounds[0]["bound"]


def unrooted_by_hand(es: list, taxa: set) -> dict:
    """Subsplits over all rootings, by rerooting the tree as a graph on each of its branches."""
    links: dict = {}
    root_kids = [c for c, p, _ in es if p == "i0"]
    pairs = [(c, p) for c, p, _ in es if p != "i0"] + [tuple(root_kids)]
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    out: dict = {}

    def below(node, came):
        kids = [n for n in links[node] if n != came]
        if not kids:
            return frozenset([node])
        one, two = (below(k, node) for k in kids)
        key = one | two, frozenset([one, two])
        out[key] = out.get(key, 0) + 1 / len(pairs)
        return one | two

    for a, b in pairs:
        key = frozenset(taxa), frozenset([below(a, b), below(b, a)])
        out[key] = out.get(key, 0) + 1 / len(pairs)
    return out


def test_unrooted_network_and_draws(spark):
    rng = random.Random(11)
    n = 7
    forest = {t: random_tree(random.Random(rng.choice([1, 2, 3])), n) for t in range(9)}
    edges = spark.createDataFrame([(t, *e) for t, es in forest.items() for e in es], "tree long, child string, parent string, length double")
    taxa = spark.createDataFrame([(f"t{k}", k * 11) for k in range(n)], "name string, at long")
    network = subsplits.conditionals(subsplits.unrooted(edges, sweeps.clade_bits(edges, taxa, 2))).cache()
    as_set = lambda bits: frozenset(f"t{(w * 63 + b) // 11}" for w in range(2) for b in range(63) if bits[w] >> b & 1)
    got = {(as_set(r["parent"]), frozenset([as_set(r["one"]), as_set(r["two"])])): r["weight"] for r in network.collect()}
    want: dict = {}
    for es in forest.values():
        for k, v in unrooted_by_hand(es, under(es, "i0")).items():
            want[k] = want.get(k, 0) + v
    assert got == {k: pytest.approx(v) for k, v in want.items()}

    everything = [sum(1 << (k * 11 % 63) for k in range(n) if k * 11 // 63 == w) for w in range(2)]
    drawn = subsplits.draw(network, everything, 3000, seed=5)
    assert drawn.groupBy("sample").count().where(f"count <> {n - 1}").isEmpty()
    share: dict = {frozenset(f"t{k}" for k in range(n)): 1.0}
    table: dict = {}
    for r in network.collect():
        table.setdefault(as_set(r["parent"]), []).append((as_set(r["one"]), as_set(r["two"]), r["share"]))
    for clade in sorted(table, key=len, reverse=True):  # probabilities of clades, from the largest down
        for one, two, p in table[clade]:
            for side in (one, two):
                share[side] = share.get(side, 0.0) + share.get(clade, 0.0) * p
    counted = {as_set(r["clade"]): r["count"] / 3000 for r in drawn.groupBy("clade").count().collect()}
    for clade, p in share.items():
        if len(clade) > 1:
            assert counted.get(clade, 0.0) == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 3000) + 1e-3)
