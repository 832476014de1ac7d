"""Branch profiles, optimised lengths and adjoint gradients against differences of plain likelihoods."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from dendrolith.functions import models as M
from dendrolith.operators import branches as B
from dendrolith.operators import likelihood as L

TREE = "(((a:0.2,b:0.1):0.3,(c:0.25,d:0.4):0.15):0.05,(e:0.3,f:0.35):0.2);"
TAXA = list("abcdef")


@pytest.fixture(scope="module")
def patterns(spark):
    rng = np.random.default_rng(4)
    tree = L.TreeArrays.of(TREE, TAXA)
    drawn = L.simulate(spark, tree, M.hky(3.0, [0.1, 0.2, 0.3, 0.4]), M.rate_categories("gamma", 4, 0.7), 300, seed=2)
    rows = [(r["pattern"][:5] + ("-" if rng.random() < 0.1 else r["pattern"][5]), 1) for r in drawn.collect()]
    return spark.createDataFrame(rows, "pattern string, weight long").groupBy("pattern").sum("weight").toDF("pattern", "weight").repartition(3).cache()


def lnl(patterns, tree, model, rates) -> float:
    rows = patterns.collect()
    tips = L.tip_vectors([r["pattern"] for r in rows], 6)
    return float(L.mixed(L.pattern_likelihoods(tree, tips, model, rates), rates) @ np.array([r["weight"] for r in rows]))


MODELS = {
    "gtr": (M.gtr([1.2, 3.0, 0.8, 0.9, 3.3], [0.1, 0.2, 0.3, 0.4]), M.rate_categories("gamma", 4, 0.7, invariant=0.1)),
    "jc69": (M.jc69(), M.rate_categories()),
    "unrestricted": (M.unrestricted(np.array([[0, 1, 2, 0.5], [0.3, 0, 0.7, 1], [2, 0.2, 0, 0.4], [1, 1.5, 0.3, 0]])), M.free_rates([0.5, 2.0], [0.6, 0.4])),
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_profiles(patterns, name):
    model, rates = MODELS[name]
    tree = L.TreeArrays.of(TREE, TAXA)
    lengths = np.multiply.outer(tree.length, [0.3, 1.0, 3.0])
    rows = B.profiles(patterns, tree, model, rates, lengths).collect()
    assert len(rows) == 10 * 3
    for r in rows:
        def at(t, node=r["node"]):
            moved = tree.length.copy()
            moved[node] = t
            return lnl(patterns, replace(tree, length=moved), model, rates)

        h = 1e-4
        up, here, down = (at(r["length"] + d) for d in (h, 0, -h))
        assert r["lnl"] == pytest.approx(here, rel=1e-11)
        assert r["slope"] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-4)
        assert r["curvature"] == pytest.approx((up - 2 * here + down) / h**2, rel=1e-3, abs=2e-2)


def test_optimised_lengths(patterns):
    """No branch can gain by moving alone, one long and one short start agree, and the likelihood rises."""
    model, rates = MODELS["jc69"]
    start = L.TreeArrays.of(TREE, TAXA)
    found, best = B.optimise_lengths(patterns, replace(start, length=np.full(11, 0.5)), model, rates)
    other, again = B.optimise_lengths(patterns, replace(start, length=np.full(11, 0.01)), model, rates)
    assert best == pytest.approx(lnl(patterns, found, model, rates), rel=1e-11)
    assert again == pytest.approx(best, abs=1e-4)
    assert best > lnl(patterns, start, model, rates)
    for node in range(10):
        for factor in (0.9, 1.1):
            moved = found.length.copy()
            moved[node] = moved[node] * factor + 1e-6
            assert lnl(patterns, replace(found, length=moved), model, rates) <= best + 1e-4


def test_adjoint_gradients(patterns):
    """Lengths, rate matrix, frequencies and site rates, each against differences of the likelihood."""
    tree = L.TreeArrays.of(TREE, TAXA)

    def model(theta):
        freqs = np.append(theta[5:8], 1 - sum(theta[5:8]))
        return M.gtr(theta[:5], freqs)

    def rates(theta):
        return M.rate_categories("weibull", 4, theta[0], invariant=theta[1])

    theta, site = np.array([1.2, 3.0, 0.8, 0.9, 3.3, 0.1, 0.2, 0.3]), np.array([0.7, 0.15])
    found = B.Adjoints.of(B.adjoints(patterns, tree, model(theta), rates(site)), tree, model(theta), rates(site))
    assert found.lnl == pytest.approx(lnl(patterns, tree, model(theta), rates(site)), rel=1e-11)
    want = {r["node"]: r["slope"] for r in L.gradient(patterns, tree, model(theta), rates(site)).collect()}
    slopes = found.by_length(tree, model(theta), rates(site))
    assert slopes == pytest.approx([want[k] for k in range(11)], rel=1e-9, abs=1e-9)
    for values, closed, score in (
        (theta, found.by_model(tree, rates(site), model, theta), lambda x: lnl(patterns, tree, model(x), rates(site))),
        (site, found.by_site_model(tree, model(theta), rates, site), lambda x: lnl(patterns, tree, model(theta), rates(x))),
    ):
        for i in range(len(values)):
            step = np.zeros(len(values))
            step[i] = 1e-5
            assert closed[i] == pytest.approx((score(values + step) - score(values - step)) / 2e-5, rel=1e-5, abs=1e-4)


def test_time_tree_gradients(patterns):
    """Heights, ratios with and without the determinant, and the clock."""
    model, rates = MODELS["jc69"]
    tree = L.TreeArrays.of(TREE, TAXA)
    heights = np.zeros(11)
    heights[:6] = [0.0, 0.1, 0.2, 0.0, 0.05, 0.3]
    for node in tree.internal:
        heights[node] = max(heights[c] for c in tree.children[node]) + 0.2 + 0.05 * node
    timed = B.TimeTree(tree, heights, 0.4)
    found = B.Adjoints.of(B.adjoints(patterns, timed.timed(), model, rates), tree, model, rates)
    slopes = found.by_length(timed.timed(), model, rates)
    from dendrolith.operators import heights as H

    ratios = H.to_ratios(tree.children, tree.parent, heights)

    def score(r, jacobian=False, rate=0.4):
        h = H.from_ratios(tree.children, tree.parent, heights, r)
        return lnl(patterns, B.TimeTree(tree, h, rate).timed(), model, rates) + (H.log_jacobian(tree.children, tree.parent, h) if jacobian else 0.0)

    for jacobian in (False, True):
        closed = timed.by_ratio(slopes, jacobian)
        for node in tree.internal:
            step = np.zeros(11)
            step[node] = 1e-6
            assert closed[node] == pytest.approx((score(ratios + step, jacobian) - score(ratios - step, jacobian)) / 2e-6, rel=1e-5, abs=1e-4)
    assert timed.by_rate(slopes) == pytest.approx((score(ratios, rate=0.4 + 1e-6) - score(ratios, rate=0.4 - 1e-6)) / 2e-6, rel=1e-5)
    each = B.TimeTree(tree, heights, np.full(11, 0.4))
    assert each.by_rate(slopes).sum() == pytest.approx(timed.by_rate(slopes))


def test_hessian(patterns):
    model, rates = MODELS["gtr"]
    tree = L.TreeArrays.of(TREE, TAXA)
    rows = B.length_hessian(patterns, tree, model, rates).collect()
    assert len(rows) == 100
    for r in rows[::7]:
        def at(x, y, a=r["a"], b=r["b"]):
            moved = tree.length.copy()
            moved[a] += x
            moved[b] += y
            return lnl(patterns, replace(tree, length=moved), model, rates)

        h = 1e-3
        mixed = (at(h, h) - at(h, -h) - at(-h, h) + at(-h, -h)) / (4 * h * h)
        assert r["value"] == pytest.approx(mixed, rel=1e-2, abs=0.1)
