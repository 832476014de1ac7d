"""Time-tree documents: likelihood, population models and priors against plain sums and the operators on event tables."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest

from dendrolith import analysis
from dendrolith.functions import models as M
from dendrolith.operators import branches, coalescent, likelihood
from dendrolith.operators import heights as H

TEXT = "(((p:1.5,q:0.5):2,r:4):1.5,(s:2,t:3.5):1);"
DATES = {"p": 1999.0, "q": 1998.0, "r": 1999.5, "s": 1996.5, "t": 1998.0}
TIPS = sorted(DATES)


@pytest.fixture(scope="module")
def document(spark):
    tree = likelihood.TreeArrays.of(TEXT, TIPS)
    tree.length = tree.length * 0.08
    drawn = likelihood.simulate(spark, tree, M.hky(3.0, [0.3, 0.2, 0.2, 0.3]), M.rate_categories(), 400, seed=6).collect()
    sites = {"id": "sites", "type": "sitepattern", "alignment": {"id": "a", "type": "alignment", "sequences": {n: "".join(r["pattern"][k] for r in drawn) for k, n in enumerate(TIPS)}}}
    model = {"id": "m", "type": "sitemodel", "substitutionmodel": {"id": "sub", "type": "substitutionmodel", "model": "jc69"}}
    number = lambda name, value, **more: {"id": name, "type": "parameter", "value": value, "lower": 0, **more}
    fit = {"id": "fit", "type": "treelikelihood", "include_jacobian": True, "sitepattern": sites, "sitemodel": model, "branchmodel": {"id": "clock", "type": "branchmodel", "model": "strict", "rate": number("rate", 0.08)}, "tree": {"id": "tree", "type": "tree", "time": True, "reparam": "ratios", "newick": TEXT, "dates": DATES}}
    size = {"id": "sizes", "type": "parameter", "dimension": 4, "values": [3.0, 5.0, 2.0, 4.0], "lower": 0}
    parts = [
        fit,
        {"id": "constant", "type": "coalescent", "model": "constant", "tree": "&tree", "parameters": {"n0": number("n0", 4.0)}},
        {"id": "growth", "type": "coalescent", "model": "exponential", "tree": "&tree", "parameters": {"rate": number("g", 0.3), "n0": number("n1", 6.0)}},
        {"id": "ride", "type": "coalescent", "model": "skyride", "tree": "&tree", "parameters": {"sizes": size}},
        {"id": "grid", "type": "coalescent", "model": "skygrid", "cutoff": 6.0, "tree": "&tree", "parameters": {"sizes": "%sizes"}},
        {"id": "linear", "type": "coalescent", "model": "piecewise-linear", "cutoff": 4.0, "tree": "&tree", "parameters": {"sizes": "%sizes"}},
        {"id": "line", "type": "coalescent", "model": "skyline", "groups": [1, 3], "tree": "&tree", "parameters": {"two": {"id": "two", "type": "parameter", "values": [3.0, 5.0]}}},
        {"id": "smooth", "type": "distribution", "distribution": "gmrf", "x": "%sizes", "parameters": {"precision": number("tau", 2.0)}},
        {"id": "scale", "type": "distribution", "distribution": "ctmcscale", "x": "&rate", "tree": "&tree"},
    ]
    return {"all": {"id": "all", "type": "compound", "distributions": parts}, "steps": []}


@pytest.fixture(scope="module")
def done(spark, document):
    return analysis.run(spark, json.dumps(document))


def test_likelihood_and_heights(done):
    fit = done.objects["fit"]
    h = fit.heights.values()
    assert h[:5] == pytest.approx([1999.5 - DATES[n] for n in TIPS])
    tree = likelihood.TreeArrays.of(TEXT, TIPS)
    for k in tree.internal:
        assert h[k] > max(h[c] for c in tree.children[k])
    timed = branches.TimeTree(tree, h, 0.08).timed()
    want = likelihood.log_likelihood(fit.patterns, timed, M.jc69(), M.rate_categories()).first()["lnl"]
    assert fit.log_likelihood() == pytest.approx(want, rel=1e-12)
    assert fit.log_p() == pytest.approx(want + H.log_jacobian(tree.children, tree.parent, h), rel=1e-12)
    assert len(done.objects["ratios"]) == 4
    assert done.objects["all"].log_p() == pytest.approx(sum(p.log_p() for p in done.objects["all"].parts))
    ll, prior = analysis.split_log_p(done.objects["all"])
    assert ll == pytest.approx(want) and prior == pytest.approx(done.objects["all"].log_p() - want)


def test_population_models(spark, done):
    """As the operators on tables of events."""
    h = done.objects["fit"].heights.values()
    events = spark.createDataFrame([(0, float(t), "s" if k < 5 else "c", k) for k, t in enumerate(h)], "tree long, t double, kind string, id long")
    rows, of, sizes = coalescent.intervals(events), done.objects, [3.0, 5.0, 2.0, 4.0]
    lp = lambda df: df.first()["lp"]
    assert of["constant"].log_p() == pytest.approx(lp(coalescent.constant(rows, 4.0)))
    assert of["growth"].log_p() == pytest.approx(lp(coalescent.exponential(rows, 6.0, 0.3)))
    assert of["ride"].log_p() == pytest.approx(lp(coalescent.skyride(rows, sizes)))
    assert of["grid"].log_p() == pytest.approx(lp(coalescent.skygrid(events, sizes, 6.0)))
    assert of["linear"].log_p() == pytest.approx(lp(coalescent.piecewise_linear(events, sizes, 4.0)))
    assert of["line"].log_p() == pytest.approx(lp(coalescent.skyline(rows, [3.0, 5.0], [1, 3])))
    assert of["smooth"].log_p() == pytest.approx(1.5 * math.log(2 / (2 * math.pi)) - (4 + 9 + 4))
    total = float(sum(h[p] - x for x, p in zip(h, likelihood.TreeArrays.of(TEXT, TIPS).parent, strict=True) if p >= 0))
    assert of["scale"].log_p() == pytest.approx(0.5 * math.log(total / math.pi) - 0.5 * math.log(0.08) - 0.08 * total)


def test_optimised_and_sampled(spark, document):
    """A climb over ratios and rate gains; a chain over them stays among valid trees; the logged tree has the durations."""
    made = json.loads(json.dumps(document))
    made["all"]["distributions"] = made["all"]["distributions"][:2]
    made["steps"] = [
        {"id": "climb", "type": "optimizer", "algorithm": "serial", "model": "&all", "parameters": ["%ratios", "&rate", "&n0"]},
        {"id": "walk", "type": "mcmc", "model": "&all", "length": 150, "every": 5, "seed": 3, "operators": [{"id": "o", "type": "operator", "algorithm": "slider", "x": "%ratios"}, {"id": "r", "type": "operator", "algorithm": "scaler", "x": "&rate"}]},
        {"id": "show", "type": "logger", "tree": "&tree"},
    ]
    start = analysis.run(spark, json.dumps(made | {"steps": []})).objects["all"].log_p()
    climbed = analysis.run(spark, json.dumps(made | {"steps": made["steps"][:1]})).objects["all"].log_p()
    assert climbed > start
    done = analysis.run(spark, json.dumps(made))
    chain = done.objects["walk"].toPandas()
    assert len(chain) == 30 and np.isfinite(chain.posterior).all() and chain.filter(like="ratio").to_numpy().min() > 0
    shown = likelihood.TreeArrays.of(done.output[0], TIPS)
    assert shown.length[:5] == pytest.approx(done.objects["fit"].heights.durations()[:5], rel=1e-4)


def test_time_tree_faults(spark, document):
    made = json.loads(json.dumps(document))
    parts = made["all"]["distributions"]
    for bad in ({"model": "none"}, {"model": "skygrid", "cutoff": 0}):
        made["all"]["distributions"] = [parts[0], {**parts[1], **bad}]
        with pytest.raises(ValueError):
            analysis.run(spark, json.dumps(made))
    parts[0]["tree"].pop("time")
    made["all"]["distributions"] = parts[:2]
    with pytest.raises(ValueError):
        analysis.run(spark, json.dumps(made))
