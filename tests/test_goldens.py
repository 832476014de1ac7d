"""Published values, brute force and invariants of the numerical operators."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pytest

from dendrolith.functions import models as M
from dendrolith.functions import special
from dendrolith.operators import cluster, coalescent, inference, likelihood, resampling, samples, trees
from dendrolith.plans import numeric
from dendrolith.plans import standins as S
from dendrolith.sources import config, logs, sequences
from dendrolith.sources import trees as newick

TREE = "(((a:2,b:2):4,c:6):6,d:12);"
#: Four tips at time zero, coalescences at 2, 6 and 12.
EVENTS = [(0, 0.0, "s", i) for i in range(1, 5)] + [(0, 2.0, "c", 5), (0, 6.0, "c", 6), (0, 12.0, "c", 7)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "tree long, t double, kind string, id long")


def lp(df) -> float:
    return df.first()["lp"]


def test_coalescents(events):
    rows = coalescent.intervals(events)
    assert lp(coalescent.constant(rows, 3.0)) == pytest.approx(-13.2958368660, abs=1e-9)
    assert lp(coalescent.constant(rows, 7.0)) == pytest.approx(-10.1234447329, abs=1e-9)
    sizes = [3.0, 10.0, 4.0]
    assert lp(coalescent.skyride(rows, [float(np.log(s)) for s in sizes], log_space=True)) == pytest.approx(lp(coalescent.skyride(rows, sizes)))
    assert lp(coalescent.skyride(rows, sizes)) == pytest.approx(-11.48749174278204, abs=1e-9)
    grid = [3.0, 10.0, 4.0, 2.0, 3.0]
    assert lp(coalescent.skygrid(events, grid, 10.0)) == pytest.approx(-11.8751856, abs=1e-7)
    assert lp(coalescent.piecewise_linear(events, grid, 10.0)) == pytest.approx(-11.081856777767, abs=1e-9)
    assert lp(coalescent.exponential(rows, 3.0, 0.0)) == pytest.approx(lp(coalescent.constant(rows, 3.0)))
    assert lp(coalescent.skyline(rows, [3.0, 7.0], [3, 1])) == pytest.approx(lp(coalescent.constant(rows, 3.0)))


def test_heights_and_jacobian(spark):
    """(A:2,(B:1.5,(C:2,D:1):2.5):2.5) with dates 5, 3, 0, 1: internal heights 2, 4.5 and 7."""
    edges = newick.edges(spark.createDataFrame([(0, "(A:2,(B:1.5,(C:2,D:1)x:2.5)y:2.5)r;")], "tree long, newick string"))
    h = trees.heights(edges)
    found = {r["node"]: r["height"] for r in h.collect()}
    assert [found[n] for n in "xyr"] == [2.0, 4.5, 7.0]
    assert [found[n] for n in "ABCD"] == [5.0, 3.0, 0.0, 1.0]
    # lower bounds are the latest tips below: x 1, y 3
    assert trees.log_jacobian(edges, h).first()["lj"] == pytest.approx(np.log(4.5 - 1) + np.log(7 - 3))


def test_newick_round_trip(spark):
    text = "((a:2,'b c':2)[&rate=0.5,x={1,2}]:4,c:6,d:12);"
    tree = newick.parse(text)
    assert [t.name for t in tree.tips()] == ["a", "b c", "c", "d"]
    assert tree.postorder()[2][0].notes == {"rate": "0.5", "x": "{1,2}"}
    assert len(newick.parse(text, binary=True).rows()) == 7
    assert newick.parse(newick.parse(TREE).newick()).newick() == TREE
    deep = "(" * 5000 + "a" + "".join(f",t{i})" for i in range(5000)) + ";"
    assert len(newick.parse(deep).tips()) == 5001
    with pytest.raises(ValueError):
        newick.parse("((a,b);")


def test_tree_files(spark, tmp_path):
    path = tmp_path / "t.nex"
    path.write_text("#NEXUS\nBEGIN TREES;\nTRANSLATE\n1 a,\n2 b,\n3 c;\ntree STATE_0 = [&R] ((1:1,2:1):1,3:2);\ntree STATE_10 = [&R] ((1:1,3:1):1,2:2);\nEND;\n")
    found = newick.read_trees(spark, str(path))
    assert [r["name"] for r in found.orderBy("tree").collect()] == ["STATE_0", "STATE_10"]
    names = newick.read_translation(spark, str(path))
    assert {r["child"] for r in newick.edges(newick.tree_range(found, 1, 1), names).where("is_tip").collect()} == {"a", "b", "c"}


def brute(tree: likelihood.TreeArrays, pattern: str, model: M.SubstitutionModel, rates: M.SiteRates) -> float:
    n = len(pattern)
    inner = range(n, len(tree.children))
    total = 0.0
    for rate, weight in zip(rates.rates, rates.weights, strict=True):
        p = model.p(tree.length * rate)
        for states in product(range(4), repeat=len(inner)):
            for tips in product(*[["ACGT".index(c)] if c in "ACGT" else range(4) for c in pattern]):
                s = [*tips, *states]
                value = model.freqs[s[-1]]
                for node in range(len(s) - 1):
                    value *= p[node][s[tree.parent[node]], s[node]]
                total += weight * value
    return float(np.log(total))


MODELS = [M.jc69(), M.hky(3.0, [0.1, 0.2, 0.3, 0.4]), M.gtr([1, 2, 0.5, 0.7, 3, 1], [0.4, 0.3, 0.2, 0.1]), M.unrestricted(np.arange(1, 17).reshape(4, 4) / 10)]


@pytest.mark.parametrize("model", MODELS)
def test_likelihood_by_enumeration(spark, model):
    tree = likelihood.TreeArrays.of("((a:0.1,b:0.3):0.2,(c:0.4,d:0.05):0.15);", "abcd")
    rates = M.rate_categories("gamma", 3, 0.7)
    pats = [("ACGT", 2.0), ("AAAA", 5.0), ("AC-T", 1.0)]
    got = likelihood.site_likelihoods(spark.createDataFrame(pats, "pattern string, weight double"), tree, model, rates).collect()
    for r in got:
        assert r["lnl"] == pytest.approx(brute(tree, r["pattern"], model, rates), abs=1e-10)
    total = likelihood.log_likelihood(spark.createDataFrame(pats, "pattern string, weight double"), tree, model, rates).first()["lnl"]
    assert total == pytest.approx(sum(r["weight"] * r["lnl"] for r in got))


def test_gradient_by_differences(spark):
    pats = spark.createDataFrame([("ACGT", 2.0), ("AACA", 5.0), ("GGTT", 1.0)], "pattern string, weight double")
    text = "((a:{0},b:{1}):{2},(c:{3},d:{4}):{5});"
    base = [0.1, 0.3, 0.2, 0.4, 0.05, 0.15]
    model, rates = MODELS[1], M.rate_categories("gamma", 4, 0.5)
    value = lambda x: likelihood.log_likelihood(pats, likelihood.TreeArrays.of(text.format(*x), "abcd"), model, rates).first()["lnl"]
    slopes = {r["node"]: r["slope"] for r in likelihood.gradient(pats, likelihood.TreeArrays.of(text.format(*base), "abcd"), model, rates).collect()}
    for node, k in ((0, 0), (2, 3)):
        up, down = base.copy(), base.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert slopes[node] == pytest.approx((value(up) - value(down)) / 2e-5, rel=1e-4)


def test_rerooting_and_order_leave_the_likelihood(spark):
    tree = newick.parse("((a:0.1,b:0.3):0.2,(c:0.4,d:0.05):0.15);")
    pats = spark.createDataFrame([("ACGT", 2.0), ("AACA", 5.0)], "pattern string, weight double")
    value = lambda t, names, p: likelihood.log_likelihood(p, likelihood.TreeArrays.of(t, names), MODELS[1], M.rate_categories()).first()["lnl"]
    base = value(tree, "abcd", pats)
    moved = cluster.reroot(newick.parse("((a:0.1,b:0.3):0.2,(c:0.4,d:0.05):0.15);"), "c")
    assert value(moved, "abcd", pats) == pytest.approx(base)
    swapped = spark.createDataFrame([("TGCA", 2.0), ("ACAA", 5.0)], "pattern string, weight double")
    assert value(tree, "dcba", swapped) == pytest.approx(base)


def test_parsimony_by_enumeration(spark):
    tree = likelihood.TreeArrays.of("(((a,b),c),(d,e));", "abcde")
    rng = np.random.default_rng(3)
    pats = sorted({"".join(rng.choice(list("ACGT"), 5)) for _ in range(20)})
    got = likelihood.parsimony(spark.createDataFrame([(p, 1.0) for p in pats], "pattern string, weight double"), tree).collect()
    for r in got:
        best = min(sum(s[n] != s[tree.parent[n]] for n in range(8)) for inner in product("ACGT", repeat=4) for s in [[*r["pattern"], *inner]])
        assert r["score"] == best
        assert sum(r["states"][n] != r["states"][tree.parent[n]] for n in range(8)) == best


def test_reconstruction_follows_the_tips(spark):
    tree = likelihood.TreeArrays.of("((a:0.01,b:0.01):0.5,(c:0.01,d:0.01):0.5);", "abcd")
    found = likelihood.reconstruct(spark.createDataFrame([("AACC", 1.0)], "pattern string, weight double"), tree, M.jc69(), M.rate_categories()).first()
    assert found["states"][:2] == "AC"


def test_simulation_has_the_models_frequencies(spark):
    tree = likelihood.TreeArrays.of("((a:0.1,b:0.3):0.2,(c:0.4,d:0.05):0.15);", "abcd")
    got = likelihood.simulate(spark, tree, MODELS[1], M.rate_categories("gamma", 4, 1.0), 20_500, seed=4).collect()
    assert sorted(r["site"] for r in got) == list(range(20_500))
    n = Counter("".join(r["pattern"] for r in got))
    assert [n[s] / 82_000 for s in "ACGT"] == pytest.approx([0.1, 0.2, 0.3, 0.4], abs=0.015)


def additive() -> tuple[list[str], np.ndarray]:
    names = list("abcde")
    text = "((a:1,b:4):2,((c:2,d:3):1,e:5):3);"
    rows = newick.parse(text).rows()
    up = {r["node"]: (r["parent"], r["length"]) for r in rows}
    tip = {r["name"]: r["node"] for r in rows if r["is_tip"]}

    def path(n: int) -> dict[int, float]:
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            parent, length = up[n]
            d += length or 0.0
            n = parent
        return out

    d = np.zeros((5, 5))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            x, y = path(tip[a]), path(tip[b])
            d[i, j] = min(x[k] + y[k] for k in x if k in y)
    return names, d


def test_neighbour_joining_recovers_an_additive_tree(spark):
    names, d = additive()
    tree = cluster.neighbour_joining(names, d)
    edges = newick.edges(spark.createDataFrame([(0, tree.newick())], "tree long, newick string"))
    got = {(r["i"], r["j"]): r["d"] for r in trees.patristic(edges).collect()}
    assert got == pytest.approx({(a, b): d[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if a < b})


def test_upgma_recovers_an_ultrametric_tree():
    d = np.array([[0, 4, 12, 24], [4, 0, 12, 24], [12, 12, 0, 24], [24, 24, 24, 0.0]])
    assert {t.name: t.length for t in cluster.upgma("abcd", d).tips()} == {"a": 2, "b": 2, "c": 6, "d": 12}


def test_root_to_tip():
    fit = cluster.root_to_tip(newick.parse("((a:1,b:3):1,c:6);"), {"a": 2.0, "b": 4.0, "c": 6.0})
    assert fit["slope"] == pytest.approx(1.0)
    assert fit["root_date"] == pytest.approx(0.0)


def test_models():
    t = np.array([0.1, 1.0, 50.0])
    for m in [*MODELS, M.codon_model(2.0, 0.3)]:
        p = m.p(t)
        assert p.sum(axis=-1) == pytest.approx(np.ones(p.shape[:2]))
        assert m.freqs @ p[1] == pytest.approx(m.freqs, abs=1e-9)
        assert m.dp(0.3) == pytest.approx((m.p(0.3 + 1e-6) - m.p(0.3 - 1e-6)) / 2e-6, abs=1e-5)
    assert M.jc69().p(0.2)[0, 0] == pytest.approx(0.25 + 0.75 * np.exp(-4 * 0.2 / 3))
    assert M.general([0] * 3, [1.0], [1 / 3] * 3).q[0, 1] == pytest.approx(0.5)
    triangle = "\n".join(" ".join(["1"] * k) for k in range(1, 20)) + "\n" + " ".join(["0.05"] * 20)
    assert M.empirical(triangle).q[0, 1] == pytest.approx(1 / 19)


@pytest.mark.parametrize("kind", ["constant", "gamma", "weibull", "lognormal", "beta", "laguerre"])
def test_rates_have_mean_one(kind):
    r = M.rate_categories(kind, 4, 0.6, invariant=0.2)
    assert (r.rates * r.weights).sum() == pytest.approx(1) and r.weights.sum() == pytest.approx(1)


def test_gamma_categories():
    assert M.rate_categories("gamma", 4, 0.5, mean=True).rates == pytest.approx([0.0333877, 0.2519159, 0.8202685, 2.8944279], abs=1e-6)
    assert M.inherited_rates([2, 2, 4, 4, None], {2: 3.0}, 1.0).tolist() == [3.0, 3.0, 3.0, 1.0, 1.0]
    assert M.clock_lengths(np.array([1.0, 2.0]), [0.5, 2.0], [1, 0]).tolist() == [2.0, 1.0]


def test_quantiles():
    assert special.qnorm(0.975) == pytest.approx(1.959963984540054)
    assert special.qt(0.975, 7) == pytest.approx(2.364624251592785)
    assert special.qchisq(0.95, 3) == pytest.approx(7.814727903251179)
    assert special.pbeta(special.qbeta(0.3, 2, 5), 2, 5) == pytest.approx(0.3)
    assert special.pgamma(special.qgamma(0.01, 0.05), 0.05) == pytest.approx(0.01)
    assert special.inverse_erf(0.5) == pytest.approx(0.4769362762044699)
    assert [special.bell_number(n) for n in range(6)] == [1, 1, 2, 5, 15, 52]
    assert [special.combination_at(4, 2, r) for r in range(6)] == [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]


def test_stick_breaking(spark):
    from pyspark.sql import functions as F

    from dendrolith.functions import text as X

    got = spark.range(1).select(X.stick_breaking(F.lit([0.1, 0.2, 0.3, 0.4]).cast("array<double>")).alias("z")).first()["z"]
    assert got == pytest.approx([-1.0986122886681, -0.5596157879354, -0.2876820724518], abs=1e-12)


def test_evidence_estimators_agree():
    prior = lambda x: float(-0.5 * x @ x - 0.5 * len(x) * np.log(2 * np.pi))
    like = lambda x: float(-2 * (x[0] - 1) ** 2)
    exact = -0.5 * np.log(5) - 0.4
    joint = lambda x: prior(x) + like(x)
    assert inference.laplace(joint, np.array([0.8])) == pytest.approx(exact, abs=1e-5)
    x, ll, rate = inference.mcmc(prior, like, np.zeros(1), 20_000)
    assert 0.15 < rate < 0.4
    assert x[200:].mean() == pytest.approx(0.8, abs=0.08)
    assert inference.bridge_sampling(x[200:], joint) == pytest.approx(exact, abs=0.03)
    found = inference.nested_sampling(lambda r: r.standard_normal(1), prior, like, live=150)
    assert found["log_z"] == pytest.approx(exact, abs=4 * found["error"])
    mean, factor, bound = inference.mean_field(joint, 1)
    assert mean[0] == pytest.approx(0.8, abs=0.15) and bound < exact + 0.05
    assert samples.smoothed_harmonic_mean(ll[200:]) == pytest.approx(exact, abs=0.5)


def test_tempered_chains(spark):
    prior = lambda x: float(-0.5 * x @ x - 0.5 * len(x) * np.log(2 * np.pi))
    like = lambda x: float(-2 * (x[0] - 1) ** 2)
    rows = inference.run_rungs(spark, prior, like, [0.0], inference.temperatures(6), 20_000).where("iter > 1000")
    exact = -0.5 * np.log(5) - 0.4
    assert samples.stepping_stone(rows).first()["lml"] == pytest.approx(exact, abs=0.1)
    assert samples.path_sampling(rows, modified=True).first()["lml"] == pytest.approx(exact, abs=0.15)


def test_optimisers():
    f = lambda x: float(((x - np.array([1.0, 2.0])) ** 2).sum() + (x[0] * x[1] - 2) ** 2)
    for found, value in (inference.bfgs(f, np.zeros(2)), inference.conjugate_gradient(f, np.zeros(2)), inference.serial_brent(f, np.zeros(2), [(-5, 5)] * 2)):
        assert found == pytest.approx([1, 2], abs=1e-2) and value == pytest.approx(0, abs=1e-4)
    assert inference.ridders(np.sin, 0.3)[0] == pytest.approx(np.cos(0.3))
    assert inference.hessian(f, np.array([1.0, 2.0])) == pytest.approx(np.array([[10, 4], [4, 4]]), abs=1e-4)
    best, value = inference.simulated_annealing(lambda x: (x - 7) ** 2, lambda x, r: x + int(r.integers(-2, 3)), 0)
    assert (best, value) == (7, 0)
    people, fit = inference.genetic_search(lambda p: float((p == np.arange(6) % 2).sum()), 6, 2)
    assert fit == 6


def test_intervals_and_jenks():
    rng = np.random.default_rng(1)
    data = rng.normal(5, 2, 200)
    boot = np.array([rng.choice(data, 200).mean() for _ in range(500)])
    jack = np.array([np.delete(data, i).mean() for i in range(200)])
    low, high = resampling.bca_interval(jack, boot, data.mean())
    assert low < data.mean() < high and high - low == pytest.approx(2 * 1.96 * 2 / np.sqrt(200), rel=0.3)
    assert samples.jenks(np.array([1, 1.1, 1.2, 5, 5.1, 9, 9.2]), 3) == [0, 3, 5]
    x = rng.standard_normal(4000)
    assert samples.ess_of(x) == pytest.approx(4000, rel=0.2)
    assert samples.ess_of(np.repeat(x, 4)) == pytest.approx(4000, rel=0.3)


def test_bootstrap_weights(spark):
    pats = spark.createDataFrame([("A" * k, 50) for k in range(1, 21)], "pattern string, weight long")
    got = resampling.bootstrap_weights(pats, 30).toPandas()
    assert got.weight.sum() == pytest.approx(30 * 1000, rel=0.03)
    assert got.sort_values(["replicate", "pattern"]).values.tolist() == resampling.bootstrap_weights(pats.repartition(5), 30).toPandas().sort_values(["replicate", "pattern"]).values.tolist()


def test_compression_leaves_the_likelihood(spark):
    tree, pats = numeric.arrays(spark, "/root/testdata/sf0.001")
    sites = S.columns(spark, "/root/testdata/sf0.001").selectExpr("pattern", "1.0 as weight")
    one, two = (likelihood.log_likelihood(p, tree, M.jc69(), M.rate_categories()).first()["lnl"] for p in (pats, sites))
    assert one == pytest.approx(two)


def test_sequence_files(spark, tmp_path):
    rows = [("a", "ACGT-A"), ("b", "ACGTTA")]
    df = spark.createDataFrame(rows, "taxon string, seq string")
    made = {
        "x.fa": ">a\nACG\nt-a\n\n>b\nACGTTA\n>empty\n", "x.phy": "2 6\na  ACGT-A\nb  ACGTTA\n",
        "x.nex": "#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX=2 NCHAR=6;\nFORMAT DATATYPE=DNA GAP=- INTERLEAVE;\nMATRIX\na ACG\nb ACG\n\na T-A\nb TTA\n;\nEND;\n",
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text)
        got = sequences.read_sequences(spark, str(tmp_path / name)).collect()
        assert sorted((r["taxon"], r["seq"]) for r in got) == rows
    for k, writer in enumerate((sequences.to_fasta, sequences.to_phylip, sequences.to_nexus)):
        writer(df).coalesce(1).write.text(str(tmp_path / f"out{k}"))
        assert sorted((r["taxon"], r["seq"]) for r in sequences.read_sequences(spark, str(tmp_path / f"out{k}")).collect()) == rows


def test_logs(spark, tmp_path):
    for rung in range(2):
        (tmp_path / f"{rung}run.log").write_text("iter\tposterior\tkappa\n" + "".join(f"{10 * i}\t{-100 - i - rung}\t{i}\n" for i in range(5)))
    rungs = logs.read_rungs(spark, str(tmp_path / "*run.log"), "posterior", [0.0, 1.0], burnin=2)
    assert sorted((r["rung"], r["beta"], r["iter"], r["ll"]) for r in rungs.collect()) == [(k, float(k), 10 * i, -100.0 - i - k) for k in range(2) for i in range(2, 5)]
    with pytest.raises(KeyError):
        logs.read_log(spark, str(tmp_path / "0run.log"), ["nothing"])
    (tmp_path / "cpo.log").write_text("#2\t3\niter\tm.p0\tm.p1\n0\t-1\t-2\n10\t-1.5\t-2.5\n")
    lines, weights = logs.read_pattern_log(spark, str(tmp_path / "cpo.log"))
    assert lines.count() == 4 and {r["pattern_id"]: r["weight"] for r in weights.collect()} == {0: 2.0, 1: 3.0}
    parameters = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    logs.write_checkpoint(parameters.withColumn("value", parameters["value"] + 1), str(tmp_path / "cp"))
    assert {r["name"]: r["value"] for r in logs.apply_checkpoint(parameters, logs.read_checkpoint(spark, str(tmp_path / "cp")).where("name = 'b'")).collect()} == {"a": 1.0, "b": 3.0}
    (tmp_path / "d.csv").write_text('"strain","date"\n"x","2008/12/31"\n"y","2009/01/01"\n')
    dates = {r["taxon"]: r["date"] for r in logs.read_dates(spark, str(tmp_path / "d.csv"), "yyyy/MM/dd").collect()}
    assert dates == pytest.approx({"x": 2008 + 365 / 366, "y": 2009.0})


def test_documents():
    text = '{"id": "m", "x": [1, 2, 3,], "_note": 1, "sub": {"id": "s", "values": [1, 2, 3], "ignore": false}, "off": {"ignore": true}, "t": "a,]",}'
    doc = config.prune(config.read(text))
    assert set(doc) == {"id", "x", "sub", "t"} and doc["t"] == "a,]"
    registry = config.Registry(doc)
    assert registry.resolve("&s") is doc["sub"]
    assert registry.resolve("%s[0:2]") == [1, 2]
    with pytest.raises(KeyError):
        registry.resolve("&none")
    with pytest.raises(ValueError):
        config.check_keys(doc, {"x", "sub"})


def test_running_rungs(spark, tmp_path):
    from dendrolith.streaming import rungs

    path = tmp_path / "in"
    path.mkdir()
    (path / "a.tsv").write_text("rung\tbeta\titer\tll\n0\t0.0\t0\t-3\n0\t0.0\t10\t-5\n1\t1.0\t0\t-1\n")
    q = rungs.running_rungs(rungs.watch(spark, str(path))).writeStream.outputMode("complete").format("memory").queryName("rungs").start()
    q.processAllAvailable()
    (path / "b.tsv").write_text("rung\tbeta\titer\tll\n1\t1.0\t10\t-2\n")
    q.processAllAvailable()
    q.stop()
    got = {r["beta"]: (r["n"], r["mean"], r["top"]) for r in spark.sql("select * from rungs").collect()}
    assert got == {0.0: (2, -4.0, -3.0), 1.0: (2, -1.5, -1.0)}


def test_height_transforms():
    from dendrolith.operators import heights as H

    # (A:2,(B:1.5,(C:2,D:1):2.5):2.5) with tips A5 B3 C0 D1
    children, parent = [[], [], [], [], [2, 3], [1, 4], [0, 5]], np.array([6, 5, 4, 4, 5, 6, -1])
    h = np.array([5.0, 3.0, 0.0, 1.0, 2.0, 4.5, 7.0])
    ratios = H.to_ratios(children, parent, h)
    assert H.from_ratios(children, parent, np.array([5.0, 3, 0, 1, 0, 0, 0]), ratios) == pytest.approx(h)
    assert H.log_jacobian(children, parent, h) == pytest.approx(2.639057, abs=1e-6)
    gradient = H.ratio_gradient(children, parent, h, ratios, H.jacobian_height_gradient(children, parent, h))
    assert gradient[4:] == pytest.approx([0.0, 1.142857, 0.357143], abs=1e-6)
    assert H.from_shifts(children, np.array([5.0, 3, 0, 1, 0, 0, 0]), H.to_shifts(children, h)) == pytest.approx(h)
    p, step = np.array([0.1, 0.2, 0.3, 0.4]), 1e-6

    def sticks(z):
        out, left = [], 1.0
        for i, v in enumerate(z):
            share = 1 / (1 + np.exp(-(v - np.log(len(z) - i))))
            out.append(left * share)
            left -= out[-1]
        return np.array([*out, left])

    z = np.array([-1.0986122886681, -0.5596157879354, -0.2876820724518])
    assert sticks(z) == pytest.approx(p)
    numeric_ = np.array([(sticks(z + step * e) - sticks(z - step * e)) / (2 * step) for e in np.eye(3)])
    assert H.simplex_gradient(p) == pytest.approx(numeric_, abs=1e-8)


def test_topology_search(spark):
    from dendrolith.operators import search

    true = likelihood.TreeArrays.of("((((a:0.1,b:0.1):0.1,c:0.2):0.1,d:0.3):0.1,(e:0.2,f:0.2):0.2);", "abcdef")
    sites = likelihood.simulate(spark, true, M.jc69(), M.rate_categories(), 2000, seed=3)
    pats = sites.groupBy("pattern").count().withColumnRenamed("count", "weight").cache()
    start = newick.parse("((((a:0.1,e:0.1):0.1,c:0.1):0.1,d:0.1):0.1,(b:0.1,f:0.1):0.1);")
    want = float(search.score_trees(pats, [newick.parse("((((a,b),c),d),(e,f));")], "abcdef").first()["score"])
    tree, score = search.climb(pats, start, "abcdef", search.spr)
    assert score <= want
    assert len(cluster.nni(tree)) > 0
    rates = search.best_rates(pats, true, M.jc69(), [0.1, 1.0, 10.0]).toPandas()
    assert set(rates.rate) <= {0.1, 1.0, 10.0}


def test_roots_by_date(spark):
    from dendrolith.operators import search

    tree = newick.parse("((a:1,b:3):1,(c:6,d:2):1);")
    rows = search.ranked_roots(spark, tree, {"a": 2.0, "b": 4.0, "c": 7.0, "d": 3.0}).collect()
    assert len(rows) == 4 and rows[0]["r"] >= rows[-1]["r"]
    x = np.arange(20.0)
    classes, rss = search.rate_clusters(x, np.where(x % 2 == 0, x, 10 - x), 2)
    assert rss < 60 and len(set(classes)) == 2


def test_notes_partials_and_attributes(spark, tmp_path):
    from dendrolith.operators import density, patterns

    edges = newick.edges(spark.createDataFrame([(0, "((a:1,b:1)x[&cal_height={2,5}]:1,c:2)r;")], "tree long, newick string"))
    assert [tuple(r) for r in newick.calibrations(edges).collect()] == [(0, "x", 2.0, 5.0)]
    newick.to_nexus(spark.createDataFrame([(7, "((a:1,b:1):1,c:2);")], "tree long, newick string"), ["a", "b", "c"]).coalesce(1).write.text(str(tmp_path / "t"))
    back = newick.read_trees(spark, str(tmp_path / "t")).first()
    assert back["name"] == "STATE_7" and back["newick"] == "((1:1,2:1):1,3:2);"
    assert newick.read_translation(spark, str(tmp_path / "t")) == {"1": "a", "2": "b", "3": "c"}
    cols = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "site long, partial array<double>")
    assert sorted(r["weight"] for r in patterns.compress_partials(cols).collect()) == [1, 2]
    traits = spark.createDataFrame([("a", "north"), ("b", "south"), ("c", "?")], "taxon string, value string")
    assert patterns.attribute_pattern(traits, ["a", "b", "c", "d"], ["north", "south"]).first()["pattern"] == [0, 1, 2, 2]
    assert [r["taxon"] for r in patterns.in_tree_order(traits, ["c", "a", "b"]).collect()] == ["c", "a", "b"]
    assert density.multivariate_normal([1.0, 2.0], [0.0, 0.0], [[1, 0], [0, 4]]) == pytest.approx(-0.5 * (1 + 1) - np.log(2) - np.log(2 * np.pi))
