"""Runs analysis documents: JSON that declares models by type and lists actions on them.

Objects are built in document order and registered by id; ``&id`` refers to an object or parameter, ``$id`` to a simplex,
``%id`` to a vector. Parameters are numbers in one table, so that an action changes a value and every model that uses
it sees the change. Patterns are compressed by Spark once; up to ``LOCAL_PATTERNS`` of them are then evaluated on the
driver, beyond that every evaluation is a job over the cached patterns.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from math import inf, lgamma, log
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.functions import alphabet, models
from dendrolith.operators import cluster, distances, inference, likelihood, patterns, samples
from dendrolith.sources import config, sequences
from dendrolith.sources.trees import Tree, parse
from dendrolith.timetrees import Coalescent, Field, Heights, RateScale

LOCAL_PATTERNS = 50_000
STRUCTURES = {"jc69": "000000", "f81": "000000", "k80": "010010", "hky": "010010", "sym": "012345", "gtr": "012345"}
PAIR_NAMES = ("ac", "ag", "at", "cg", "ct")


@dataclass
class Parameter:
    id: str
    value: float
    lower: float = -inf
    upper: float = inf


@dataclass
class Likelihood:
    """Tree, substitution model and rates over patterns; values are read when it is evaluated."""

    taxa: list[str]
    patterns: DataFrame
    tree: Tree
    lengths: list[Parameter]
    substitution: Callable[[], models.SubstitutionModel]
    rates: Callable[[], models.SiteRates]
    clock: Parameter | None = None
    heights: Heights | None = None
    jacobian: bool = False
    local: tuple[np.ndarray, np.ndarray] | None = None

    def arrays(self) -> likelihood.TreeArrays:
        out = likelihood.TreeArrays.of(self.tree, self.taxa)
        scale = self.clock.value if self.clock else 1.0
        if self.heights is not None:
            out.length = self.heights.durations() * scale
            return out
        out.length = np.array([p.value for p in self.lengths] + [0.0] * (len(out.length) - len(self.lengths))) * scale
        return out

    def log_p(self) -> float:
        """With ``jacobian``, also the log-determinant of heights by ratios."""
        return self.log_likelihood() + (self.heights.log_jacobian() if self.jacobian else 0.0)

    def log_likelihood(self) -> float:
        tree, model, rates = self.arrays(), self.substitution(), self.rates()
        if self.local is None and self.patterns.count() <= LOCAL_PATTERNS:
            rows = self.patterns.collect()  # bounded by LOCAL_PATTERNS
            self.local = likelihood.tip_vectors([r["pattern"] for r in rows], len(self.taxa)), np.array([r["weight"] for r in rows], dtype=float)
        if self.local is not None:
            return float(self.local[1] @ likelihood.mixed(likelihood.pattern_likelihoods(tree, self.local[0], model, rates), rates))
        return float(likelihood.log_likelihood(self.patterns, tree, model, rates).first()["lnl"])


@dataclass
class Prior:
    kind: str
    x: Callable[[], list[float]]
    parameters: dict[str, Parameter] | list[Parameter]

    def value(self, *names: str, default: float = 1.0) -> float:
        own = self.parameters if isinstance(self.parameters, dict) else {}
        return next((own[n].value for n in names if n in own), default)

    def log_p(self) -> float:
        x = np.array(self.x(), dtype=float)
        if (x <= 0).any() and self.kind not in ("normal", "cauchy"):
            return -inf
        if self.kind == "exponential":
            rate = 1 / self.value("mean") if "mean" in self.parameters else self.value("lambda", "rate")
            return float(len(x) * log(rate) - rate * x.sum())
        if self.kind == "gamma":
            a = self.value("shape")
            b = 1 / self.value("scale") if "scale" in self.parameters else self.value("rate")
            return float(len(x) * (a * log(b) - lgamma(a)) + (a - 1) * np.log(x).sum() - b * x.sum())
        if self.kind == "dirichlet":
            a = np.array([p.value for p in (self.parameters.values() if isinstance(self.parameters, dict) else self.parameters)])
            return float(lgamma(a.sum()) - sum(map(lgamma, a)) + ((a - 1) * np.log(x)).sum())
        if self.kind in ("normal", "lognormal"):
            m, s = self.value("mean", "mu", default=0.0), self.value("sigma")
            z = x if self.kind == "normal" else np.log(x)
            return float((-0.5 * log(2 * np.pi) - log(s) - 0.5 * ((z - m) / s) ** 2).sum() - (np.log(x).sum() if self.kind == "lognormal" else 0.0))
        if self.kind == "oneonx":
            return float(-np.log(x).sum())
        raise ValueError(f"unknown distribution {self.kind}")


@dataclass
class Compound:
    parts: list

    def log_p(self) -> float:
        return sum(p.log_p() for p in self.parts)


@dataclass
class Analysis:
    spark: SparkSession
    folder: Path
    objects: dict[str, object] = field(default_factory=dict)
    output: list[str] = field(default_factory=list)
    times: dict[int, Heights] = field(default_factory=dict)

    # building

    def get(self, node):
        """An object by reference, or built from its description."""
        if isinstance(node, str):
            if node[0] not in "&$%" or node[1:] not in self.objects:
                raise KeyError(node)
            return self.objects[node[1:]]
        if isinstance(node, list):
            return [self.get(n) for n in node]
        kind = node.get("type", "").lower()
        build = getattr(self, f"_{kind}", None)
        if build is None:
            raise ValueError(f"unknown type {kind!r} of {node.get('id')}")
        made = build(node)
        if "id" in node:
            self.objects[node["id"]] = made
        return made

    def parameters_of(self, node) -> list[Parameter]:
        """Flat list of the parameters that a reference or a list of references names."""
        got = self.get(node) if not isinstance(node, list) else [self.parameters_of(n) for n in node]
        if isinstance(got, Parameter):
            return [got]
        if isinstance(got, Likelihood):
            return got.lengths
        return [q for p in got for q in (p if isinstance(p, list) else [p])]

    def _parameter(self, node) -> Parameter:
        number = lambda v, default: default if v is None else inf if v == "infinity" else float(v)
        return Parameter(node.get("id", ""), float(node["value"]), number(node.get("lower"), -inf), number(node.get("upper"), inf))

    def _simplex(self, node) -> list[Parameter]:
        return [Parameter(f"{node['id']}.{i}", float(v), 0.0, 1.0) for i, v in enumerate(node["values"])]

    def _alignment(self, node) -> DataFrame:
        if "file" in node:
            return sequences.read_sequences(self.spark, str(self.folder / node["file"]))
        return self.spark.createDataFrame(list(node["sequences"].items()), "taxon string, seq string")

    def _sitepattern(self, node) -> tuple[list[str], DataFrame]:
        aln = patterns.long_form(self.get(node["alignment"])).cache()
        known = F.upper("state").isin(*[s for s in alphabet.NUCLEOTIDES if s not in "U"])
        aln = aln.withColumn("state", F.when(known, F.upper("state")).otherwise("?"))
        kept = patterns.slice_sites(aln, node.get("start", 0), node.get("length"), node.get("every", 1))
        taxa = patterns.taxa_of(kept)
        return taxa, patterns.compress(patterns.columns_of(kept, taxa)).cache()

    def _tree(self, node) -> Tree:
        if "init" in node:
            taxa, pats = self.get(node["init"]["sitepattern"])
            method = cluster.upgma if node["init"].get("algorithm") == "upgma" else cluster.neighbour_joining
            model = "raw" if node["init"].get("model", "raw").lower() in ("raw", "uncorrected") else node["init"]["model"].lower()
            return method(taxa, cluster.matrix(distances.distances(pats, len(taxa), model), len(taxa)))
        text = node["newick"] if "newick" in node else (self.folder / node["file"]).read_text()
        tree = parse(text, binary=True)
        if node.get("time"):
            self.times[id(tree)] = Heights(tree, {k: float(v) for k, v in node["dates"].items()} if "dates" in node else None)
        return tree

    def _substitutionmodel(self, node) -> Callable[[], models.SubstitutionModel]:
        name = node["model"].lower()
        freqs = self.get(node["frequencies"]) if "frequencies" in node else None
        rates = node.get("rates", {})
        own = [self.get(rates[k]) if isinstance(rates[k], (dict, str)) else rates[k] for k in (PAIR_NAMES if STRUCTURES.get(name, name) == "012345" else list(rates)) if k in rates]
        structure = STRUCTURES.get(name, name)

        def build() -> models.SubstitutionModel:
            pi = np.array([p.value for p in freqs]) if freqs else None
            values = [p.value for p in own]
            if structure == "010010" and not values:
                values = [1.0]
            return models.nucleotide(structure, values, None if pi is None else pi / pi.sum())

        return build

    def _sitemodel(self, node) -> tuple[Callable, Callable]:
        rates = {k: self.get(v) for k, v in node.get("rates", {}).items()}
        kind, n = node.get("distribution", "gamma" if rates else "constant"), int(node.get("categories", 4 if rates else 1))

        def build() -> models.SiteRates:
            shape = next((p.value for k, p in rates.items() if k in ("alpha", "shape")), 1.0)
            proportion = rates["pinv"].value if "pinv" in rates else 0.0
            return models.rate_categories(kind, n, shape, proportion) if rates or n > 1 else models.rate_categories()

        return self.get(node["substitutionmodel"]), build

    def _branchmodel(self, node) -> Parameter:
        if node.get("model") not in ("strict", None):
            raise ValueError("only strict clocks are declared in documents")
        return self.get(node["rate"])

    def _treelikelihood(self, node) -> Likelihood:
        taxa, pats = self.get(node["sitepattern"])
        substitution, rates = self.get(node["sitemodel"])
        tree = self.get(node["tree"])
        arrays = likelihood.TreeArrays.of(tree, taxa)
        lengths = [Parameter(f"branch.{i}", max(float(v), 1e-6), 1e-8, 10.0) for i, v in enumerate(arrays.length[:-1])]
        clock = self.get(node["branchmodel"]) if "branchmodel" in node else None
        heights = self.times.get(id(tree))
        if heights is not None:
            lengths = heights.place(taxa, Parameter)
        made = Likelihood(taxa, pats, tree, lengths, substitution, rates, clock, heights, heights is not None and bool(node.get("include_jacobian", node.get("reparameterized", False))))
        name = isinstance(node["tree"], dict) and node["tree"].get("reparam" if heights is not None else "parameters")
        if name:
            self.objects[name] = lengths
        return made

    def heights_of(self, node) -> Heights:
        found = self.times.get(id(self.get(node)))
        if found is None:
            raise ValueError("a time tree is asked for: declare it with time, before its likelihood")
        return found

    def _coalescent(self, node) -> Coalescent:
        """Population sizes by model: constant, exponential, skyline, skyride, skygrid, piecewise-linear."""
        model = node["model"].lower()
        if model not in ("constant", "exponential", "skyline", "skyride", "skygrid", "piecewise-linear"):
            raise ValueError(f"unknown population model {model!r}")
        given = node["parameters"]
        names = sorted((k for k in given if k != "id"), key=lambda k: k.lower() != "n0") if model == "exponential" else [k for k in given if k != "id"]
        sizes = [q for k in names for q in self._vector(given[k])]
        if isinstance(given.get("id"), str):
            self.objects[given["id"]] = sizes
        cutoff = float(node.get("cutoff", 0.0))
        if model in ("skygrid", "piecewise-linear") and cutoff <= 0:
            raise ValueError(f"{model} takes a cutoff above 0")
        groups = node.get("groups")
        groups = groups.get("values") if isinstance(groups, dict) else groups
        return Coalescent(model, self.heights_of(node["tree"]), sizes, cutoff, groups, node.get("parameterization", "") == "log")

    def _vector(self, node) -> list[Parameter]:
        """A parameter, or with ``dimension`` or ``values`` as many as it says."""
        if isinstance(node, dict) and ("dimension" in node or "values" in node):
            values = node.get("values") or [node.get("value", 1.0)]
            n = int(node.get("dimension", len(values)))
            bound = lambda v, default: default if v is None else inf if v == "infinity" else float(v)
            made = [Parameter(f"{node['id']}.{i}", float(values[i % len(values)]), bound(node.get("lower"), -inf), bound(node.get("upper"), inf)) for i in range(n)]
            self.objects[node["id"]] = made
            return made
        got = self.get(node)
        return [got] if isinstance(got, Parameter) else got

    def _distribution(self, node) -> Prior:
        given = node.get("parameters", {})
        kind = node["distribution"].lower()
        if kind in ("gmrf", "ctmcscale"):
            xs = self.parameters_of(node["x"])
            now = lambda: [p.value for p in xs]
            return Field(now, self.get(given["precision"])) if kind == "gmrf" else RateScale(now, self.heights_of(node["tree"]))
        own = {k: self.get(v) for k, v in given.items()} if isinstance(given, dict) else [Parameter("", float(v)) for v in given]
        if "x" in node:
            xs = self.parameters_of(node["x"])
        else:
            tree = self.get(node["tree"])
            xs = next(o.lengths for o in self.objects.values() if isinstance(o, Likelihood) and o.tree is tree)
        return Prior(node["distribution"].lower(), lambda: [p.value for p in xs], own)

    def _compound(self, node) -> Compound:
        return Compound([self.get(d) for d in node["distributions"]])

    # actions

    def act(self, node) -> None:
        if node["type"] == "logger":
            self._log(node)
        elif node["type"] == "optimizer":
            self._optimize(node)
        elif node["type"] == "mcmc":
            self._mcmc(node)
        elif node["type"] == "asr":  # (pattern, weight, states)
            own = self.get(node["model"])
            self.objects[node["id"]] = likelihood.reconstruct(own.patterns, own.arrays(), own.substitution(), own.rates())
        elif node["type"] == "simulator":  # (site, pattern)
            own = self.get(node["model"])
            self.objects[node["id"]] = likelihood.simulate(self.spark, own.arrays(), own.substitution(), own.rates(), int(node["length"]), int(node.get("seed", 1)))
        elif node["type"] == "laplace":
            at, start, _ = self._on_the_line(node)
            mode, _ = inference.bfgs(lambda u: -at(u), start)
            self._result(node, inference.laplace(at, mode))
            at(mode)
        elif node["type"] == "variational":
            self._variational(node)
        elif node["type"] == "marginallikelihood":
            self._evidence(node)
        elif node["type"] == "dumper":
            self.output.append(json.dumps({k: v.value for k, v in self.objects.items() if isinstance(v, Parameter)}))
        else:
            raise ValueError(f"unknown action {node['type']}")

    def _log(self, node) -> None:
        if "tree" in node:
            self.output.append(self.current_tree(self.get(node["tree"])).newick())
        for m in node.get("models", []) if isinstance(node.get("models", []), list) else [node["models"]]:
            self.output.append(f"{m[1:]}: {self.get(m).log_p():.10f}")
        for p in node.get("parameters", []):
            self.output += [f"{q.id}: {q.value:.10g}" for q in self.parameters_of(p)]

    def current_tree(self, tree: Tree) -> Tree:
        for o in self.objects.values():
            if isinstance(o, Likelihood) and o.tree is tree:
                at = {str(t): i for i, t in enumerate(o.taxa)}
                rows = [n for n, _ in tree.postorder() if not n.children] + [n for n, _ in tree.postorder() if n.children]
                lengths = o.heights.durations() if o.heights is not None else [p.value for p in o.lengths]
                for i, n in enumerate(rows[:-1]):
                    n.length = float(lengths[at[n.name] if not n.children else i])
        return tree

    def _optimize(self, node) -> float:
        model = self.get(node["model"])
        if node.get("algorithm") == "meta":
            best = -inf
            for _ in range(int(node.get("max", 100))):
                before = best
                for step in node["list"]:
                    best = self._optimize(step)
                if best - before < node.get("precision", 0.001):
                    break
            return best
        targets = self.get(node["treelikelihood"]).lengths if "treelikelihood" in node else self.parameters_of(node["parameters"])
        simplexes = [g for g in (self.get(p) for p in node.get("parameters", []) if isinstance(p, str) and p[0] == "$")]
        for p in targets:
            group = next((g for g in simplexes if any(q is p for q in g)), None)

            def at(v: float, p: Parameter = p, group=group) -> float:
                if group is None:
                    p.value = v
                else:  # the other shares keep their proportions
                    rest = sum(q.value for q in group if q is not p)
                    for q in group:
                        if q is not p:
                            q.value *= (1 - v) / rest
                    p.value = v
                return -model.log_p()

            old, before = p.value, -model.log_p()
            low = max(p.lower, 1e-8 if p.lower >= 0 else -100.0)
            high = min(p.upper, max(10.0, 4 * abs(old))) if group is None else 0.999
            best, value = inference.brent(at, max(low, 0.001) if group else low, high, 1e-6, 60)
            at(best if value < before else old)
        return model.log_p()

    def _result(self, node, value: float) -> None:
        self.objects[node["id"]] = value
        self.output.append(f"{node['id']}: {value:.10g}")

    def _on_the_line(self, node) -> tuple[Callable[[np.ndarray], float], np.ndarray, list[Parameter]]:
        """Log density over real numbers, the present point and the parameters; positive ones enter by their logarithm."""
        model, ps = self.get(node["model"]), self.parameters_of(node["parameters"])
        if any("$" in p for p in node["parameters"]):
            raise ValueError(f"{node['type']} takes single parameters, not a simplex")
        positive = np.array([p.lower >= 0 for p in ps])

        def at(u: np.ndarray) -> float:
            for p, v, up in zip(ps, u, positive, strict=True):
                p.value = float(np.exp(np.clip(v, -700, 700))) if up else float(v)
            inside = all(p.lower <= p.value <= p.upper for p in ps)
            return model.log_p() + float(u[positive].sum()) if inside else -inf

        return at, np.array([log(max(p.value, 1e-12)) if up else p.value for p, up in zip(ps, positive, strict=True)]), ps

    def _variational(self, node) -> None:
        """A normal on the real line around the present values; the lower bound of the evidence is the result."""
        at, start, ps = self._on_the_line(node)
        settings = {k: node[k] for k in ("seed", "rounds", "draws", "rate") if k in node}
        mean, factor, bound = inference.mean_field(lambda u: at(start + u), len(ps), full_rank=node.get("algorithm") == "fullrank", **settings)
        at(start + mean)
        self.objects[f"{node['id']}.mean"], self.objects[f"{node['id']}.factor"] = start + mean, factor
        self._result(node, bound)

    def _evidence(self, node) -> None:
        """Marginal likelihood from the table of a tempered chain, without the first ``burnin`` share of every rung."""
        chain = self.get(node["chain"])
        last = chain.agg(F.max("iter")).first()[0]
        kept = chain.where(F.col("iter") >= last * float(node.get("burnin", 0.2)))
        estimators = {
            "steppingstone": samples.stepping_stone,
            "pathsampling": samples.path_sampling,
            "modifiedpathsampling": lambda df: samples.path_sampling(df, modified=True),
            "harmonicmean": lambda df: samples.log_harmonic_mean(df.where("beta = 1"), F.col("ll")),
        }
        algorithm = node.get("algorithm", "steppingstone")
        if algorithm not in estimators:
            raise ValueError(f"unknown estimator {algorithm!r}")
        self._result(node, estimators[algorithm](kept).first()[0])

    def _mcmc(self, node) -> None:
        """A chain's table; with ``temperatures`` one chain per inverse temperature, each from the end of the one before."""
        model = self.get(node["model"])
        moves = [(self.parameters_of(o["x"] if "x" in o else o["parameters"]), o.get("algorithm", "slider"), float(o.get("weight", 1))) for o in node["operators"]]
        rng = np.random.default_rng(node.get("seed", 1))
        names = [p.id for m in moves for p in m[0]]
        if "temperatures" in node:
            rows = [(beta, k, ll, *x) for beta in inference.temperatures(int(node["temperatures"])) for k, _, ll, x in self._chain(node, model, moves, rng, beta)]
            names = ["beta", "iter", "ll", *names]
        else:
            rows = [(k, now, *x) for k, now, _, x in self._chain(node, model, moves, rng)]
            names = ["iter", "posterior", *names]
        self.objects[node.get("id", "mcmc")] = self.spark.createDataFrame([tuple(map(float, r)) for r in rows], names)

    def _chain(self, node, model, moves, rng: np.random.Generator, beta: float = 1.0) -> list[tuple[int, float, float, list[float]]]:
        """(iteration, log density, log-likelihood, values) of every ``every``-th state."""
        weights = np.array([m[2] for m in moves])

        def density() -> tuple[float, float]:
            ll, prior = split_log_p(model)
            return (prior + beta * ll if beta else prior), ll

        (now, ll), rows = density(), []
        for k in range(int(node.get("length", 1000))):
            ps, kind, _ = moves[int(rng.choice(len(moves), p=weights / weights.sum()))]
            old = [p.value for p in ps]
            i = int(rng.integers(len(ps)))
            y, ratio = inference.PROPOSALS.get(kind, inference.slider)(np.array(old), i, 0.5 if kind == "scaler" else 0.1, rng)
            for p, v in zip(ps, y, strict=True):
                p.value = float(v)
            inside = all(p.lower <= p.value <= p.upper for p in ps)
            new, new_ll = density() if inside else (-inf, -inf)
            if new - now + ratio >= 0 or log(rng.random()) < new - now + ratio:
                now, ll = new, new_ll
            else:
                for p, v in zip(ps, old, strict=True):
                    p.value = v
            if k % int(node.get("every", 10)) == 0:
                rows.append((k, now, ll, [p.value for m in moves for p in m[0]]))
        return rows


def split_log_p(model) -> tuple[float, float]:
    """(log-likelihood, log prior) of a model."""
    if isinstance(model, Compound):
        parts = [split_log_p(p) for p in model.parts]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)
    if isinstance(model, Likelihood):  # the determinant belongs to the prior of the heights
        ll = model.log_likelihood()
        return ll, model.heights.log_jacobian() if model.jacobian else 0.0
    return 0.0, model.log_p()


def run(spark: SparkSession, text: str, folder: str = ".") -> Analysis:
    """Build the models of a document and run its actions; the list at the top level holds the actions."""
    document = config.prune(config.read(text))
    analysis = Analysis(spark, Path(folder))
    for value in document.values():
        if isinstance(value, dict) and "type" in value:
            analysis.get(value)
    for value in document.values():
        if isinstance(value, list):
            for action in value:
                analysis.act(action)
    return analysis


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run an analysis document.")
    parser.add_argument("document")
    given = parser.parse_args(arguments)
    path = Path(given.document)
    spark = SparkSession.builder.getOrCreate()
    print("\n".join(run(spark, path.read_text(), str(path.parent)).output))


if __name__ == "__main__":
    main()
