"""Queries whose results SQL cannot give: tree building, likelihood, reconstruction, sampling. Tests hold them to brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dendrolith.functions import models as M
from dendrolith.operators import cluster, distances, inference, likelihood, samples
from dendrolith.plans import standins as S
from dendrolith.sources.trees import Tree

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined_tree(spark, sf, method=cluster.neighbour_joining) -> tuple[Tree, list[str], object]:
    names = [str(t) for t in S.taxa(spark, sf)]
    pats = S.patterns(spark, sf).cache()
    d = distances.distances(pats, len(names), "raw")
    return method(names, cluster.matrix(d, len(names))), names, pats


def edge_rows(spark, tree: Tree):
    rows = [(r["node"], r["parent"], r["name"], r["is_tip"], None if r["length"] is None else float(r["length"])) for r in tree.rows()]
    return spark.createDataFrame(rows, "node int, parent int, name string, is_tip boolean, length double")


@query
def nj(spark, sf):
    return edge_rows(spark, joined_tree(spark, sf)[0])


@query
def upgma(spark, sf):
    return edge_rows(spark, joined_tree(spark, sf, cluster.upgma)[0])


def arrays(spark, sf):
    tree, names, pats = joined_tree(spark, sf)
    found = likelihood.TreeArrays.of(tree, names)
    found.length = np.maximum(found.length, 1e-4)
    return found, pats


@query
def tree_likelihood(spark, sf):
    tree, pats = arrays(spark, sf)
    return likelihood.log_likelihood(pats, tree, M.hky(2.0, [0.25] * 4), M.rate_categories("gamma", 4, 0.5))


@query
def site_posteriors(spark, sf):
    tree, pats = arrays(spark, sf)
    return likelihood.site_likelihoods(pats, tree, M.jc69(), M.rate_categories("gamma", 4, 0.5))


@query
def likelihood_gradient(spark, sf):
    tree, pats = arrays(spark, sf)
    return likelihood.gradient(pats, tree, M.jc69(), M.rate_categories())


@query
def ancestral_states(spark, sf):
    tree, pats = arrays(spark, sf)
    return likelihood.reconstruct(pats, tree, M.jc69(), M.rate_categories())


@query
def parsimony(spark, sf):
    tree, pats = arrays(spark, sf)
    return likelihood.parsimony(pats, tree)


@query
def simulate_sequences(spark, sf):
    tree, _ = arrays(spark, sf)
    n = S.table(spark, sf, "part").count()
    return likelihood.simulate(spark, tree, M.jc69(), M.rate_categories("gamma", 4, 1.0), n)


@query
def jenks_breaks(spark, sf):
    """Natural breaks of all event values, by type; distinct values with their counts meet in a task per type."""
    counted = S.table(spark, sf, "events").where("value is not null and not isnan(value)").groupBy("event_type", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values = pdf["value"].to_numpy()
        starts = samples.jenks(values, 4, pdf["n"].to_numpy())
        return pd.DataFrame({"event_type": pdf["event_type"].iloc[0], "cls": range(len(starts)), "low": values[starts]})

    return counted.groupBy("event_type").applyInPandas(run, "event_type string, cls int, low double")


def _target(spark, sf):
    """Prior and likelihood of the mean of all log values, with their mean and its standard error; values without a logarithm are left out."""
    log = F.log("value")
    stats = S.table(spark, sf, "events").agg(F.avg(log).alias("m"), F.stddev_samp(log).alias("s"), F.count(log).alias("n")).first()
    m, s, n = float(stats["m"]), float(stats["s"]), int(stats["n"])
    prior = lambda x: float(-0.5 * x[0] ** 2 / 100 - 0.5 * np.log(200 * np.pi))
    like = lambda x: float(-0.5 * n * ((x[0] - m) / s) ** 2 - 0.5 * (n - 1) - n * np.log(s) - 0.5 * n * np.log(2 * np.pi))
    return prior, like, m, s / np.sqrt(n)


@query
def tempered_mcmc(spark, sf):
    prior, like, m, _ = _target(spark, sf)
    return inference.run_rungs(spark, prior, like, [m], inference.temperatures(5), 2000)


@query
def nested_sampling(spark, sf):
    prior, like, _, _ = _target(spark, sf)
    found = inference.nested_sampling(lambda r: 10 * r.standard_normal(1), prior, like, live=60)
    return spark.createDataFrame([(found["log_z"], found["information"], found["error"])], "log_z double, information double, error double")


@query
def variational_race(spark, sf):
    """Fits to the distance from the mean in standard errors, which leaves the evidence as it is."""
    prior, like, m, error = _target(spark, sf)
    return inference.step_size_race(spark, lambda z: prior(m + error * z) + like(m + error * z) + float(np.log(error)), 1, [0.01, 0.1, 0.5])
