"""Sweeps move a bushy tree once, gradients stand ratios of zero, and trees are not sent through the driver."""

from __future__ import annotations

import pytest

from dendrolith.operators import consensus, heights, subsplits, sweeps
from test_sweeps import arrays


@pytest.fixture
def moved(monkeypatch):
    counts, settle = [], sweeps.settled

    def counting(df):
        counts.append((out := settle(df)).count())
        return out

    monkeypatch.setattr(sweeps, "settled", counting)
    return counts


def bush(spark, depth: int = 4, width: int = 6):
    rows, level = [], ["r"]
    for _ in range(depth):
        rows += [(0, f"{p}.{k}", p, 1.0) for p in level for k in range(width)]
        level = [f"{p}.{k}" for p in level for k in range(width)]
    return spark.createDataFrame(rows, "tree long, child string, parent string, length double"), len(rows) + 1


def test_layers_shrink(spark, moved):
    edges, n = bush(spark)
    nodes = sweeps.nodes_of(edges)
    from pyspark.sql import functions as F

    moved.clear()
    assert sweeps.up(nodes, {"k": ("sum", F.lit(1).cast("long"))}).where("node = 'r'").first()["k"] == n
    assert sum(moved) < 0.3 * n
    moved.clear()
    assert sweeps.down(nodes, {"d": (F.lit(1.0), F.lit(1.0))}).where("d = 4").count() == 6**4
    assert sum(moved) < 0.5 * n


def test_gradient_with_a_ratio_of_zero(spark):
    es = [("t0", "i2", 0.0), ("t1", "i2", 0.5), ("i2", "i1", 1.0), ("t2", "i1", 1.0), ("i1", "i0", 1.0), ("t3", "i0", 0.25), ("t4", "i3", 0.5), ("t5", "i3", 0.0), ("i3", "i1", 1.25)]
    edges = spark.createDataFrame([(0, *e) for e in es], "tree long, child string, parent string, length double")
    inner = sweeps.to_ratios(sweeps.heights_below(sweeps.nodes_of(edges)))
    order, parent, children, height = arrays(es)
    ratios = heights.to_ratios(children, parent, height)
    assert 0 in [ratios[k] for k, c in enumerate(children) if c]
    by = height**2
    slopes = spark.createDataFrame([(0, n, float(by[k])) for k, n in enumerate(order)], "tree long, node string, by_height double")
    want = heights.ratio_gradient(children, parent, height, ratios, [b if c else 0.0 for b, c in zip(by, children, strict=True)])
    got = {r["node"]: r["slope"] for r in sweeps.ratio_gradients(inner, slopes).collect()}
    assert got == pytest.approx({n: want[k] for k, n in enumerate(order) if children[k]})


def test_trees_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id as tree", "1.0D as weight").write.parquet(f"{tmp_path}/w")
    spark.range(1000).selectExpr("id as tree", "'x' as node", "array(1L) as bits", "1L as n").write.parquet(f"{tmp_path}/c")
    weights, clades = spark.read.parquet(f"{tmp_path}/w"), spark.read.parquet(f"{tmp_path}/c")
    edges = spark.range(1000).selectExpr("id as tree", "'x' as child", "'y' as parent")
    for df in (consensus.weights(clades, weights), subsplits.unrooted(edges, clades, weights)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
