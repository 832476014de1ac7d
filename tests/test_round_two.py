"""Trees without a split in common, marks inside FASTA headers, equal rows in a bootstrap, the series against eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrolith.functions import models as M
from dendrolith.operators import markov, resampling
from dendrolith.operators import trees as T
from dendrolith.sources import sequences
from dendrolith.sources import trees as newick


def test_trees_without_common_splits_are_compared(spark):
    lines = spark.createDataFrame(enumerate(["((a:1,b:1):2,(c:1,d:1):3);", "((a:1,c:1):4,(b:1,d:1):1);", "(a:1,b:1,c:1,d:1);"]), "tree long, newick string")
    edges = newick.edges(lines)
    got = {(r.a, r.b): (r.rf, r.normalised, r.branch_score) for r in T.robinson_foulds(T.splits(edges), edges).collect()}
    assert got == {(0, 1): (1, 1, pytest.approx(50**0.5)), (0, 2): (0.5, 1, pytest.approx(5)), (1, 2): (0.5, 1, pytest.approx(5))}


def test_marks_inside_headers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a desc>more\nac\ngt\n\n>b\r\nAAAA\r\n>c>\nT>\n>empty\n")
    assert sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [("a desc>more", "ACGT"), ("b", "AAAA"), ("c>", "T>")]


def test_equal_rows_are_drawn_apart(spark):
    rows = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", 4.0)] * 400, "k string, v double")
    got = resampling.bootstrap_means(rows, "k", "v", 200).toPandas()["mean"]
    assert got.mean() == pytest.approx(2, abs=0.02)
    assert got.std() == pytest.approx(np.sqrt(2 / 1200), rel=0.2)


def test_draws_are_poisson(spark):
    w = spark.range(20_000).select(resampling.poisson_draw(resampling.uniform(3, F.col("id"))).alias("w")).toPandas().w
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.06)


def test_series_is_the_exponential():
    for t in (0.0, 0.01, 1.0, 40.0):
        model = M.gtr([1.5, 4.0, 0.7, 1.2, 5.0], [0.1, 0.2, 0.3, 0.4])
        assert markov.taylor_exponential(model.q, t) == pytest.approx(model.p(t), abs=1e-10)
    assert markov.taylor_exponential(np.array([[0.0, 1.0], [0.0, 0.0]]), 2.0).tolist() == [[1, 2], [0, 1]]  # no eigenvectors
