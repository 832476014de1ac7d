"""Whole sequences from sites, against plain strings; and that their time grows with the sites, not with their square."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from dendrolith.operators import patterns


@pytest.mark.parametrize("n", [1, 7, patterns.BLOCK, patterns.BLOCK + 1, 3 * patterns.BLOCK - 5])
def test_gaps_anywhere(spark, n):
    rng = random.Random(n)
    rows = [(t, k, rng.choice("ACGT")) for t in ("a", "b") for k in range(n) if rng.random() < 0.3 and k // patterns.BLOCK != 1]
    rows += [("c", -1, "A"), ("c", n, "A"), ("b", n + patterns.BLOCK, "A")]  # outside
    want = {t: ["-"] * n for t, _, _ in rows}
    for t, k, x in rows:
        if 0 <= k < n:
            want[t][k] = x
    got = {r["taxon"]: r["seq"] for r in patterns.sequences(spark.createDataFrame(rows, "taxon string, site long, state string"), n).collect()}
    assert got == {t: "".join(s) for t, s in want.items()}


def test_two_states_at_a_site_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1, "A"), ("a", 1, "C")], "taxon string, site long, state string")
    with pytest.raises(Exception, match="(?i)two states|duplicate"):
        patterns.sequences(rows, 3).collect()


def test_time_is_linear(spark):
    n = 100_000  # a search of the sites per site took minutes here
    aln = spark.range(n).select(F.lit("a").alias("taxon"), F.col("id").alias("site"), F.lit("A").alias("state"))
    start = time.monotonic()
    assert patterns.sequences(aln, n).first()["seq"] == "A" * n
    assert time.monotonic() - start < 30
