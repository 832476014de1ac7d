"""Natural breaks of whole tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from dendrolith.operators import samples
from dendrolith.plans import numeric


def test_counts_stand_for_repeated_values():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, n = np.sort(rng.normal(size=9)), rng.integers(1, 6, 9)
        cost = lambda cuts: sum(n[a:b] @ (x[a:b] - np.average(x[a:b], weights=n[a:b])) ** 2 for a, b in zip((0, *cuts), (*cuts, 9), strict=True))  # noqa: B023, E731
        assert samples.jenks(x, 4, n)[1:] == list(min(combinations(range(1, 9), 3), key=cost))


def test_breaks_in_a_short_tail(spark, tmp_path):
    rows = [("a", float(v)) for v in [*[1, 2] * 500, 1000, 2000, 3000]]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = numeric.jenks_breaks(spark, str(tmp_path)).orderBy("cls").toPandas()
    assert got.low.tolist() == [1, 1000, 2000, 3000]
