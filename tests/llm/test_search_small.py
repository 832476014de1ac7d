"""Fewer rows than k, one row, and searches that need every round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from dendrolith.llm import hamming_search


def plain(codes: dict[int, int], queries: list[int], k: int) -> list[tuple[int, int, int, int]]:
    out = []
    for q in queries:
        ranked = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items())[:k]
        out += [(q, i, n + 1, d) for n, (d, i) in enumerate(ranked)]
    return sorted(out)


def test_against_all_distances(spark):
    rng = np.random.default_rng(12)
    for n, k in ((1, 10), (4, 10), (9, 3), (60, 10), (300, 10)):
        codes = {i: int(c) & (1 << 64) - 1 for i, c in enumerate(rng.integers(-(1 << 63), 1 << 63, n))}
        codes |= {n + i: codes[i % n] ^ (1 << i % 64) for i in range(n // 3)} | {2 * n + 7: codes[0]}
        if n == 4:
            codes = {0: 0, 1: (1 << 64) - 1, 2: 1, 3: 1 << 63}  # opposite corners
        rows = [(i, hamming_search.signed(c)) for i, c in codes.items()]
        got = hamming_search.nearest(spark.createDataFrame(rows, "id long, code long"), F.col("id") % 3 == 0, k).collect()
        assert sorted((r.query_id, r.neighbor_id, r["rank"], r.distance) for r in got) == plain(codes, [i for i in codes if i % 3 == 0], k)
