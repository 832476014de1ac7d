"""The second pass of the repeats over blocks that cut anchors and runs of equal rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from dendrolith.llm import repeats

from test_operators import slow_cut


def sorted_rows(seed: int) -> list[tuple[int, ...]]:
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        if rng.random() < 0.2:
            rows.append((repeats.SPAN, rng.randint(0, 9), rng.randint(0, 500), rng.randint(500, 900), rng.randint(0, 20), rng.randint(0, 3), 0))
            continue
        route = rng.choice([1, 1, 1, 4, 4, *range(5, 40)])
        rows.append((repeats.RUN, route, rng.randint(0, 7 if route < 5 else 1), rng.randint(0, 40) << 8 | 3, rng.randint(0, 20), rng.randint(0, 3), rng.randint(0, 1)))
    at = {n: i for i, n in enumerate(repeats.NAMES)}
    return sorted(rows, key=lambda r: [r[at[c]] for c in repeats.SECOND_ORDER])


def plain(rows: list[tuple[int, ...]], length: int, hot: int) -> list[tuple[int, ...]]:
    """What the pass says, as (kind, start, end or count, k, h), from dictionaries."""
    out, runs = [], {}
    for kind, route, a, b, k, h, c in rows:
        if kind == repeats.SPAN:
            out.append((repeats.SPAN, a, b, k, h))
        else:
            runs.setdefault(route, {}).setdefault((a, c), []).append((k, h, b >> 8, b & 255))
    for equal in runs.values():
        for members in equal.values():
            first = min(members)
            out += [(repeats.SPAN, s, s + n + length - 1, k, h) for k, h, s, n in members if (k, h, s) != first[:3]]
        if len(equal) > 1:
            kind = repeats.UNDECIDED if len(equal) <= hot else repeats.CROWDED
            out += [(kind, s, n, k, h) for k, h, s, n in map(min, equal.values())]
    return sorted(out)


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
@pytest.mark.parametrize("hot", [1, 3, 9, 5000])
def test_blocks_of_any_size_agree(step, hot):
    for seed in range(5):
        rows = sorted_rows(seed)
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c), pa.int8() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows[s : s + step], strict=True))], names=repeats.NAMES) for s in range(0, len(rows), step)]
        got = [row for b in repeats._second_pass(40, step, hot)(iter(batches)) for row in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b", "k", "h")), strict=True)]
        assert sorted(got) == plain(rows, 40, hot)


def test_no_rows():
    assert list(repeats._second_pass(40, 5, 5)(iter([]))) == []


@pytest.mark.parametrize("hot", [1, 4, 5000])
def test_a_phrase_with_ever_different_surroundings(spark, monkeypatch, hot):
    """One anchor in every document, copies among them, in batches of three rows."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 4)
    rng = random.Random(hot)
    other = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase = other(45)
    docs = [(i, other(rng.randint(0, 60)) + phrase + other(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, docs[i % 7][1] + other(5)) for i in range(20)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.cut_out(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [got[i] for i, _ in docs] == slow_cut([(i, t.encode()) for i, t in docs], 40)
