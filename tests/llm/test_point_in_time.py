"""Features of sales against a plain count over all facts."""

from __future__ import annotations

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrolith.llm import point_in_time as pit

START = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, e int"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, k string"
LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, client_id string"


def us(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def cents(x: float | None) -> int:
    return 0 if x is None else int(np.floor(100 * x + 0.5))


def shop(seed: int, n: int = 60) -> tuple[list, list, list]:
    """One client with most rows, ties, late and missing arrivals, repeated rows, negative and missing values."""
    rng = random.Random(seed)
    when = lambda: START + timedelta(hours=rng.choice([rng.randint(0, 40 * 24), 100, 101]), microseconds=rng.choice([0, 0, 1, 999_999]))
    late = lambda t: None if rng.random() < 0.05 else t + timedelta(minutes=rng.choice([0, 0, 5, 600, 4000, 30000]) - rng.choice([0, 0, 400]))
    client = lambda: rng.choice([7, 7, 7, 7, 1, 2, None])
    clicks, sales, lines = [], [], []
    for k in range(n * 3):
        t = None if rng.random() < 0.03 else when()
        clicks.append((rng.choice([k, -k, None]), t, t and late(t), client(), rng.choice(["purchase", "view", None]), rng.choice([1.005, -2.5, None, 7.0]), rng.choice(["{}", None]), 1))
    clicks += clicks[:20]
    for k in range(n):
        t = None if rng.random() < 0.05 else when()
        sales.append((k, client(), "done", rng.choice([10.0, None, 0.125]), t, t and late(t), 1, "k"))
        for j in range(rng.randint(0, 6)):
            lines.append((rng.choice([k, k, k, 3, None]), j, rng.choice([1, 1, 2, 3, rng.randint(4, 30), None]), rng.choice([5.0, None, 3.333]), None if rng.random() < 0.1 or t is None else t + timedelta(days=rng.choice([-1, 0, 0, 1, 3, 20])), "c"))
    sales += sales[:3]
    lines += lines[:10] + [lines[0]] * 5
    return clicks, sales, lines


def plain(clicks: list, sales: list, lines: list, days=(2, 14), ahead: int = 7) -> list[tuple]:
    out = []
    day, wait = 86_400_000_000, 14_400_000_000
    for sale_id, client, _, _, at, *_ in sales:
        if client is None or at is None:
            continue
        t = us(at) + (zlib.crc32(str(sale_id).encode()) % 259_200) * 1_000_000
        label = any(s[1] == client and s[4] and t < us(s[4]) <= t + ahead * day for s in sales)
        for d in days:
            known = lambda e, a: e is not None and a is not None and t - d * day < us(e) <= t and us(a) + wait <= t  # noqa: B023, E731
            c = [x for x in set(clicks) if x[3] == client and known(x[1], x[2])]
            s = [x for x in sales if x[1] == client and known(x[4], x[5])]
            x = [y for z in s for y in lines if y[0] == z[0] and y[4] is not None and us(y[4]) <= t]
            last = max(((us(y[1]), y[0] is not None, y[0] or 0) for y in c), default=None)
            out.append((sale_id, d, t, label, len(c), sum(y[4] == "purchase" for y in c), sum(cents(y[5]) for y in c), last[2] if last and last[1] else None, len(s), sum(cents(y[3]) for y in s), len(x), len({y[2] for y in x} - {None}), sum(cents(y[3]) for y in x)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "leaf"), [(1, 2048), (1, 5), (2, 1), (3, 40)])
def test_features_are_the_plain_counts(spark, seed, leaf):
    """With a leaf of 5 and of 1 events, clients have trees of many levels, whose blocks are cut and carried."""
    clicks, sales, lines = shop(seed)
    frames = [spark.createDataFrame(x, y).repartition(3) for x, y in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    got = sorted((tuple(r) for r in pit.features(*frames, leaf=leaf).collect()), key=str)
    assert got == plain(clicks, sales, lines)


def test_zone_of_the_session_does_not_matter(spark):
    clicks, sales, lines = shop(4, 12)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frames = [spark.createDataFrame(x, y) for x, y in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
        got = sorted((tuple(r) for r in pit.features(*frames, days=(1, 30), ahead=3, leaf=4).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == plain(clicks, sales, lines, (1, 30), 3)


def test_empty_tables(spark):
    clicks, sales, lines = shop(5, 10)
    none = [spark.createDataFrame([], s) for s in (CLICKS, SALES, LINES)]
    assert pit.features(*none).collect() == []
    got = pit.features(none[0], spark.createDataFrame(sales, SALES), none[2]).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([], sales, [])


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 300)), min_size=1, max_size=8), st.integers(2, 9))
def test_blocks_tile_their_window(spans, top):
    starts = np.array([s for s, _ in spans])
    ends = starts + np.array([n for _, n in spans])
    covered = [[] for _ in spans]
    for rows, up, block in pit.blocks(starts, ends, np.zeros(len(spans), dtype=np.int64), top):
        assert up <= top
        for r, b in zip(rows.tolist(), block.tolist(), strict=True):
            covered[r] += range(b << up, (b + 1) << up)
    assert [sorted(c) for c in covered] == [list(range(s, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def test_widths_from_crowded_blocks(spark):
    """Of a client with one crowded block, only that block's seconds are counted again, and all clients get the widths that a plain
    count of all leaves gives."""
    leaf, block = 16, 1 << pit.COUNTED
    facts = [(1, 5 * block)] * 300 + [(1, 5 * block + (j << 20)) for j in range(40)] + [(1, (10 + j) * block + j) for j in range(300)]
    facts += [(2, 7 * block + (j << 19)) for j in range(900)] + [(3, j * block) for j in range(200)] + [(4, 9)]
    frame = spark.createDataFrame(facts, "client long, e long")
    seconds = pit.crowded_seconds(frame, leaf).toPandas()
    assert len(seconds[seconds.client == 1]) == 40 and seconds.n.sum() == 340 + 900
    expected = {}
    for client in {c for c, _ in facts}:
        own = np.array([e for c, e in facts if c == client])
        full = {k: int(np.unique(own >> k, return_counts=True)[1].max()) for k in pit.WIDTHS}
        levels = [k for k in pit.WIDTHS if k >= pit.COUNTED or full[pit.COUNTED] > 16 * leaf]
        widest = max(k for k in levels if full[k] <= max(leaf, 2 * full[min(levels)]))
        if len(own) > leaf and widest < pit.TOP:
            expected[client] = widest
    assert {r.client: r.k for r in pit.leaf_widths(frame, leaf).collect()} == expected and set(expected) == {1, 2, 3}
