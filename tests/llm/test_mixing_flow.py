"""The mixture's flow against all flows of small nets; repeated rows; quotas; sizes and targets against SQL."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from dendrolith.llm import mixing


def cost_of(taken: int, size: int) -> int:
    """Each word once, twice and three times at the convex costs."""
    return sum(c * max(0, min(size, taken - k * size)) for k, c in enumerate(mixing.COSTS))


def best(patterns: list[tuple[tuple[int, ...], int]], targets: list[int]) -> tuple[int, int]:
    """Most words and least cost over all flows."""
    choices = []
    for members, size in patterns:
        choices.append([f for f in itertools.product(*[range(min(3 * size, targets[q]) + 1) for q in members]) if sum(f) <= 3 * size])
    found = (0, 0)
    for flow in itertools.product(*choices):
        into = [0] * len(targets)
        for (members, _), f in zip(patterns, flow, strict=True):
            for q, x in zip(members, f, strict=True):
                into[q] += x
        if all(x <= t for x, t in zip(into, targets, strict=True)):
            key = (sum(into), -sum(cost_of(sum(f), size) for (_, size), f in zip(patterns, flow, strict=True)))
            found = max(found, key)
    return found[0], -found[1]


def test_flow_is_the_cheapest_of_all():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 3)
        kinds = [m for k in range(1, n + 1) for m in itertools.combinations(range(n), k)]
        patterns = [(m, rng.randint(1, 3)) for m in rng.sample(kinds, min(len(kinds), rng.randint(1, 3)))]
        targets = [rng.randint(0, 5) for _ in range(n)]
        feeds = mixing.route(patterns, [float(t) for t in targets])
        into = [0] * n
        for (members, size), f in zip(patterns, feeds, strict=True):
            assert sum(f) <= 3 * size
            for q, x in zip(members, f, strict=True):
                into[q] += x
        assert all(x <= t for x, t in zip(into, targets, strict=True))
        assert (sum(into), sum(cost_of(sum(f), size) for (_, size), f in zip(patterns, feeds, strict=True))) == best(patterns, targets)


def test_many_sources_without_overlap():
    n = 20_000
    feeds = mixing.route([((q,), 10) for q in range(n)], [float(q % 40) for q in range(n)])
    assert [f[0] for f in feeds] == [min(30, q % 40) for q in range(n)]


def test_repeated_rows_meet_their_target(spark, tmp_path):
    """A thousand equal rows of one source, and others under null ids."""
    text = " ".join(["word"] * 100)
    rows = [(7, text, "a")] * 1000 + [(k, text + f" {k}", "b") for k in range(1000, 1700)] + [(None, text, "c")] * 300 + [(8, text, "a"), (8, text, "b")] * 20
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op5_flow_mixture(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    assert set(got.taken) <= {k * n for k in range(4) for n in (100, 101)}
    for _, own in got.groupby("source_size"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 101
    again = mixing.op5_flow_mixture(spark, str(tmp_path)).toPandas()
    cols = ["doc_id", "source_size", "taken"]
    assert sorted(got[cols].astype(str).values.tolist()) == sorted(again[cols].astype(str).values.tolist())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixing.mix_documents(docs).groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).toPandas().set_index("source").n
    for size, n in (("a", 102_000), ("b", 72_700), ("c", 30_000)):
        assert abs(mixed[size] - got[got.source_size == n].target.iloc[0]) <= 101


def test_documents_count_against_the_quotas_that_the_flow_feeds(spark):
    rng = random.Random(9)
    rows = [(k, rng.randint(50, 150), rng.choice([["a"], ["a", "b"], ["b", "c"], ["a", "b", "c"]])) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    total = sum(r[1] for r in rows)
    targets = {"a": total * 0.2, "b": total * 0.5, "c": total * 0.3}
    got = mixing.with_copies(docs, mixing.decide(docs, targets)).toPandas()
    assert all(q in s for q, s in zip(got.quota, got.sources, strict=True))
    for s, t in targets.items():
        assert (got[got.quota == s].copies * got[got.quota == s]["size"]).sum() == pytest.approx(t, rel=0.05)


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    docs = spark.createDataFrame([(k, 1, [f"s{k}"]) for k in range(3)], "doc_id long, size long, sources array<string>")
    with pytest.raises(ValueError, match="patterns"):
        mixing.decide(docs, {f"s{k}": 1.0 for k in range(3)})


def test_sizes_and_targets_against_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{Path(path) / 'documents.parquet'}'")
    rows = con.execute(r"""select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents""").fetchall()
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    target, fixed = [0.0] * len(names), set()
    for _ in names:  # one source after the other stops at three times its size
        rest = sum(sizes) - sum(target[i] for i in fixed)
        weight = sum(mixing.WEIGHTS[i % 3] for i in range(len(names)) if i not in fixed)
        for i in range(len(names)):
            if i not in fixed:
                target[i] = rest * mixing.WEIGHTS[i % 3] / weight
        over = [i for i in range(len(names)) if i not in fixed and target[i] > 3 * sizes[i]]
        if not over:
            break
        target[over[0]] = 3.0 * sizes[over[0]]
        fixed.add(over[0])
    got = mixing.op5_flow_mixture(spark, path).toPandas().set_index("doc_id")
    at = {s: i for i, s in enumerate(names)}
    for doc_id, source, size in rows:
        r = got.loc[doc_id]
        assert (r["size"], r.source_size) == (size, sizes[at[source]])
        assert r.target == pytest.approx(target[at[source]])
