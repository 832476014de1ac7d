"""The Jaccard join against all pairs of whole sets."""

from __future__ import annotations

import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrolith.llm import jaccard_join as join

BLANKS = " \t\n\x0b\x0c\r"


def plain_sets(rows: list[tuple]) -> list[frozenset]:
    out = []
    for _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in BLANKS:
            lowered = lowered.replace(c, " ")
        words = [w for w in lowered.split(" ") if w]
        out.append(frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset())
    return out


def all_pairs(rows: list[tuple], similarity: int = 85) -> list[tuple]:
    sets = plain_sets(rows)
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(b)] = root(a)
    best: dict[int, int | None] = {}
    for k, (d, _) in enumerate(rows):
        known = best.get(root(k))
        best[root(k)] = d if known is None else known if d is None else min(known, d)
    return [(d, len(sets[k]), best[root(k)] if sets[k] else d) for k, (d, _) in enumerate(rows)]


def corpus(seed: int = 5) -> list[tuple]:
    """A family of copies about as far apart as the limit, small texts, a shared passage, nulls, repeated rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, 60))
    prose = lambda n: [word() for _ in range(n)]
    base, passage = prose(180), prose(40)
    texts: list[str | None] = []
    for n in range(60):  # near copies with a few words changed; some pairs link, most do not
        own = list(base)
        for _ in range(rng.choice([0, 1, 3, 4, 5])):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own[: 180 - n % 4]))
    texts += [" ".join(prose(rng.randint(5, 90)) + passage) for _ in range(20)]
    texts += [" ".join(["the", "same", "line", "again"] * rng.randint(1, 12)) for _ in range(10)]
    texts += [" ".join(prose(4)[: n % 5]) for n in range(10)] + ["one", "ONE", "one two", "One\ttwo ", "a b c d", "A B\nC D", "a b c d e", "", None, None, "  \n "]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    return [*rows, (None, " ".join(base)), (None, None), (7, "x y z w v"), (7, "x y z w v"), (7, "other words of the same id")]


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("most", [2048, 8])
def test_components_are_those_of_all_pairs(spark, most, monkeypatch):
    """With 8 members a task, families go through drawn members and pairs of blocks; with 2 drawn, much is left to the blocks."""
    monkeypatch.setattr(join, "DRAWN", 32 if most > 8 else 2)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], "doc_id long, text string, size int, node string, key int").repartition(3)
    got = join.similar_documents(docs, most=most).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(all_pairs(rows))
    assert len({r[2] for r in all_pairs(rows)}) < len(rows) - 20


def test_other_similarity(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = join.similar_documents(docs, similarity=60).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(all_pairs(rows, 60))


def test_sql(spark, tmp_path):
    rows = [r for r in corpus(3) if r[0] is not None and r[0] != 7]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = join.op13_jaccard_join(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(join.OP13_SQL).df()
    assert ordered(got[sorted(got)].itertuples(index=False)) == ordered(want[sorted(want)].itertuples(index=False))


def test_empty_table(spark):
    assert join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 3000), st.integers(50, 99))
def test_similar_sizes_are_one_bucket_apart(size, similarity):
    most = size * 100 // similarity
    assert join.buckets(most, similarity)[0] - join.buckets(size, similarity)[0] in (0, 1)
    assert join.buckets(size, similarity)[2] <= size


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([3, 60, 4000]), st.integers(60, 95))
def test_a_similar_pair_shares_a_signature(size, seed, holders, similarity):
    """Sets as far apart as the limit allows, tokens of all classes: prefixes always meet."""
    rng = np.random.default_rng(seed)
    tokens = rng.choice(1 << 40, size + 60, replace=False).astype(np.int64)
    held = rng.integers(2, holders, len(tokens), endpoint=True)
    order = np.lexsort((tokens, held))
    tokens, held = tokens[order], held[order]
    gone = size - join.at_least(size, similarity)
    x = np.sort(rng.choice(len(tokens), size, replace=False))
    for lost, added in ((gone, 0), (gone // 2, gone // 2)):
        y = np.sort(np.concatenate([np.delete(x, rng.choice(size, lost, replace=False)), rng.choice(np.setdiff1d(np.arange(len(tokens)), x), min(added, 60), replace=False)]))
        shared = len(np.intersect1d(x, y))
        if len(y) and 100 * shared >= similarity * (len(x) + len(y) - shared):
            a, b = (join.signatures(len(z), tokens[z], held[z], similarity) for z in (x, y))
            assert len(np.intersect1d(a, b))
