"""Near copies at a similarity, and the pipeline's stage, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from dendrolith.llm import simhash_wide


def similarity(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def components(texts: list[str]) -> list[int]:
    parent = list(range(len(texts)))
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    for i in range(len(texts)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both and 100 * both >= 80 * (len(shingles[i]) + len(shingles[j]) - both):
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    return parent


def family(rng, members: int, words: int, most: int) -> list[str]:
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for _ in range(members - 1):
        copy = list(base)
        for at in rng.choice(words, rng.integers(1, most + 1), replace=False):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("most", [4096, 8])
def test_groups_are_those_of_all_pairs(spark, most):
    """Families of many sizes, a passage that many unrelated texts hold, tiny texts; a crowded key at over 8 members."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [t for size in (2, 3, 12, 60) for t in family(rng, size, 150, 9)]
    texts += [f"{' '.join(f'u{k}' for k in rng.integers(0, 10**6, 40))} {passage}" for _ in range(60)]
    texts += [t for _ in range(40) for n in [int(rng.integers(4, 14))] for t in family(rng, 2, n + 4, 1)]
    texts += [" ".join(t.split()[:-1]) for t in texts[-80:]] + ["", " ", "one", "One", "one two"]
    want = components(texts[:-5]) + [len(texts) - 5] * 2 + [len(texts) - 3] * 2 + [len(texts) - 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash_wide.similar_groups(docs, most=most).toPandas()
    least = got.groupby("component").doc_id.min()
    assert dict(zip(got.doc_id, got.component.map(least))) == dict(enumerate(want))


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.toPandas().sort_values("doc_id")
    want = components([t or "" for t in rows.text])
    got = simhash_wide.similar_groups(docs).toPandas()
    least = got.groupby("component").doc_id.min()
    ids = rows.doc_id.tolist()
    assert dict(zip(got.doc_id, got.component.map(least))) == {i: ids[w] for i, w in zip(ids, want)}


def test_bits_differ_as_the_radius_allows():
    """At a similarity of just 0.8, fingerprints of sets of any size lie within the radius."""
    rng = np.random.default_rng(3)
    for size, radius in ((4, simhash_wide.RADIUS_SMALL), (9, simhash_wide.RADIUS_SMALL), (36, simhash_wide.RADIUS), (360, simhash_wide.RADIUS)):
        far = 0
        for _ in range(400):
            own = rng.integers(0, 1 << 63, size + size // 4 if size < 9 else size * 10 // 9, dtype=np.uint64)
            x, y = (own, own[: size]) if size < 9 else (own[: size], own[len(own) - size :])
            far += int(np.bitwise_count(simhash_wide.wide_fingerprint(x) ^ simhash_wide.wide_fingerprint(y)).sum()) > radius
        assert far <= 1


def test_null_ids_and_empty_tables(spark):
    kind = "doc_id long, text string"
    assert simhash_wide.similar_groups(spark.createDataFrame([], kind)).count() == 0
    got = simhash_wide.similar_groups(spark.createDataFrame([(None, "a b"), (None, None), (1, "A b"), (1, "A b")], kind)).toPandas()
    assert len(got) == 4 and got.component.nunique() == 2


def test_stage_drops_all_near_copies(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        texts.append(words)
        for changed in (1, 3, 6, 8, 20, 60):
            copy = list(words)
            for at in rng.choice(400, changed, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(copy)
    texts = [" ".join(w) for w in texts] + ["", "a b", "A  b", "a c"]
    parent = components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).toPandas()
    assert sorted(kept.doc_id) == sorted(set(parent))
