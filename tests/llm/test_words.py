"""The word model against a plain one with dictionaries; shapes; a reading that changes; what the bands keep."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from dendrolith.llm import perplexity, registry, words
from test_operators import rows_of

CASES = {b"word": 0, b"word,": 7, b"Word": 1, b"WORD": 2, b"wOrd.": 9, b"a1": 3, b"12": 3, b"-": 4, b"...": 11, b"|": 4, b"w|": 5, b"w***": 5, b"w###.": 12, "été".encode(): 6, "Été!".encode(): 13, b"#1": 5, b"it's": 0}


def test_shapes():
    assert {w: words.shape_of(w) for w in CASES} == CASES


class Plain:
    """Interpolated modified Kneser-Ney of order 4 over sequences, and unigrams over the words of a shape."""

    def __init__(self, texts: list[list[bytes]]):
        shapes = [[words.BEGIN] * 3 + [words.shape_of(w) for w in t] for t in texts]
        grams = Counter(tuple(s[i - 3 : i + 1]) for s in shapes for i in range(3, len(s)))
        self.level = {4: grams}
        for n in (3, 2, 1):
            self.level[n] = Counter(g[1:] for g in self.level[n + 1])
        self.words = Counter(w for t in texts for w in t)
        self.of = {s: {w: n for w, n in self.words.items() if words.shape_of(w) == s} for s in range(words.SHAPES)}

    @staticmethod
    def cut(counts) -> list[float]:
        n = [0] + [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [0.0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else k / 2 for k in (1, 2, 3)]

    def shape(self, gram: tuple[int, ...]) -> float:
        if not gram:
            return 1 / words.SHAPES
        level = self.level[len(gram)]
        d = self.cut(level.values())
        beside = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        if not beside:
            return self.shape(gram[1:])
        total = sum(beside.values())
        own = beside.get(gram, 0)
        return (own - d[min(own, 3)]) / total + sum(d[min(c, 3)] for c in beside.values()) / total * self.shape(gram[1:])

    def word(self, w: bytes) -> float:
        of = self.of[words.shape_of(w)]
        d, total = self.cut(of.values()), sum(of.values())
        return (of[w] - d[min(of[w], 3)]) / total + sum(d[min(c, 3)] for c in of.values()) / total / len(of)

    def score(self, text: list[bytes]) -> tuple[float, float]:
        shapes = [words.BEGIN] * 3 + [words.shape_of(w) for w in text]
        every = sum(self.words.values())
        given = [math.log(self.word(w)) for w in text]
        before = [math.log(self.shape(tuple(shapes[i : i + 4]))) for i in range(len(text))]
        alone = [math.log(sum(self.of[s].values()) / every) for s in shapes[3:]]
        return -sum(before + given) / len(text), -sum(alone + given) / len(text)


@pytest.mark.parametrize(("n_buckets", "group"), [(1, 1 << 20), (7, 600), (50, 1)])
def test_scores_are_those_of_a_plain_model(spark, n_buckets, group):
    rows = [(r[0], r[1], r[2]) for r in rows_of()]
    docs = spark.createDataFrame([(i, x, t) for i, t, x in rows], "doc_id long, lang string, text string")
    got = perplexity.measure(docs, perplexity.train(docs), n_buckets, group).toPandas()
    want: list[tuple] = []
    for lang in ("en", "fr", None):
        own = [(i, (t or "").encode().split()) for i, t, x in rows if x == lang]
        model = Plain([t for _, t in own])
        for s in range(words.SHAPES):
            if model.of[s]:
                assert sum(model.word(w) for w in model.of[s]) == pytest.approx(1)
        want += [(i or -1, len(t), *(model.score(t) if t else (None, None))) for i, t in own]
    key = lambda r: (r[0], r[1], r[2] or 0)
    have = [(-1 if pd.isna(r.doc_id) else int(r.doc_id) or -1, r.n_words, None if pd.isna(r.word_log_perplexity) else r.word_log_perplexity, None if pd.isna(r.unigram_log_perplexity) else r.unigram_log_perplexity) for r in got.itertuples()]
    assert len(have) == len(want)
    for x, y in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert x[:2] == y[:2]
        assert x[2] == (None if y[2] is None else pytest.approx(y[2], abs=1e-4)) and x[3] == (None if y[3] is None else pytest.approx(y[3], abs=1e-4))


def test_shares_of_a_shape_add_up():
    counts = np.array([1, 1, 1, 2, 2, 3, 4, 9])
    d, total, share = words.discounts_of([3, 2, 1, 1], len(counts), int(counts.sum()))
    assert ((counts - d[np.minimum(counts, 3)]) / total + share).sum() == pytest.approx(1)


def test_another_second_reading_stops_the_query():
    answers = pa.table({"bucket": [0], "check": [12345], "answer": [words._numbers(np.ones(2, dtype=np.int64))]})
    with pytest.raises(RuntimeError, match="second reading"):
        words.scores([b"a b"], ["en"], answers, 1, {}, {})


def test_bands_reject_labelled_junk_and_keep_the_rest(spark):
    got = registry.queries()["op3_kneser_ney_bands"](spark, "/root/testdata/sf0.01").toPandas()
    both = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    past = both[~both.base_failed]
    assert past[past.quality == 1].kept.mean() > 0.99
    assert past[past.quality == 0].kept.mean() < 0.05
