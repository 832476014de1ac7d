"""The spelling model of op3 tells every byte from every other."""

import math

import numpy as np
import pytest

from dendrolith.llm import perplexity


def test_bytes_of_one_class_are_told_apart(spark):
    texts = ["AAAB 1112 ééè AAAB 1112", "AAAB 2221 AAAB", None, "", "abc"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = {r.code.to_bytes(4, "big"): r.n for r in perplexity.count_ngrams(docs).collect()}
    plain: dict[bytes, int] = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 3):
            plain[b[i : i + 4]] = plain.get(b[i : i + 4], 0) + 1
    assert counted == plain
    model = perplexity.train(docs)
    seen, swapped = (perplexity.ngram_codes([t], perplexity.BYTES)[0] for t in (b"AAAB", b"AAAC"))
    assert model.log_probability(seen)[0] > model.log_probability(swapped)[0] + 1
    context = int(seen[0]) // 256
    assert np.exp(model.log_probability(context * 256 + np.arange(256))).sum() == pytest.approx(1, abs=1e-5)


def test_remembered_values_are_the_models(monkeypatch):
    monkeypatch.setattr(perplexity, "REMEMBERED", 4)
    codes, counts = np.unique(perplexity.ngram_codes([bytes(range(256)) * 3, b"the cat and the hat"], perplexity.BYTES)[0], return_counts=True)
    model = perplexity.kneser_ney(codes, counts, perplexity.BYTES)
    known = perplexity.Remembered(model)
    rng = np.random.default_rng(1)
    for _ in range(20):
        asked = rng.choice(np.concatenate([codes, np.zeros(1, dtype=np.uint32)]), 50).astype(np.uint32)
        assert np.allclose(known.of(asked), model.log_probability(asked), atol=1e-5)
    score = perplexity.spelling([b"the cat", b"", b"hat"], known)
    own = perplexity.ngram_codes([b"the cat"], perplexity.BYTES)[0]
    assert score[0] == pytest.approx(-model.log_probability(own).mean(), abs=1e-5) and math.isnan(score[1]) and math.isnan(score[2])
