"""The corpus pipeline, stage by stage, on the smallest tables and on awkward ones."""

from __future__ import annotations

import pytest

import corpus_pipeline
from dendrolith.llm import bpe, quality, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_keeps_what_the_operator_keeps(spark, stages):
    got = set(stages[1].toPandas().doc_id)
    predicted = registry.queries()["op8_crf_quality"](spark, SF).toPandas()
    assert got == set(predicted[predicted.predicted == 1].doc_id)


def test_one_document_of_each_group_stays(stages):
    """The least doc_id of each component of all pairs at a 5-word Jaccard similarity of 0.8 or more."""
    rows = stages[1].toPandas().sort_values("doc_id")
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in rows.text)]
    least = list(rows.doc_id)
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            if x == y or 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((least[i], least[j]))
                least = [low if p == high else p for p in least]
    assert sorted(stages[2].toPandas().doc_id) == sorted(set(least))


def test_passages_are_cut(stages):
    before = stages[2].toPandas().set_index("doc_id").text
    after = stages[3].toPandas().set_index("doc_id")
    assert set(after.index) == set(before.index)
    assert (after.n_chars == after.text.str.len()).all()
    seen: set[str] = set()
    for i in sorted(after.index):
        assert len(after.text[i]) <= len(before[i])
        text = after.text[i]
        if text == before[i]:
            grams = {text[k : k + 120] for k in range(len(text) - 119)}
            assert not grams & seen
            seen |= grams


def test_mixture_repeats_or_drops(stages):
    before, after = stages[3].toPandas(), stages[4].toPandas()
    counts = after.doc_id.value_counts()
    assert counts.max() <= 3
    assert set(counts.index) <= set(before.doc_id)


def test_encoding_round_trip(stages):
    import hashlib

    docs = stages[4].toPandas().drop_duplicates("doc_id").set_index("doc_id").text
    own = bpe.codec(bpe.default_vocabulary())
    import numpy as np

    for r in stages[5].toPandas().drop_duplicates("doc_id").itertuples():
        assert own.decode(np.array(r.ids, dtype=np.int64)) == docs[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(r.ids)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    want = stages[5].toPandas()
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got[cols].sort_values(cols).values.tolist() == want[cols].sort_values(cols).values.tolist()


def test_a_named_run_goes_on_after_its_last_whole_stage(spark, monkeypatch, tmp_path):
    calls: list[str] = []

    def counted(name: str, fails: bool):
        def stage(session, docs, sf_dir):
            calls.append(name)
            if fails:
                raise RuntimeError("lost")
            return docs.limit(50) if name == "quality" else docs

        return stage

    name = f"resumed-{tmp_path.name}-{id(calls)}"
    names = [n for n, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(n, n == "mixture")) for n in names])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, SF, resume=name)
    assert calls == names[:4]
    calls.clear()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(n, False)) for n in names])
    assert corpus_pipeline.run(spark, SF, resume=name).count() == 50
    assert calls == names[3:]


def test_awkward_columns_and_rows(spark, tmp_path):
    text = "some words that go on, and on, for long enough to be a line of text in a document of its own.\n" * 2
    rows = [(1, text, "en", "a", 1, "kk", "hh", "cc", 7), (2, None, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None), (None, "", "en", "", 0, "x", "y", "z", 8), (3, text, "en", "a", 1, "k3", "h3", "c3", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, h string, copies string, predicted int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = docs.toPandas()
    assert set(left.dropna(subset="k").k) <= {"kk", "x", "k3"}


@pytest.mark.parametrize("n", range(5))
def test_empty_documents(spark, tmp_path, n):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[n][1](spark, docs, str(tmp_path)).count() == 0


def test_labels_decide(spark):
    field = quality.unlabelled_field()
    assert field.scores([b"", b"a\nb"]).tolist() == pytest.approx([0.5, 0.5])
