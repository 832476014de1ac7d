"""Fill-in-the-middle against the plain reading of its definition."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrolith.llm import infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_reading(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward() -> list[tuple]:
    texts = [None, "", " ", "a", "é", "abc def", "x" * 500, "ß" * 300, "a1" * 200, "a<P>b", "ab <S", "<M>", "<" * 90 + "P>", "<<S>>", "y" * 63 + "<P>" + "z" * 80, "y" * 62 + "<M" + ">" * 3, "日本語 text \U0001f600 and more " * 20, "\n\r\t\x00\x85 end"]
    rows = [(i * 10 + k, t) for i, t in enumerate(texts) for k in range(6)]
    return [*rows, (None, "no id at all"), (None, None), (7, "twice " * 60), (7, "twice " * 60), (7, "other text")]


@pytest.mark.parametrize("chunk", [1 << 15, 96, 7])
def test_every_form_and_level(spark, chunk):
    rows = awkward()
    docs = spark.createDataFrame([(d, t, "K", "C", 1) for d, t in rows], "doc_id long, text string, key string, chunk string, n int").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in infill.fill_in_middle(docs, chunk=chunk).collect()), key=key)
    want = sorted((plain_reading(d, t) for d, t in rows), key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in infill.fill_in_middle(docs, digests=True, chunk=chunk).collect()), key=key)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == sorted(((*plain_reading(d, t)[:5], sha(plain_reading(d, t)[5]), sha(t or "")) for d, t in rows), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(docs).collect() == [] and infill.fill_in_middle(docs, digests=True).collect() == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="ab1<PSM> é日", max_size=60), min_size=1, max_size=5), st.integers(1, 9), st.integers(1, 20))
def test_scan_is_the_walk(texts, width, at):
    """Starts, functions and their composition do not depend on where a text is cut into pieces or chunks."""
    data = [t.encode() for t in texts]
    scan = infill.Scan(data, infill.TOKENS, width=width)
    for k, (text, raw) in enumerate(zip(texts, data, strict=True)):
        begins = [len(text[: m.start()].encode()) for m in TOKEN.finditer(text)]
        assert scan.whole().counts[k, 0] == len(begins)
        ranks = np.arange(len(begins) + 2)
        assert scan.starts(np.full(len(ranks), k), ranks).tolist() == [*begins, len(raw), len(raw)]
        parts = infill.Scan([raw[:at], raw[at:]], infill.MARKERS, width=width).whole()
        assert (parts.take(np.array([0])).then(parts.take(np.array([1]))).after[0, 0] == 3) == bool(re.search("<[PSM]>", text))


def test_restored_from_output_and_form():
    for text in (b"", b"<", b"<S", b"P>", b"<<M", b"ab cd"):
        for one in range(len(text) + 1):
            for two in range(one, len(text) + 1):
                for form in ("plain", "psm", "spm"):
                    assert infill.restored(infill.woven(text, form, one, two), form) == text
