"""n-gram hashes that differ only above their low 40 bits; texts in pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from dendrolith.llm import backoff
from dendrolith.llm.common import MASK64, U64


def unmixed(x: int) -> int:
    """The value that mix64 takes to x."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        y = x
        for _ in range(64 // shift + 1):
            y = x ^ (y >> shift)
        x = y * pow(factor, -1, 1 << 64) & MASK64
    return x


def test_close_hashes_are_counted_apart():
    mixed = [0x12345678_9ABCDEF0, 0x12345678_9ABCDEF0 ^ 1 << 47, 0x12345678_9ABCDEF0 ^ 1 << 62]
    h = np.array([unmixed(m) - 3 & MASK64 for m in mixed] * 2, dtype=U64)[:5]
    for n_buckets in (1, 3, 64):
        bucket, key, n, which = backoff._distinct(h, n_buckets)
        assert sorted(key.tolist()) == sorted(mixed)
        assert n[which].tolist() == [2, 2, 1, 2, 2]
        assert (np.diff(bucket) >= 0).all() and bucket.max() < n_buckets
        assert backoff.unpacked(backoff.packed(key)).tolist() == key.tolist()
    block = pa.table({"grp": [1, 2], "bucket": [0, 0], "n": [3, 3], "keys": [backoff.packed(np.sort(np.array(mixed[:k], dtype=U64))) for k in (2, 3)], "counts": [backoff._numbers(np.ones(k, dtype=np.int64)) for k in (2, 3)]})
    assert sorted(backoff._read_numbers(backoff._answering(block).column("answer")[1].as_py())) == [1, 2, 2]


def test_pieces_overlap_by_two_words():
    rng = np.random.default_rng(4)
    for most in (1, 5, 20, 200, 5000):
        for _ in range(40):
            words = [bytes(rng.choice([97, 98], rng.integers(1, 9)).astype(np.uint8)) for _ in range(int(rng.integers(0, 200)))]
            text = b" " * int(rng.integers(0, 3)) + b"\n ".join(words) + b"\t" * int(rng.integers(0, 3))
            got, at = [], 0
            for lead, piece in backoff.pieces(text, most):
                own = piece.split()
                assert own[:lead] == got[len(got) - lead :] and lead == (2 if at else 0)
                got += own[lead:]
                at += 1
            assert got == words


def test_scores_do_not_depend_on_groups_and_buckets(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (0, 1, 2, 3, 40, 400, 3000)] + [None, " \n", "w1 w2 w3", "w1 w2 w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: (r.n_words, r.score) for r in backoff.backoff_scores(docs).collect()}
    assert len(want) == len(texts) and want[6][0] == 3000 and want[7] == (0, 0)
    for n_buckets, group in ((1, 100), (7, 2500), (40, 1)):
        got = {r.doc_id: (r.n_words, r.score) for r in backoff.backoff_scores(docs, n_buckets, group).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
