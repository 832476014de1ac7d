"""Stupid-backoff scores from count tables partitioned by n-gram hash.

Documents travel in groups of about GROUP bytes of text. Each group explodes its texts into n-grams of order 1 to 3 and
asks, bucket by bucket of the n-gram hash, for the corpus counts of the n-grams it holds, each asked once per group with
its local count. A bucket's task adds up the local counts, which makes its slice of the count table, joins the table to
what every group asked and sends the counts back. The group then scores its n-grams, which are summed per document. Both
joins move sorted keys, not rows per n-gram; the texts are shuffled once, compressed, as both uses of a group read the
same exchange. A very common n-gram has an entry per group, not per occurrence. Buckets grow in number with the bytes of
the corpus, about BUCKET each, so that what a bucket's task holds does not grow.

A key is the whole 64-bit hash of an n-gram and buckets are ranges of keys, so counts do not depend on their number. Two
of n different n-grams of an order share a hash with probability n^2 / 2^65 at most: 2.4e-7 at three million.

For the words w1 w2 w3, the score is c(w1 w2 w3) / c(w1 w2) if the trigram was counted MIN_COUNT times at least, else
0.4 c(w2 w3) / c(w2) if the bigram was, else 0.16 c(w3) / N; the first two words of a text start at the lower orders.
Counts cover all documents.

Edge cases: a null, empty or blank text has no words and score 0. A text of over GROUP bytes is scored in pieces that
overlap by two words. Repeated rows count and score like any other; null doc_id gives a row; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import U64, cut, mix64, slices, table, texts_as_bytes

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
#: Bytes of text in a group and, about, behind a bucket of the count table.
GROUP = 8 << 20
BUCKET = 24 << 20
BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    known: dict[bytes, int] = {}
    get, digest = known.get, xxhash.xxh64_intdigest
    out: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for n, t in enumerate(texts):
        words = t.split()
        counts[n] = len(words)
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = digest(w, 7)
            out.append(h)
    return np.array(out, dtype=U64), counts


def places(counts: np.ndarray) -> np.ndarray:
    """Of each word, its place in its text."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def ngrams(words: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, n-gram hashes in text order and the position of their last word."""
    place = places(counts)
    found, h = [], words
    for order in range(1, ORDER + 1):
        if order > 1:
            h = mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + words[order - 1 :] + U64(order)) if len(h) > 1 else h[:0]
        last = np.arange(order - 1, order - 1 + len(h))
        inside = place[last] >= order - 1
        found.append((h[inside], last[inside]))
    return found


def bucketed(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 64-bit key) of n-gram hashes; buckets ascend with the keys."""
    key = mix64(h + U64(3))
    return ((key >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64), key


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys, as bytes of their differences by place value."""
    return _numbers(np.diff(keys, prepend=U64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_read_numbers(data).view(U64), dtype=U64)


def _numbers(values: np.ndarray) -> bytes:
    """Numbers by place value, which leaves long runs of zeros."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _read_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8")[:, 0]


def _distinct(h: np.ndarray, n_buckets: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams by (bucket, key): buckets, keys, local counts, and for each n-gram its place among them."""
    order, first, which, n = np.unique(bucketed(h, n_buckets)[1], return_index=True, return_inverse=True, return_counts=True)
    if weight is not None:
        n = np.bincount(which, weights=weight, minlength=len(order)).astype(np.int64)
    return bucketed(h[first], n_buckets)[0], order, n, which


def pieces(text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """(leading words that belong to the piece before, bytes) of a text, cut at blanks."""
    at, lead, look = 0, 0, most
    while len(text) - at > most and (blank := BLANKS.search(text, look)):
        end = blank.start()
        before = text[at:end].rsplit(None, ORDER - 1)[1:]
        if len(before) < ORDER - 1:  # a piece of fewer words than the next one needs goes on
            look = blank.end()
            continue
        yield lead, text[at:end]
        for word in reversed(before):
            end = text.rindex(word, at, end)
        at, lead, look = end, len(before), end + most
    yield lead, text[at:]


def _grouping(most: int):
    """One row per group: number, compressed texts, and of each piece its row, doc_id, leading words and size."""
    names = ["grp", "texts", "row", "doc_id", "lead", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        number, row, size = itertools.count(base), itertools.count(base), 0
        held: list[tuple[int, int | None, int, bytes]] = []

        def flushed() -> pa.RecordBatch:
            lists = [pa.array([[h[k] for h in held]], pa.list_(pa.int64())) for k in (0, 1, 2)]
            sizes = pa.array([[len(h[3]) for h in held]], pa.list_(pa.int64()))
            blob = zstandard.ZstdCompressor(level=9).compress(b"".join(h[3] for h in held))
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([blob], pa.binary()), *lists, sizes], names=names)

        for b in slices(batches, 512):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_as_bytes(b.column("text")), strict=True):
                own = next(row)
                for lead, piece in pieces(text, most):
                    held.append((own, doc_id, lead, piece))
                    size += len(piece) + 64
                    if size >= most:
                        yield flushed()
                        held, size = [], 0
        if held:
            yield flushed()

    return run


GROUPS = "grp long, texts binary, row array<long>, doc_id array<long>, lead array<long>, bytes array<long>"


def _words(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words of each piece, and for each word whether it is the piece's own."""
    blob = zstandard.ZstdDecompressor().decompress(group.column("texts")[0].as_py())
    ends = np.cumsum(group.column("bytes")[0].as_py()).tolist()
    words, counts = word_hashes([blob[s:e] for s, e in zip([0, *ends], ends, strict=False)])
    return words, counts, places(counts) >= np.repeat(np.array(group.column("lead")[0].as_py(), dtype=np.int64), counts)


def _asking(n_buckets: int):
    def run(group: pa.Table) -> pa.Table:
        words, counts, own_word = _words(group)
        grp = group.column("grp")[0].as_py()
        out: list[tuple[int, int, int, bytes, bytes]] = []
        for order, (h, last) in enumerate(ngrams(words, counts), 1):
            bucket, key, n, _ = _distinct(h, n_buckets, own_word[last])
            for b, s, e in _slices(bucket):
                out.append((b, order, grp, packed(key[s:e]), _numbers(n[s:e])))
        columns = zip(*out, strict=True) if out else ([], [], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "n", "grp", "keys", "counts"])

    return run


def _slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[s]), s, e) for s, e in zip(edges, edges[1:], strict=False) if e > s]


def _answering(block: pa.Table) -> pa.Table:
    """One order of one bucket: the sum of the local counts, sent to every group that asked."""
    keys = [unpacked(x) for x in block.column("keys").to_pylist()]
    counts = np.concatenate([_read_numbers(x) for x in block.column("counts").to_pylist()])
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=counts).astype(np.int64)[which]
    ends = np.cumsum([len(k) for k in keys])
    answers = [_numbers(total[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
    return pa.table([block.column("grp"), block.column("bucket"), block.column("n"), pa.array(answers, pa.binary())], names=["grp", "bucket", "n", "answer"])


def _scoring(n_buckets: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        words, counts, own_word = _words(group)
        got = {(o, b): a for o, b, a in zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True)}
        count = np.zeros((ORDER + 1, len(words)), dtype=np.int64)  # of the n-gram of each order that ends at a word
        for order, (h, last) in enumerate(ngrams(words, counts), 1):
            bucket, _, _, which = _distinct(h, n_buckets)
            totals = [_read_numbers(got[order, b]) for b, _, _ in _slices(bucket)]
            if totals:
                count[order, last] = np.concatenate(totals)[which]
        previous = np.zeros_like(count)
        previous[:, 1:] = count[:, :-1]
        place = places(counts)
        score, open_ = np.zeros(len(words)), own_word.copy()
        for order in range(ORDER, 1, -1):
            hit = open_ & (place >= order - 1) & (count[order] >= MIN_COUNT)
            steps = np.minimum(ORDER, place + 1) - order
            score[hit] = np.log(count[order][hit]) - np.log(previous[order - 1][hit]) + steps[hit] * np.log(BACKOFF)
            open_ &= ~hit
        steps = np.minimum(ORDER, place + 1) - 1
        score[open_] = np.log(count[1][open_]) + steps[open_] * np.log(BACKOFF)
        starts = np.minimum(np.cumsum(counts) - counts, len(words))
        total = lambda x: np.where(counts > 0, np.add.reduceat(np.append(x, 0), starts), 0)
        columns = [pa.array(group.column(c)[0].as_py(), pa.int64()) for c in ("row", "doc_id")]
        sums = [pa.array(total(own_word.astype(np.int64)).astype(np.int64)), pa.array(total(score).astype(float)), pa.array(total(open_.astype(np.int64)).astype(np.int64))]
        return pa.table([*columns, *sums], names=["row", "doc_id", "n_words", "log_sum", "n_unigram"])

    return run


def backoff_scores(docs: DataFrame, n_buckets: int | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, score): the sum of the log scores of all words of each text."""
    if not n_buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_buckets = 1 + size // BUCKET
    grouped = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_grouping(group), GROUPS)
    asked = grouped.groupBy("grp").applyInArrow(_asking(n_buckets), "bucket long, n long, grp long, keys binary, counts binary")
    answers = asked.groupBy("bucket", "n").applyInArrow(_answering, "grp long, bucket long, n long, answer binary")
    scored = cut(grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_scoring(n_buckets), "row long, doc_id long, n_words long, log_sum double, n_unigram long"))
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    each = scored.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "log_sum", "n_unigram")])
    return each.select("doc_id", "n_words", (F.col("log_sum") - F.col("n_unigram") * F.log(F.lit(float(total)))).alias("score"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, rounded so that it compares with the SQL."""
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"))


OP7_SQL = rf"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), words AS (
  SELECT rid, doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM base)
), grams AS (
  SELECT rid, i, w AS w3, lag(w, 1) OVER (PARTITION BY rid ORDER BY i) AS w2, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS w1 FROM words
), c1 AS (SELECT w3 AS a, count(*) AS n FROM grams GROUP BY 1),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM grams WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
scored AS (
  SELECT g.rid, CASE
    WHEN t.n >= {MIN_COUNT} THEN ln(t.n / h.n)
    WHEN b.n >= {MIN_COUNT} THEN ln(b.n / p.n) + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln({BACKOFF}) END
    ELSE ln(u.n / (SELECT count(*) FROM grams)) + least(g.i - 1, 2) * ln({BACKOFF}) END AS s
  FROM grams g JOIN c1 u ON u.a = g.w3
  LEFT JOIN c1 p ON p.a = g.w2
  LEFT JOIN c2 b ON b.a = g.w2 AND b.b = g.w3
  LEFT JOIN c2 h ON h.a = g.w1 AND h.b = g.w2
  LEFT JOIN c3 t ON t.a = g.w1 AND t.b = g.w2 AND t.c = g.w3
), sums AS (SELECT rid, count(*) AS n_words, sum(s) AS score FROM scored GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS score FROM base LEFT JOIN sums USING (rid)
"""
