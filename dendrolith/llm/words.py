"""Word probabilities from a word table that is split by hash, one model per language.

P(word | before) = P(shape | the three shapes before) x P(word | shape). The first factor is an order-4 modified
Kneser-Ney model over SHAPES word shapes of each language, small enough for every task. For the second, a word that was
counted c times has (c - D(c)) / N + (sum of the discounts / N) / V, with N tokens and V different words of that shape and
language, and D1, D2, D3+ from their counts of counts: a modified Kneser-Ney unigram model over the shape's vocabulary.
Text that keeps to one rare shape is likely in its own context; P(shape) in place of the first factor shows it.

The word table is a relation of sorted hash arrays. A group of about GROUP bytes of documents asks, bucket by bucket of the
64-bit hash of (language, word), for the counts of its words with its local counts; a bucket's task adds them up and sends
them back, with the counts of counts of its words by language and shape. Texts move once, compressed, to meet the answers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.llm.backoff import _numbers, _read_numbers, bucketed, packed, unpacked
from dendrolith.llm.common import U64, slices, texts_as_bytes

GROUP = 8 << 20
BUCKET = 32 << 20
SHAPES = 16
BEGIN = SHAPES - 1
CONTEXT = 3
#: Languages whose shape models go to every task.
MOST_LANGUAGES = 1000
SYMBOLS = b"#*$%&|<>@=+~^{}[]\\/_`"
STOPS = b".,;:!?"
NO_LANGUAGE = 0x5DEECE66D

KIND = bytearray(b"o" * 256)
for _chars, _kind in ((bytes(range(97, 123)), b"l"), (bytes(range(65, 91)), b"u"), (bytes(range(48, 58)), b"d"), (bytes(range(128, 256)), b"w"), (SYMBOLS, b"s")):
    for _c in _chars:
        KIND[_c] = _kind[0]
KIND = bytes(KIND)


def shape_of(word: bytes) -> int:
    """0-6 by the characters, 7 more if a stop ends it: lower case, capitalised, other capitals, digits, marks only, symbols, non-ASCII letters."""
    body = word.rstrip(STOPS)
    kinds = set(body.translate(KIND))
    if 115 in kinds and kinds & {108, 117, 119, 100}:
        own = 5  # letters or digits with symbols
    elif not kinds & {108, 117, 119, 100}:
        own = 4
    elif 100 in kinds:
        own = 3
    elif 119 in kinds:
        own = 6
    elif 117 not in kinds:
        own = 0
    else:
        own = 1 if body[:1].isupper() and not body[1:].translate(KIND).count(b"u") else 2
    return own + (7 if len(body) < len(word) else 0)


def language_hash(lang: str | None) -> int:
    return NO_LANGUAGE if lang is None else xxhash.xxh64_intdigest(lang.encode(), 9)


class Tokens:
    """The words of some texts: ``which`` names, of each word, its place among the different (language, word) pairs."""

    def __init__(self, texts: list[bytes], langs: list[str | None]):
        self.names = list(dict.fromkeys(langs))
        at = {lang: n for n, lang in enumerate(self.names)}
        known: list[dict[bytes, int]] = [{} for _ in self.names]
        seeds = [language_hash(lang) for lang in self.names]
        digest = xxhash.xxh64_intdigest
        keys: list[int] = []
        shapes: list[int] = []
        owners: list[int] = []
        which: list[int] = []
        self.counts = np.zeros(len(texts), dtype=np.int64)
        for n, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            own = known[at[lang]]
            words = text.split()
            self.counts[n] = len(words)
            for w in set(words).difference(own):
                own[w] = len(keys)
                keys.append(digest(w, seeds[at[lang]]))
                shapes.append(shape_of(w))
                owners.append(at[lang])
            which.extend(map(own.__getitem__, words))
        self.which = np.array(which, dtype=np.int64)
        self.keys, self.shapes, self.langs = np.array(keys, dtype=U64), np.array(shapes, dtype=np.int64), np.array(owners, dtype=np.int64)


def shape_codes(shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each word, its shape and the three before it as one number; BEGIN stands before a text."""
    place = np.arange(len(shapes)) - np.repeat(np.cumsum(counts) - counts, counts)
    code = shapes.copy()
    for k in range(1, CONTEXT + 1):
        before = np.full(len(shapes), BEGIN)
        before[k:] = shapes[:-k] if k < len(shapes) or len(shapes) == k else shapes[:0]
        code += np.where(place >= k, before, BEGIN) * SHAPES**k
    return code


# shape models


def shape_counts(own: Tokens) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(language's number, codes, counts) of the shape n-grams."""
    code = shape_codes(own.shapes[own.which], own.counts) if len(own.which) else np.zeros(0, dtype=np.int64)
    lang = own.langs[own.which] if len(own.which) else code
    found, n = np.unique(lang * SHAPES ** (CONTEXT + 1) + code, return_counts=True)
    owner = found // SHAPES ** (CONTEXT + 1)
    return [(int(x), found[owner == x] % SHAPES ** (CONTEXT + 1), n[owner == x]) for x in np.unique(owner)]


def shape_models(rows: DataFrame) -> dict:
    """A model per language, from at most SHAPES^4 counts each."""
    from dendrolith.llm.perplexity import kneser_ney

    counted = rows.where(F.col("shape") == CODES).select("lang", F.explode(F.arrays_zip("codes", "stats")).alias("c")).groupBy("lang", F.col("c.codes").alias("code")).agg(F.sum("c.stats").alias("n"))
    own = counted.toPandas()  # languages x shapes
    found = {}
    for lang, part in own.groupby("lang", dropna=False):
        part = part.sort_values("code")
        found[None if lang != lang or lang is None else lang] = kneser_ney(part["code"].to_numpy(), part["n"].to_numpy(), SHAPES)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return found


# the word table


def grouped_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list]]:
    """(number, documents) of about ``most`` bytes each; numbers are the task's own."""
    number, size, held = itertools.count(TaskContext.get().partitionId() << 32), 0, []
    for b in slices(batches, 512):
        for doc_id, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), texts_as_bytes(b.column("text")), strict=True):
            held.append((doc_id, lang, text))
            size += len(text) + 64
            if size >= most:
                yield next(number), held
                size, held = 0, []
    if held:
        yield next(number), held


GROUPS = "grp long, texts binary, doc_id array<long>, lang array<string>, bytes array<long>"


def grouping(most: int):
    """One row per group: number, compressed texts, and of each document its doc_id, language and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in grouped_rows(batches, most):
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(h[2] for h in held))
            lists = [pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.string())), pa.array([[len(h[2]) for h in held]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), *lists], names=["grp", "texts", "doc_id", "lang", "bytes"])

    return run


def texts_of(group: pa.Table) -> tuple[list[bytes], list[str | None]]:
    blob = zstandard.ZstdDecompressor().decompress(group.column("texts")[0].as_py())
    ends = np.cumsum(group.column("bytes")[0].as_py()).tolist()
    return [blob[s:e] for s, e in zip([0, *ends], ends, strict=False)], group.column("lang")[0].as_py()


def buckets(docs: DataFrame) -> int:
    return 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET


def distinct(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Ascending keys, the order that makes them so, and the slices of the buckets."""
    bucket, key = bucketed(keys, n_buckets)
    order = np.argsort(key)
    own = bucket[order]
    edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    return key[order], order, [(int(own[s]), s, e) for s, e in zip(edges, edges[1:], strict=False) if e > s]


def check_of(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys).view(np.int64)) if len(keys) else 0


ASKED = "bucket long, grp long, langs array<string>, kinds binary, keys binary, counts binary"


def asked(docs: DataFrame, n_buckets: int, group: int = GROUP) -> DataFrame:
    """What each group asks of each bucket, once per word, with local counts, languages and shapes; its counts of shape
    n-grams go along to buckets of their own, below zero."""
    names = ["bucket", "grp", "langs", "kinds", "keys", "counts"]
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in grouped_rows(batches, group):
            own = Tokens([h[2] for h in held], [h[1] for h in held])
            found, order, parts = distinct(own.keys, n_buckets)
            n = np.bincount(own.which, minlength=len(own.keys))[order]
            kind = (own.langs * SHAPES + own.shapes)[order]
            rows = [(b, number, own.names, _numbers(kind[s:e]), packed(found[s:e]), _numbers(n[s:e])) for b, s, e in parts]
            rows += [(-1 - number % n_buckets, number, [own.names[x]], b"", packed(code.astype(U64)), _numbers(counts)) for x, code, counts in shape_counts(own)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], k) for k in types], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, ASKED)


#: In place of a shape: an answer to a group, or counts of shape n-grams.
ANSWER, CODES = -1, -2
ANSWERED = "grp long, bucket long, check long, answer binary, lang string, shape int, codes array<long>, stats array<long>"


def _add_codes(block: pa.Table) -> pa.Table:
    """Counts of shape n-grams, added up by language."""
    total: dict[str | None, np.ndarray] = {}
    for names, keys, counts in zip(block.column("langs").to_pylist(), block.column("keys").to_pylist(), block.column("counts").to_pylist(), strict=True):
        into = total.setdefault(names[0], np.zeros(SHAPES ** (CONTEXT + 1), dtype=np.int64))
        into[unpacked(keys).astype(np.int64)] += _read_numbers(counts)
    used = [np.flatnonzero(t) for t in total.values()]
    n, longs = len(total), pa.list_(pa.int64())
    empty = [pa.array([None] * n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    stats = [t[at].tolist() for t, at in zip(total.values(), used, strict=True)]
    return pa.table([*empty, pa.array(list(total), pa.string()), pa.array([CODES] * n, pa.int32()), pa.array([u.tolist() for u in used], longs), pa.array(stats, longs)], names=["grp", "bucket", "check", "answer", "lang", "shape", "codes", "stats"])


def _answer(block: pa.Table) -> pa.Table:
    """A bucket's slice of the word table: counts to every group that asked, and the counts of counts of its words."""
    if block.column("bucket")[0].as_py() < 0:
        return _add_codes(block)
    keys = [unpacked(x) for x in block.column("keys").to_pylist()]
    counts = np.concatenate([_read_numbers(x) for x in block.column("counts").to_pylist()])
    _, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    table = np.bincount(which, weights=counts).astype(np.int64)
    sizes = [len(k) for k in keys]
    ends = np.cumsum(sizes)
    answers = [_numbers(table[which[e - n : e]]) for n, e in zip(sizes, ends, strict=True)]
    # the language and shape of a word, as whoever asked first named them
    numbers: dict[str | None, int] = {}
    kinds = []
    for names, k in zip(block.column("langs").to_pylist(), block.column("kinds").to_pylist(), strict=True):
        to = np.array([numbers.setdefault(x, len(numbers)) for x in names], dtype=np.int64)
        own = _read_numbers(k)
        kinds.append(to[own // SHAPES] * SHAPES + own % SHAPES)
    kind = np.concatenate(kinds)[first]
    each = np.zeros((len(numbers) * SHAPES, 6), dtype=np.int64)  # words counted once, twice, three, four times; words; tokens
    for k in range(4):
        each[:, k] = np.bincount(kind[table == k + 1], minlength=len(each))
    each[:, 4] = np.bincount(kind, minlength=len(each))
    each[:, 5] = np.bincount(kind, weights=table, minlength=len(each)).astype(np.int64)
    used = np.flatnonzero(each[:, 4])
    langs = list(numbers)
    n, m = block.num_rows, len(used)
    return pa.table(
        [
            pa.array([*block.column("grp").to_pylist(), *[None] * m], pa.int64()), pa.array([*block.column("bucket").to_pylist(), *[None] * m], pa.int64()), pa.array([*[check_of(k) for k in keys], *[None] * m], pa.int64()),
            pa.array([*answers, *[None] * m], pa.binary()), pa.array([*[None] * n, *[langs[k // SHAPES] for k in used]], pa.string()), pa.array([*[ANSWER] * n, *[int(k) % SHAPES for k in used]], pa.int32()),
            pa.array([None] * (n + m), pa.list_(pa.int64())), pa.array([*[None] * n, *[each[k].tolist() for k in used]], pa.list_(pa.int64())),
        ],
        names=["grp", "bucket", "check", "answer", "lang", "shape", "codes", "stats"],
    )


def answered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(_answer, ANSWERED)


def discount_table(rows: DataFrame) -> dict[tuple[str | None, int], tuple[np.ndarray, float, float]]:
    """Of each language and shape: discounts by count, tokens, and the share of the probability that goes to each word alike."""
    sums = [F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(6)]
    found = {}
    for r in rows.where("shape >= 0").groupBy("lang", "shape").agg(*sums).collect():  # languages x shapes
        found[r["lang"], r["shape"]] = discounts_of([r[f"s{k}"] for k in range(4)], r["s4"], r["s5"])
    return found


def discounts_of(n: list[int], words: int, total: int) -> tuple[np.ndarray, float, float]:
    """(D by count 0..3+, tokens, share of each word) from the numbers of words counted one to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    d = [0.0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3)]
    more = words - n[0] - n[1]
    return np.array(d), float(total), (d[1] * n[0] + d[2] * n[1] + d[3] * more) / total / words


def scores(texts: list[bytes], langs: list[str | None], answers: pa.Table, n_buckets: int, shapes: dict, stats: dict) -> np.ndarray:
    """Of each text, negative mean log-probabilities of its words with and without their context; NaN without words."""
    own = Tokens(texts, langs)
    counts, which = own.counts, own.which
    if not len(which):
        return np.full((2, len(texts)), np.nan)
    found, order, parts = distinct(own.keys, n_buckets)
    got = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("check").to_pylist(), answers.column("answer").to_pylist(), strict=True), strict=True))
    count = np.zeros(len(found), dtype=np.int64)
    for b, s, e in parts:
        check, answer = got.get(b, (None, b""))
        if check != check_of(found[s:e]):
            raise RuntimeError("a second reading of the documents gave other rows than the first")
        count[order[s:e]] = _read_numbers(answer)
    code = shape_codes(own.shapes[which], counts)
    lang = own.langs[which]
    before, given, alone = np.zeros(len(which)), np.zeros(len(found)), np.zeros(len(found))
    for number, name in enumerate(own.names):
        at = np.flatnonzero(lang == number)
        if not len(at):
            continue
        kinds, back = np.unique(code[at], return_inverse=True)
        before[at] = shapes[name].log_probability(kinds)[back]
        every = sum(total for (x, _), (_, total, _) in stats.items() if x == name)
        for s in np.unique(own.shapes[own.langs == number]).tolist():
            here = np.flatnonzero((own.langs == number) & (own.shapes == s))
            d, total, share = stats[name, s]
            given[here] = np.log((count[here] - d[np.minimum(count[here], 3)]) / total + share)
            alone[here] = np.log(total / every)
    before, alone = before + given[which], (alone + given)[which]
    starts = np.minimum(np.cumsum(counts) - counts, len(which))
    mean = lambda x: np.where(counts > 0, -np.add.reduceat(np.append(x, 0.0), starts) / np.maximum(counts, 1), np.nan)
    return np.stack([mean(before), mean(alone)])
