"""Quality rules and perplexity bands.

Two models, both modified Kneser-Ney, both counted by Spark over all documents and kept in arrays sorted by hash:

- Spelling: order 4 over the 256 bytes as they are. The different 4-grams, which grow far more slowly than the text, go to
  every task.
- Words (``words.py``), one model per language: order 4 over 16 word shapes, or the shapes' shares without context, and of
  each word given its shape a discounted share that backs off to the shape's vocabulary. The word table grows with the corpus; it stays split by the
  hash of (language, word), and what a group of documents asks is joined to it.

Every document's three log-perplexities are compared with the documents of its language: a document passes if each lies
within so many robust deviations (and a least width at least) of its language's median, on either side, with more room
for short texts. Medians and deviations are taken over all documents of at least 50 words.

Bigrams of words are not counted: of 1.3 million neighbouring pairs in 8 MB of these texts 0.95 million are different, so
that the keys alone are 1.1 times the input and with the texts that they are joined to over the budget of 1.5.

Edge cases: a null text counts as empty; documents under 50 words fail the base rules whatever their perplexity. A null
language is a language of its own. Repeated rows, null doc_id and extra columns are harmless; an empty table gives an
empty result. The table is read twice in the same partitions; should the second reading give other rows, the query
stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm import words
from dendrolith.llm.common import U64, cut, mix64, table, texts_as_bytes

ORDER = 4
SYMBOLS, BYTES = 40, 256
CHUNK = 1 << 21
#: log2 of the n-grams that a task remembers, and of the different ones that it gathers before it adds them up.
REMEMBERED, GATHERED = 22, 22
#: Half-widths of the bands in robust standard deviations, their least value in nats, and room for short texts (nats x sqrt(words)).
WIDTH_BELOW, WIDTH_ABOVE, LEAST, SHORT = 4.0, 4.0, 0.05, 0.2
#: The same for the word model.
WORD_BELOW, WORD_ABOVE, WORD_LEAST, WORD_SHORT = 4.0, 4.0, 0.2, 2.0
RULE_SYMBOLS = b"#*$%&|<>"


def byte_symbols() -> np.ndarray:
    """A coarse alphabet for callers that want one; the query does not. The symbol of each byte: 0-25 letters, 26 capitals, 27 digits, then blanks, marks and non-ASCII bytes."""
    out = np.full(256, 35, dtype=np.uint32)
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    for chars, symbol in ((b" ", 28), (b"\t\n\r\x0b\x0c", 29), (b".,;:", 30), (b"'\"-()", 31), (b"!?", 32), (b"|", 33), (b"#$%&*<>@=+~^{}[]\\/_`", 34)):
        out[list(chars)] = symbol
    out[128:192] = 37 + np.arange(64) % 3
    out[192:] = 36
    return out


SYMBOL_OF = byte_symbols()


def ngram_codes(texts: list[bytes], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of each text, text after text, and their number in each text; of the coarse alphabet, or with BYTES
    of the bytes as they are."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(sizes - ORDER + 1, 0)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    data = data.astype(np.uint32) if symbols == BYTES else SYMBOL_OF[data]
    if len(data) < ORDER:
        return np.zeros(0, dtype=np.uint32), counts
    code = data[: len(data) - ORDER + 1].copy()
    for k in range(1, ORDER):
        code *= symbols
        code += data[k : len(data) - ORDER + 1 + k]
    inside = np.ones(len(data), dtype=bool)
    ends = np.cumsum(sizes)
    for k in range(1, ORDER):  # the last positions of a text start no n-gram
        at = (ends - k)[sizes >= k]
        inside[at] = False
    return code[inside[: len(code)]], counts


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > most:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes in ascending order with their counts summed over the parts."""
    codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(which, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))]
    waiting = 0
    for b in batches:
        for part in chunks(texts_as_bytes(b.column("text"))):
            total.append(np.unique(ngram_codes(part, BYTES)[0], return_counts=True))
            waiting += len(total[-1][0])
            if waiting > 1 << GATHERED:
                total, waiting = [added(total)], 0
    found, n = added(total)
    for at in range(0, len(found), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 100_000].astype(np.int64)), pa.array(n[at : at + 100_000])], names=["code", "n"])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(code, n) of the byte n-grams over all texts."""
    return docs.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class HashedModel:
    """For each order, hashes in ascending order with log-probabilities of n-grams, and log back-off weights of contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    symbols: int = SYMBOLS

    @staticmethod
    def key(order: int, codes: np.ndarray) -> np.ndarray:
        return mix64(codes.astype(U64) + U64(order << 56))

    @staticmethod
    def find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = arrays
        if not len(hashes):
            return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        hit = hashes[at] == keys
        return np.where(hit, values[at], 0).astype(np.float32), hit

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log P(last symbol | the symbols before), backing off to shorter contexts where an n-gram is absent."""
        out = np.zeros(len(codes), dtype=np.float64)
        open_ = np.arange(len(codes))
        rest = codes.astype(np.int64)
        for order in range(ORDER, 0, -1):
            value, hit = self.find(self.grams[order - 1], self.key(order, rest))
            out[open_[hit]] += value[hit]
            open_, rest = open_[~hit], rest[~hit]
            back, _ = self.find(self.contexts[order - 1], self.key(order, rest // self.symbols))
            out[open_] += back
            rest = rest % self.symbols ** (order - 1)
        out[open_] -= np.log(self.symbols)
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the counts of counts; 0 <= Dk <= k where those are too few."""
    n = [0.0] + [float((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    d = [0.0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else k / 2 for k in (1, 2, 3)]
    return np.array(d)


def kneser_ney(codes: np.ndarray, counts: np.ndarray, symbols: int = SYMBOLS) -> HashedModel:
    """Interpolated modified Kneser-Ney from the counts of the longest n-grams."""
    levels = {ORDER: (codes.astype(np.int64), counts.astype(np.int64))}
    for order in range(ORDER - 1, 0, -1):  # lower orders count distinct symbols to the left
        shorter, n = np.unique(levels[order + 1][0] % symbols**order, return_counts=True)
        levels[order] = shorter, n
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    contexts: list[tuple[np.ndarray, np.ndarray]] = []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for order in range(1, ORDER + 1):
        own, n = levels[order]
        d = discounts(n)
        kind = np.minimum(n, 3)
        context, which = np.unique(own // symbols, return_inverse=True)
        total = np.bincount(which, weights=n, minlength=len(context))
        back = np.bincount(which, weights=d[kind], minlength=len(context)) / np.maximum(total, 1)
        if lower is None:
            below = np.full(len(own), 1.0 / symbols)
        else:
            below = lower[1][np.searchsorted(lower[0], own % symbols ** (order - 1))]
        p = (n - d[kind]) / np.maximum(total[which], 1) + back[which] * below
        lower = own, p
        for keep, key, value in ((grams, own, p), (contexts, context, back)):
            hashes = HashedModel.key(order, key)
            at = np.argsort(hashes)
            keep.append((hashes[at], np.log(np.maximum(value[at], 1e-12)).astype(np.float32)))
    return HashedModel(grams, contexts, symbols)


def train(docs: DataFrame) -> HashedModel:
    rows = count_ngrams(docs).toArrow()  # a row per different n-gram of bytes
    codes, counts = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    at = np.argsort(codes)
    return kneser_ney(codes[at], counts[at], BYTES)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    plain = b"".join(words)
    chars = len(plain) if plain.isascii() else len(plain.decode("utf-8", "replace"))
    n_symbols = len(plain) - len(plain.translate(None, RULE_SYMBOLS))
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += bool(line.strip())
        else:
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=len(words))
        _, pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, which, n = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = n[which] > 1
        if twice.any():
            covered = np.zeros(len(words), dtype=bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return len(words), chars, n_symbols, duplicates, repeated


class Remembered:
    """Log-probabilities of n-grams met before, a slot per hash: the n-gram that comes later takes the slot."""

    def __init__(self, model: HashedModel):
        self.model = model
        self.codes, self.values = np.zeros(1 << REMEMBERED, dtype=np.uint32), np.full(1 << REMEMBERED, np.nan, dtype=np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        slot = codes * np.uint32(0x9E3779B1) >> np.uint32(32 - REMEMBERED)
        value = self.values[slot]
        missing = np.flatnonzero((self.codes[slot] != codes) | np.isnan(value))
        if len(missing):
            new, which = np.unique(codes[missing], return_inverse=True)
            found = self.model.log_probability(new).astype(np.float32)
            value[missing] = found[which]
            slot = new * np.uint32(0x9E3779B1) >> np.uint32(32 - REMEMBERED)
            slot, first = np.unique(slot, return_index=True)
            self.codes[slot], self.values[slot] = new[first], found[first]
        return value


def spelling(texts: list[bytes], known: Remembered) -> np.ndarray:
    """Negative mean log-probability of the n-grams of each text."""
    logs = []
    for part in chunks(texts):
        codes, counts = ngram_codes(part, known.model.symbols)
        value = known.of(codes)
        sums = np.add.reduceat(np.concatenate([value, [0]]).astype(np.float64), np.minimum(np.cumsum(counts) - counts, len(value)))
        logs.append(np.where(counts > 0, -sums / np.maximum(counts, 1), np.nan))
    return np.concatenate(logs) if logs else np.zeros(0)


MEASURED = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "word_log_perplexity", "unigram_log_perplexity"]
MEASURED_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, word_log_perplexity double, unigram_log_perplexity double"


def measure(docs: DataFrame, letters: HashedModel, n_buckets: int | None = None, group: int = words.GROUP) -> DataFrame:
    """(doc_id, lang, the base counts, the log-perplexities) of every document."""
    n_buckets = n_buckets or words.buckets(docs)
    asked = words.asked(docs, n_buckets, group)
    answered = cut(words.answered(asked))
    shared = docs.sparkSession.sparkContext.broadcast((letters, words.shape_models(answered), words.discount_table(answered)))  # a row per different n-gram of bytes, and shapes by language
    grouped = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(words.grouping(group), words.GROUPS)

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:  # statistics, which belong to no group
            return pa.table({n: pa.array([], t) for n, t in zip(MEASURED, [pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 3], strict=True)})
        spelled, shapes, stats = shared.value
        texts, langs = words.texts_of(own)
        letters_ = spelling(texts, Remembered(spelled))
        word_ = words.scores(texts, langs, answers, n_buckets, shapes, stats)
        base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
        floats = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (letters_, *word_)]
        return pa.table([pa.array(own.column("doc_id")[0].as_py(), pa.int64()), pa.array(langs, pa.string()), *(pa.array(base[:, k]) for k in range(5)), *floats], names=MEASURED)

    return grouped.groupBy("grp").cogroup(answered.where(F.col("shape") == words.ANSWER).groupBy("grp")).applyInArrow(run, MEASURED_SCHEMA)


#: What is compared with the documents of a language: column, half-widths below and above in robust deviations, least half-width, room.
COMPARED = (("log_perplexity", WIDTH_BELOW, WIDTH_ABOVE, LEAST, SHORT), ("word_log_perplexity", WORD_BELOW, WORD_ABOVE, WORD_LEAST, WORD_SHORT), ("unigram_log_perplexity", WORD_BELOW, WORD_ABOVE, WORD_LEAST, WORD_SHORT))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low_k, high_k of each compared column): median and median absolute deviation of a language's documents of at
    least 50 words; shorter ones fail the base rules."""
    base = measured.where(F.col("n_words") >= 50)
    medians = [F.percentile_approx(c, 0.5, 10000).alias(f"_m{k}") for k, (c, *_) in enumerate(COMPARED)]
    median = base.groupBy("lang").agg(*medians)
    away = base.join(median.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    names = [f"_m{k}" for k in range(len(COMPARED))]
    spread = away.groupBy("lang", *names).agg(*[(1.4826 * F.percentile_approx(F.abs(F.col(c) - F.col(f"_m{k}")), 0.5, 10000)).alias(f"_s{k}") for k, (c, *_) in enumerate(COMPARED)])
    ends = []
    for k, (_, below, above, least, _) in enumerate(COMPARED):
        ends.append((F.col(f"_m{k}") - F.greatest(F.lit(least), below * F.col(f"_s{k}"))).alias(f"low_{k}"))
        ends.append((F.col(f"_m{k}") + F.greatest(F.lit(least), above * F.col(f"_s{k}"))).alias(f"high_{k}"))
    return spread.select(F.col("lang").alias("_lang"), *ends)


def judge(docs: DataFrame) -> DataFrame:
    """All measurements of (doc_id, lang, text) with base_failed and kept."""
    measured = cut(measure(docs, train(docs)))
    inside = F.lit(True)
    for k, (c, _, _, _, short) in enumerate(COMPARED):
        room = short / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
        inside &= F.coalesce(F.col(c).between(F.col(f"low_{k}") - room, F.col(f"high_{k}") + room), F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(bands(measured), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def op3_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity", "unigram_log_perplexity", "lang", *[f"{end}_{k}" for k in range(len(COMPARED)) for end in ("low", "high")])
