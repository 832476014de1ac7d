"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are counts of byte classes, of words and of class changes, whether the
line occurred before, and the same figures of the line before and the line after. Transition weights tie neighbouring
labels. Forward-backward marginals, weighted by line length, give the document's score, the expected share of its text
that is good.

The field is fitted by gradient ascent on the conditional likelihood, on the driver, from a bounded sample: the
``sample`` labelled documents with the smallest seeded hash, of each at most ``most_lines`` consecutive lines from a seeded
place, and of these the first documents in the order of the hash up to ``total_lines`` lines; each line of a sampled
document carries the document's label. Scoring reads every line of every document.

Edge cases: a null, empty or blank text has one empty line and still gets a score. Without labelled documents every score
is the prior 0.5. A null doc_id counts as held out. If a document has several labels, each counts as a training row;
labels that are null are ignored; of several rows with one doc_id the one with the least hash of its text is sampled. Repeated rows each give a row; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrolith.llm.common import U64, mix64, slices, table, texts_as_bytes

SAMPLE = 6000
MOST_LINES = 400
TOTAL_LINES = 300_000
THRESHOLD = 0.3
SEED = 11
CHUNK = 1 << 21

LOWER, UPPER, DIGIT, SPACE, STOP, MARK, BAR, SYMBOL, WIDE, OTHER = range(10)


def byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, dtype=np.uint8)
    classes[128:] = WIDE
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\n\r\x0b\x0c", SPACE), (b".,;:'\"-()", STOP), (b"!?", MARK), (b"|", BAR), (b"#$%&*<>@=+~^{}[]\\/_`", SYMBOL)):
        classes[list(chars)] = kind
    return classes


CLASSES = byte_classes()
N_OWN = 22


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, lines of every text)."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    out, sizes = np.zeros((int(counts.sum()), N_OWN), dtype=np.float32), np.zeros(int(counts.sum()), dtype=np.int64)
    at, first = 0, 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) < CHUNK):
            total += len(texts[last]) + 1
            last += 1
        n = int(counts[first:last].sum())
        out[at : at + n], sizes[at : at + n] = _chunk_features(texts[first:last])
        at, first = at + n, last
    return out, sizes, counts


def _chunk_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = CLASSES[data]
    before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
    total = lambda flags: np.add.reduceat(flags, starts, dtype=np.int32).astype(np.float32)  # noqa: E731  each line holds its line end
    space = kind == SPACE
    odd = (kind == SYMBOL) | (kind == BAR) | (kind == MARK)
    lower, upper, wide = (total(kind == k) for k in (LOWER, UPPER, WIDE))
    words = total(~space & (before == SPACE))
    size = (ends - starts).astype(np.float32)
    of = lambda x, y: x / np.maximum(y, 1)
    seen = np.zeros(len(starts), dtype=np.float32)
    row = 0
    for t in texts:
        known: set[bytes] = set()
        for line in t.split(b"\n"):
            if line in known:
                seen[row] = 1 if line.strip() else 0
            known.add(line)
            row += 1
    letters = lower + upper + wide
    columns = [
        np.log1p(size), np.log1p(words), of(lower, size), of(upper, size), of(wide, size), of(total(kind == DIGIT), size), of(total(kind == STOP), size),
        of(total(kind == MARK), size), of(total(kind == BAR), size), of(total(kind == SYMBOL), size), of(total(kind == OTHER), size), of(size, words),
        of(total(odd & (before != SPACE) & (before != kind)), words), of(total(odd & (before == kind)), words), of(total((kind == UPPER) & (before == LOWER)), words),
        of(total((kind == UPPER) & (before == SPACE)), words), of(total((kind == STOP) & (before == LOWER)), words), of(upper, letters), (size == 0).astype(np.float32),
        (kind[np.maximum(ends - 1, 0)] == STOP).astype(np.float32), seen, (words <= 3).astype(np.float32),
    ]
    return np.stack(columns, axis=1), (ends - starts).astype(np.int64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own figures, those of the line before and the line after (zeros beyond the text), and flags for both ends."""
    ends = np.cumsum(counts)
    first, last = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    first[ends - counts], last[ends - 1] = True, True
    above, below = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    above[first], below[last] = 0, 0
    return np.concatenate([own, above, below, first[:, None], last[:, None]], axis=1).astype(np.float32)


class LineField:
    """Two-label chain: ``weights`` score the good label, ``change[i, j]`` scores label j after label i."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, change: np.ndarray):
        self.mean, self.scale, self.weights, self.change = mean, scale, weights, change

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def marginals(self, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, expected label changes summed over all chains, log normaliser of every chain."""
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
        score = np.zeros((len(good), 2))
        score[:, 1] = good
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        for t in range(longest):
            at = starts[: alive[t]] + t
            if t == 0:
                alpha[at] = score[at]
            else:
                alpha[at] = score[at] + np.logaddexp(alpha[at - 1, 0:1] + self.change[0], alpha[at - 1, 1:2] + self.change[1])
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            ahead = beta[at + 1] + score[at + 1]
            beta[at] = np.logaddexp(ahead[:, 0:1] + self.change[:, 0], ahead[:, 1:2] + self.change[:, 1])
        joint = alpha + beta
        norm = np.logaddexp(joint[:, 0], joint[:, 1])
        p = np.exp(joint[:, 1] - norm)
        inner = np.ones(len(good), dtype=bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(inner)
        pairs = np.exp(alpha[at - 1][:, :, None] + self.change[None] + (score[at] + beta[at])[:, None, :] - norm[at][:, None, None]).sum(axis=0)
        lasts = np.cumsum(counts) - 1
        return p, pairs, np.logaddexp(alpha[lasts, 0], alpha[lasts, 1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        own, sizes, counts = line_features(texts)
        if not len(counts):
            return np.zeros(0)
        p, _, _ = self.marginals(self.emission(with_neighbours(own, counts)), counts)
        starts = np.cumsum(counts) - counts
        weight = sizes + 1.0  # an empty line still counts, so that an empty text has a score
        return np.clip(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, counts: np.ndarray, rounds: int = 250, rate: float = 0.05, penalty: float = 1e-3) -> LineField:
    """Gradient ascent (Adam) on the penalised conditional likelihood; y holds the label of every line."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1), dtype=np.float32)], axis=1)
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    field = LineField(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    for k in range(1, rounds + 1):
        field.weights, field.change = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = field.marginals(z @ field.weights, counts)
        step = np.concatenate([z.T @ (y - p), (seen - pairs).ravel()]) / len(counts) - penalty * theta
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    field.weights, field.change = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def unlabelled_field() -> LineField:
    width = 3 * N_OWN + 2
    return LineField(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES, total_lines: int = TOTAL_LINES, seed: int = SEED) -> LineField:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    allowed = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good"))
    chosen = allowed.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_good").limit(sample)  # at most ``sample`` rows, hence small enough to broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own, _, counts = line_features(texts_as_bytes(b.column("text")))
            packed = []
            for end, n, h in zip(np.cumsum(counts).tolist(), counts.tolist(), b.column("_h").to_pylist(), strict=True):
                first = end - n + (h % (n - most_lines + 1) if n > most_lines else 0)
                packed.append(own[first : min(end, first + most_lines)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_good"), b.column("_h"), pa.array(packed, pa.binary())], names=["_id", "_good", "_h", "lines"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    keyed = rows.select(F.col("_id").cast("long").alias("_id"), F.col("_good").cast("int").alias("_good"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")
    one = keyed.mapInArrow(run, "_id long, _good int, _h long, lines binary").groupBy("_id", "_good").agg(F.min(F.struct("_h", "lines")).alias("r"))
    got = one.select("_id", "_good", "r.lines").collect()  # at most ``sample`` rows of ``most_lines`` lines
    if not got:
        return unlabelled_field()
    order = mix64(np.array([r["_id"] for r in got], dtype=np.int64).view(U64) ^ U64(seed))
    got = [got[k] for k in np.lexsort((np.array([r["_good"] for r in got]), np.array([r["_id"] for r in got]), order))]
    upto = np.cumsum([len(r["lines"]) // (4 * N_OWN) for r in got])
    got = got[: max(1, int(np.searchsorted(upto, total_lines, side="right")))]
    each = [np.frombuffer(r["lines"], dtype=np.float32).reshape(-1, N_OWN) for r in got]
    counts = np.array([len(e) for e in each], dtype=np.int64)
    y = np.repeat(np.array([r["_good"] for r in got]), counts)
    return fit(with_neighbours(np.concatenate(each), counts), y, counts)


def classify(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` and ``predicted``; texts go through whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(field.scores(texts_as_bytes(b.column("text"))))], names=[*b.schema.names, "score"])

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, field).select("doc_id", held_out().alias("held_out"), "score", "predicted")
