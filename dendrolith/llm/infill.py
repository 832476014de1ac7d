"""Fill-in-the-middle documents, cut at tokens that a parallel scan of a finite automaton finds.

A text is a sequence of tokens ``[A-Za-z]+|[^A-Za-z]``. Two small automata run over its UTF-8 bytes: one counts the bytes
at which a token starts (its state is whether the byte before was a letter), one looks for a marker. A piece of a text does
not know in which state it begins, so it gives a function instead: for each state the state that it ends in, and how many
tokens start inside. Functions compose associatively; a scan over the pieces gives every piece its entry state and the
number of tokens before it, and only the piece that holds a cut is walked again.

The same algebra works at two levels. A text of up to CHUNK bytes is scanned inside its task, all pieces of a batch at
once. A larger one is dealt out: its chunks go to tasks of their own, each sends one function, a row of a few numbers; the
functions of a document meet, and its two cuts come back as a chunk, an entry state and a rank inside that chunk.

Draws h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:doc_id``. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) tokens, the middle after the larger. A document stays plain if its text is empty or holds a
marker, or for h3 % 100 >= 100 - plain; else it is spm for h4 % 100 < spm, and psm otherwise.

Edge cases: a null text is an empty one. A null doc_id draws by ``seed:`` alone. Repeated rows give equal results, a row
each. Bytes of one character are never parted. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import slices, table, texts_as_bytes

#: Bytes of a text that one task scans by itself, and of a piece of it.
CHUNK, PIECE = 1 << 15, 64
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, PLAIN, SPM = 1, 10, 20


class Automaton(NamedTuple):
    """Classes of bytes (class 0 stands for no byte), next states and counted steps by class and state."""

    classes: np.ndarray
    after: np.ndarray
    counts: np.ndarray


def _automaton(states: int, classes: list[bytes], step: list[list[tuple[int, int]]]) -> Automaton:
    """``classes[i]`` are the bytes of class i + 1, all others of class 1 + len(classes); step gives (next, counted)."""
    of = np.full(256, len(classes) + 1, dtype=np.uint8)
    for i, members in enumerate(classes):
        of[list(members)] = i + 1
    rows = [[(s, 0) for s in range(states)], *step]
    return Automaton(of, np.array([[n for n, _ in r] for r in rows], dtype=np.uint8), np.array([[c for _, c in r] for r in rows], dtype=np.uint8))


LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
CONTINUED = bytes(range(0x80, 0xC0))
#: States: outside or inside a run of letters; a step is counted where a token starts.
TOKENS = _automaton(2, [LETTERS, CONTINUED], [[(1, 1), (1, 0)], [(0, 0), (1, 0)], [(0, 1), (0, 1)]])
#: States: nothing, an opening bracket, a name after it, a whole marker seen.
MARKERS = _automaton(4, [b"<", b"PSM", b">"], [[(1, 0), (1, 0), (1, 0), (3, 0)], [(0, 0), (2, 0), (0, 0), (3, 0)], [(0, 0), (0, 0), (3, 0), (3, 0)], [(0, 0), (0, 0), (0, 0), (3, 0)]])


class Functions(NamedTuple):
    """What pieces do to each entry state: the state after it and the steps counted, a row per piece."""

    after: np.ndarray
    counts: np.ndarray

    def then(self, other: Functions) -> Functions:
        return Functions(np.take_along_axis(other.after, self.after.astype(np.intp), 1), self.counts + np.take_along_axis(other.counts, self.after.astype(np.intp), 1))

    def take(self, at: np.ndarray) -> Functions:
        return Functions(self.after[at], self.counts[at])


def pieces_of(texts: list[bytes], classes: np.ndarray, width: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all bytes in rows of ``width``, texts starting at rows of their own, and the number of rows of each text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    rows = -(-sizes // width)
    out = np.zeros(int(rows.sum()) * width, dtype=np.uint8)
    flat = classes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    start = (np.cumsum(rows) - rows) * width
    out[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return out.reshape(-1, width), rows


def functions_of(pieces: np.ndarray, machine: Automaton) -> Functions:
    """The function of every piece: all pieces take their bytes in step."""
    states = machine.after.shape[1]
    after = np.tile(np.arange(states, dtype=np.uint8), (len(pieces), 1))
    counts = np.zeros((len(pieces), states), dtype=np.int64)
    follow, counted = machine.after.ravel(), machine.counts.ravel()
    for column in np.ascontiguousarray(pieces.T):
        at = column.astype(np.intp)[:, None] * states + after
        counts += counted[at]
        after = follow[at]
    return Functions(after, counts)


def entries(found: Functions, rows: np.ndarray) -> Functions:
    """Inclusive scan: the composition of each piece with all pieces before it in its text."""
    place = np.arange(len(found.after)) - np.repeat(np.cumsum(rows) - rows, rows)
    step = 1
    while step < int(rows.max(initial=0)):
        late = np.flatnonzero(place >= step)
        joined = found.take(late - step).then(found.take(late))
        after, counts = found.after.copy(), found.counts.copy()
        after[late], counts[late] = joined
        found = Functions(after, counts)
        step *= 2
    return found


class Scan:
    """Texts scanned by one automaton, each from an entry state of its own."""

    def __init__(self, texts: list[bytes], machine: Automaton, entry: np.ndarray | None = None, width: int = PIECE):
        self.machine, self.width = machine, width
        self.pieces, self.rows = pieces_of(texts, machine.classes, width)
        self.first = np.cumsum(self.rows) - self.rows
        self.scanned = entries(functions_of(self.pieces, machine), self.rows)
        self.entry = np.zeros(len(texts), dtype=np.int64) if entry is None else entry
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))

    def whole(self) -> Functions:
        """The function of each text; the identity for an empty one."""
        states = self.machine.after.shape[1]
        after = np.tile(np.arange(states, dtype=np.uint8), (len(self.rows), 1))
        counts = np.zeros((len(self.rows), states), dtype=np.int64)
        full = np.flatnonzero(self.rows)
        after[full], counts[full] = self.scanned.take((self.first + self.rows - 1)[full])
        return Functions(after, counts)

    def starts(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte offset in its text of the counted step of each ``rank`` (from 0); the text's length where it has no more."""
        out = self.sizes[text].copy()
        of_piece = np.repeat(np.arange(len(self.rows)), self.rows)
        entered = self.entry[of_piece]
        upto = np.take_along_axis(self.scanned.counts, entered[:, None], 1)[:, 0]
        state = np.take_along_axis(self.scanned.after, entered[:, None], 1)[:, 0]
        begins = np.arange(len(upto)) == self.first[of_piece] if len(upto) else np.zeros(0, dtype=bool)
        before = np.where(begins, 0, np.roll(upto, 1))
        state = np.where(begins, entered, np.roll(state, 1))
        total = np.zeros(len(self.rows), dtype=np.int64)
        full = self.rows > 0
        total[full] = upto[(self.first + self.rows - 1)[full]]
        inside = np.flatnonzero(rank < total[text])
        if not len(inside):
            return out
        base = np.concatenate([[0], np.cumsum(total)])  # ranks of all texts on one line
        at = np.searchsorted(upto + base[of_piece], rank[inside] + base[text[inside]], side="right")
        left = rank[inside] - before[at]
        now, place = state[at].astype(np.intp), np.full(len(inside), -1)
        for j in range(self.width):
            column = self.pieces[at, j].astype(np.intp)
            step = self.machine.counts[column, now].astype(np.int64)
            place[(place < 0) & (step == 1) & (left == 0)] = j
            left -= step
            now = self.machine.after[column, now].astype(np.intp)
        out[inside] = (at - self.first[text[inside]]) * self.width + place
        return out


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def form_of(text: bool, marked: bool, drawn: list[int], plain: int, spm: int) -> str:
    if not text or marked or drawn[2] % 100 >= 100 - plain:
        return "plain"
    return "spm" if drawn[3] % 100 < spm else "psm"


def woven(text: bytes, form: str, one: int, two: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text again, from an output and its form alone."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    prefix, suffix = head.split(SUFFIX, 1) if form == "psm" else reversed(head.split(PREFIX, 1))
    return prefix.removeprefix(PREFIX) + middle + suffix.removeprefix(SUFFIX)


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _finished(ids: pa.Array, texts: list[bytes], n: list[int], forms: list[str], cuts: np.ndarray, digests: bool) -> pa.RecordBatch:
    heads, middles, one, two = [], [], [], []
    for text, form, (a, b) in zip(texts, forms, cuts.tolist(), strict=True):
        out = woven(text, form, a, b)
        heads.append(None if form == "plain" else len(text[:a].decode()))
        middles.append(None if form == "plain" else len(text[a:b].decode()))
        one.append(hashlib.sha256(out).hexdigest() if digests else out.decode())
        if digests:
            two.append(hashlib.sha256(restored(out, form)).hexdigest())
    columns = [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(one, pa.string())]
    columns += [pa.array(two, pa.string())] * digests
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (DIGESTS if digests else SCHEMA).split(", ")])


def _whole(seed: int, plain: int, spm: int, digests: bool):
    """Texts that a task scans by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts, ids = texts_as_bytes(b.column("text")), b.column("doc_id")
            scan = Scan(texts, TOKENS)
            n = scan.whole().counts[:, 0]
            marked = np.zeros(len(texts), dtype=bool)
            if open_ := [k for k, t in enumerate(texts) if b"<" in t]:
                marked[open_] = Scan([texts[k] for k in open_], MARKERS).whole().after[:, 0] == 3
            drawn = [draws(d, seed) for d in ids.to_pylist()]
            ranks = np.sort(np.array([[d[0] % (k + 1), d[1] % (k + 1)] for d, k in zip(drawn, n.tolist(), strict=True)], dtype=np.int64).reshape(-1, 2), axis=1)
            cuts = scan.starts(np.repeat(np.arange(len(texts)), 2), ranks.ravel()).reshape(-1, 2)
            forms = [form_of(bool(t), bool(m), d, plain, spm) for t, m, d in zip(texts, marked, drawn, strict=True)]
            yield _finished(ids, texts, n.tolist(), forms, cuts, digests)

    return run


FUNCTION = "key binary, doc_id long, chunk long, after binary, counts array<long>, marks binary"


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 512):
        parts = texts_as_bytes(b.column("part"))
        found, marks = Scan(parts, TOKENS).whole(), Scan(parts, MARKERS).whole()
        columns = [b.column("key"), b.column("doc_id"), b.column("chunk"), pa.array([x.tobytes() for x in found.after], pa.binary()), pa.array(found.counts.tolist(), pa.list_(pa.int64())), pa.array([x.tobytes() for x in marks.after], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "chunk", "after", "counts", "marks"])


PLACED = "key binary, n long, marked boolean, chunks array<long>, entry array<int>, ranks array<long>"


def _placed(seed: int):
    """The functions of one document's chunks to its number of tokens and where its cuts lie."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        after = np.frombuffer(b"".join(rows.column("after").to_pylist()), dtype=np.uint8).reshape(-1, 2)
        found = Functions(after, np.array(rows.column("counts").to_pylist(), dtype=np.int64))
        marks = Functions(np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, 4), np.zeros((len(after), 4), dtype=np.int64))
        scanned = entries(found, np.array([len(after)]))
        upto = scanned.counts[:, 0]
        n = int(upto[-1])
        drawn = draws(rows.column("doc_id")[0].as_py(), seed)
        ranks = np.sort([drawn[0] % (n + 1), drawn[1] % (n + 1)])
        at = np.minimum(np.searchsorted(upto, ranks, side="right"), len(upto) - 1)
        entry = np.where(at > 0, scanned.after[at - 1, 0], 0)
        inside = ranks - np.where(at > 0, upto[at - 1], 0)
        marked = bool(entries(marks, np.array([len(after)])).after[-1, 0] == 3)
        columns = [rows.column("key")[:1], pa.array([n], pa.int64()), pa.array([marked]), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([entry.tolist()], pa.list_(pa.int32())), pa.array([inside.tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["key", "n", "marked", "chunks", "entry", "ranks"])

    return run


def _cut(seed: int, plain: int, spm: int, digests: bool, chunk: int):
    """Large texts with the place of their cuts: only the chunks that hold one are walked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts, ids = texts_as_bytes(b.column("text")), b.column("doc_id")
            chunks, entry, ranks = (np.array(b.column(c).to_pylist(), dtype=np.int64).reshape(-1, 2) for c in ("chunks", "entry", "ranks"))
            parts = [t[c * chunk : (c + 1) * chunk] for t, both in zip(texts, chunks.tolist(), strict=True) for c in both]
            scan = Scan(parts, TOKENS, entry.ravel())
            cuts = chunks * chunk + scan.starts(np.arange(len(parts)), ranks.ravel()).reshape(-1, 2)
            forms = [form_of(bool(t), m, draws(d, seed), plain, spm) for t, m, d in zip(texts, b.column("marked").to_pylist(), ids.to_pylist(), strict=True)]
            yield _finished(ids, texts, b.column("n").to_pylist(), forms, cuts, digests)

    return run


def fill_in_middle(docs: DataFrame, digests: bool = False, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) rows to (doc_id, n, form, prefix_chars, middle_chars, output), or to digests of output and rebuilt text."""
    schema = DIGESTS if digests else SCHEMA
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    short = docs.where(size <= chunk).mapInArrow(_whole(seed, plain, spm, digests), schema)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.sha2("text", 256))
    long = docs.where(size > chunk).withColumn("key", F.encode(name, "UTF-8"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk))
    dealt = long.select("key", "doc_id", F.encode("text", "UTF-8").alias("bytes"), F.explode(numbers).alias("chunk"))
    dealt = dealt.select("key", "doc_id", "chunk", F.substring("bytes", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("part")).repartition("key", "chunk")
    found = dealt.mapInArrow(_chunk_functions, FUNCTION).dropDuplicates(["key", "chunk"])
    placed = found.groupBy("key").applyInArrow(_placed(seed), PLACED)
    return short.union(long.join(placed, "key").mapInArrow(_cut(seed, plain, spm, digests, chunk), schema))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document."""
    return fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok FROM documents
), cuts AS (
  SELECT doc_id, t, tok, len(tok) AS n,
         ('0x' || hex[1:8])::BIGINT % (len(tok) + 1) AS one, ('0x' || hex[9:16])::BIGINT % (len(tok) + 1) AS two,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || hex[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || hex[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(tok[1:least(one, two)], '') AS p,
         array_to_string(tok[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(tok[greatest(one, two) + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
