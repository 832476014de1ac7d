"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every position that has ``length`` bytes ahead starts a window; windows with equal bytes are repeats of the earliest one.
Suffixes are ordered through ``length`` bytes only, most significant digit first, and a group that falls to one member is
dropped at once; what is equal after the last digit is exactly the repeated windows.

The first digit is chosen so that it also deals the work out: the hash of a window's anchor, its leftmost 32-byte gram
of least hash. Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so that a
run of windows travels as one row (about one row in 35 positions). The passes:

1. Each task turns its texts into runs (anchor hash, two independent hashes of the whole run, document, place). Of equal
   runs in a batch only the earliest travels; the others are removed spans already.
2. Runs meet by anchor hash, sorted, and are read in blocks, so that what a task holds does not grow with an anchor's rows.
   Anchors met once are dropped. Of equal runs all but the earliest are removed spans; anchors with several different
   runs are undecided.
3. The bytes of undecided runs are fetched from their documents and meet by anchor hash again. There the remaining
   digits, eight bytes each, are sorted window by window. An anchor with more than HOT different runs (a phrase with
   ever different surroundings) is dealt out by the hash of the whole window instead, each window once per batch.
4. Spans are merged document by document and cut out. Texts under ``length`` bytes have none and pass by.

Runs are taken for equal by their anchor and 128 bits of hashes, without a look at their bytes: two different runs of one
anchor agree with probability 2^-128. Whatever the third pass decides, it decides on the bytes.

Document order is (doc_id, hash of the text), null doc_id last. Edge cases: a null text is empty; texts under ``length``
bytes lose nothing; a row equal to another one in doc_id and text counts as a later document. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrolith.llm.common import U64, ensure_checkpoint_dir, mix64, slices, table, texts_as_bytes

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
HOT = 5000
#: Rows that the second pass holds at a time.
BLOCK = 1 << 19
#: Windows sorted at a time.
AT_ONCE = 1 << 20
RUN, SPAN, UNDECIDED, CROWDED = 0, 1, 2, 3
LAST_ID = (1 << 63) - 1
MIXERS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)]
BYTE_HASH = mix64(np.arange(1, 257, dtype=U64) * MIXERS[0])
OTHER_HASH = mix64(np.arange(1, 257, dtype=U64) * MIXERS[6] + U64(0x51ED270B))


def shelf(spark, name: str | None = None) -> str:
    """A place for a table in the shared folder: this application's own or, with a name, one that others find again."""
    ensure_checkpoint_dir(spark)
    own = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{own}/{uuid.uuid4().hex}" if name is None else f"{spark.conf.get('spark.checkpoint.dir', None) or own}/{name}"


def shelve(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder as a table and read it back: compact, columnar, and lineage ends there."""
    path = path or shelf(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_shelf(spark, path: str, gone: bool = False) -> bool:
    """Whether a whole table lies there; with ``gone`` it is deleted."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
    if gone:
        files.delete(place, True)
    return found


def _joined(a: np.ndarray, b: np.ndarray, level: int, turn: int = 0) -> np.ndarray:
    """Hash of two adjoining strings from the hashes of both."""
    out = a * (MIXERS[level] if not turn else MIXERS[level] ^ U64(turn << 17))
    out += b ^ (b >> U64(29 if not turn else 31))
    out ^= out >> U64(32)
    return out


def hashes(data: np.ndarray, length: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams and of all windows of ``length`` bytes (GRAM = 32 < length <= 128); ``turn`` picks the function."""
    h = {1: (OTHER_HASH if turn else BYTE_HASH)[data]}
    for level, k in enumerate((1, 2, 4, 8, 16)):
        h[2 * k] = _joined(h[k][: len(h[k]) - k], h[k][k:], level, turn)
    n = len(data) - length + 1
    window, done = h[GRAM][:n], GRAM
    for k in (32, 32, 16, 8, 4, 2, 1):
        if done + k <= length:
            window = _joined(window, h[k][done : done + n], 5 + (k == 32), turn)
            done += k
    return h[GRAM], window


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of about CHUNK bytes; long texts are cut with an overlap, whole in windows."""
    group, total = [], 0
    for n, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            piece = t[at : at + CHUNK + length - 1]
            if group and total + len(piece) > CHUNK:
                yield group
                group, total = [], 0
            group.append((n, at, piece))
            total += len(piece)
    if group:
        yield group


def runs_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of every run: anchor hash, run hash, text number, first start, number of starts, another run hash."""
    found = []
    for group in segments(texts, length):
        data = np.frombuffer(b"".join(piece for _, _, piece in group), dtype=np.uint8)
        gram, window = hashes(data, length)
        place = np.arange(len(gram), dtype=U64)
        keys = (gram & ~U64(0xFFFFFF)) | place
        least = sliding_least(keys, length - GRAM + 1)
        sizes = np.array([len(piece) for _, _, piece in group], dtype=np.int64)
        offsets = np.cumsum(sizes) - sizes
        valid = np.zeros(len(least) + 1, dtype=np.int8)
        np.add.at(valid, offsets, 1)
        np.add.at(valid, offsets + sizes - length + 1, -1)
        valid = np.cumsum(valid[: len(least)]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        new[offsets] = True
        starts = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= new[1:] | ~valid[1:]
        count = np.flatnonzero(stop) + 1 - starts
        anchor = (least[starts] & U64(0xFFFFFF)).astype(np.int64)
        sig = mix64(gram[anchor])
        place_ = (count * 128 + anchor - starts).astype(U64)
        content = mix64(_joined(window[starts], window[starts + count - 1], 7) + place_)
        _, other = hashes(data, length, 1)
        second = mix64(_joined(other[starts], other[starts + count - 1], 7, 1) ^ place_ * MIXERS[1])
        owner = np.searchsorted(offsets, starts, side="right") - 1
        number = np.array([n for n, _, _ in group], dtype=np.int64)
        at = np.array([a for _, a, _ in group], dtype=np.int64)
        found.append((sig, content, number[owner], starts - offsets[owner] + at[owner], count, second))
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z.view(U64), z.view(U64), z, z, z, z.view(U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


ROWS = "kind byte, route long, a long, b long, k long, h long, c long"
NAMES = ["kind", "route", "a", "b", "k", "h", "c"]
#: Equal runs (anchor, both hashes) side by side, the earliest first.
SECOND_ORDER = ["route", "a", "c", "k", "h", "b"]


def _rows(kind: int, route: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, h: np.ndarray, c: np.ndarray | None = None) -> pa.RecordBatch:
    c = np.zeros(len(route), dtype=np.int64) if c is None else c
    cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (route, a, b, k, h, c)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(route), kind, dtype=np.int8)), *cols], names=NAMES)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    reach = end.copy()
    base = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1])])).astype(np.int64) << 33  # ends rise from document to document
    reach = np.maximum.accumulate(reach + base) - base
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last]


def _firsts(order_keys: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by ``same`` then ``order_keys``; returns the order and for each sorted row the place of its group's first."""
    order = np.lexsort((*reversed(order_keys), *reversed(same)))
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for x in same:
            s = x[order]
            new[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    return order, heads[np.cumsum(new) - 1]


def _first_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            k, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
            sig, content, doc, start, count, second = runs_of(texts_as_bytes(b.column("text")), length)
            order, head = _firsts((k[doc], h[doc], start), (sig, content, second))
            repeat = np.arange(len(order)) != head
            later = order[repeat]
            first = order[head[repeat]]
            equal_rows = (k[doc[later]] == k[doc[first]]) & (h[doc[later]] == h[doc[first]]) & (start[later] == start[first])
            later = later[~equal_rows]
            d, s, e = _merged(doc[later], start[later], start[later] + count[later] + length - 1)
            if len(d):
                yield _rows(SPAN, h[d] ^ k[d], s, e, k[d], h[d])
            own = order[~repeat]
            packed = start[own] << 8 | count[own]
            for at in range(0, len(own), 100_000):
                o, p = own[at : at + 100_000], packed[at : at + 100_000]
                yield _rows(RUN, sig[o], content[o], p, k[doc[o]], h[doc[o]], second[o])

    return run


def _by_route(batches: Iterator[pa.RecordBatch], work, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Feed rows sorted by route to ``work`` in blocks that hold every row of their routes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < most:
            continue
        block = pa.Table.from_batches(held)
        route = block.column("route").to_numpy()
        cut_at = int(np.searchsorted(route, route[-1], side="left"))
        if cut_at:
            yield from work(block.slice(0, cut_at))
        held = block.slice(cut_at).combine_chunks().to_batches()
        size = block.num_rows - cut_at
    if held:
        yield from work(pa.Table.from_batches(held))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches in blocks of about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _second_pass(length: int, most: int, hot: int):
    """Decide equal runs; rows come sorted by ``SECOND_ORDER``.

    Equal runs are neighbours and the earliest is first, so a block and at most ``hot`` runs of the anchor that goes on in
    the next block are held, however many rows an anchor has.
    """

    def shown(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        sig, _, _, k, h, start, count = rows
        return _rows(kind, sig, start, count, k, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros((7, 0), dtype=np.int64)  # sig, content, second, k, h, start, count of the earliest of the last run
        held, crowd = head, None  # different runs of the last anchor, or that anchor once it has more than ``hot``
        for block in _blocks(batches, most):
            kind = block.column("kind").to_numpy()
            cols = {c: block.column(c).to_numpy() for c in NAMES[1:]}
            if (spans := np.flatnonzero(kind == SPAN)).size:
                yield _rows(SPAN, *(cols[c][spans] for c in NAMES[1:]))
            sig, content, packed, k, h, second = (cols[c][kind == RUN] for c in NAMES[1:])
            rows = np.concatenate([head, np.stack([sig, content, second, k, h, packed >> 8, packed & 255])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
            heads = np.flatnonzero(new)
            first = heads[np.cumsum(new) - 1]
            later = rows[:, ~new & (rows[3:6] != rows[3:6, first]).any(axis=0)]
            if later.shape[1]:
                _, _, _, k, h, start, count = later
                yield _rows(SPAN, h ^ k, start, start + count + length - 1, k, h)
            rows, head = np.concatenate([held, rows[:, heads[head.shape[1] :]]], axis=1), rows[:, heads[-1:]]
            if not rows.shape[1]:
                continue
            sig = rows[0]
            edges = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            n = np.diff(np.append(edges, len(sig)))
            n = np.repeat(n, n)
            crowded = n > hot
            if crowd is not None:
                crowded |= sig == crowd
            goes_on = np.arange(len(sig)) >= edges[-1]
            for kind_, chosen in ((UNDECIDED, (n > 1) & ~crowded & ~goes_on), (CROWDED, crowded)):
                if chosen.any():
                    yield shown(kind_, rows[:, chosen])
            held, crowd = rows[:, goes_on & ~crowded], sig[-1] if crowded[-1] else None
        if held.shape[1] > 1:
            yield shown(UNDECIDED, held)

    return run


def _fetch(length: int):
    """Bytes of the undecided runs: (route, start, count, bytes, k, h)."""
    names = ["route", "start", "count", "bytes", "k", "h"]

    def rows(route, start, count, data, k, h) -> pa.RecordBatch:
        cols = [pa.array(np.asarray(x, dtype=np.int64)) for x in (route, start, count)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary()), pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(h, np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            windows: dict[bytes, tuple[int, int, int]] = {}
            for k, h, text, asked in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), texts_as_bytes(b.column("text")), b.column("asked"), strict=True):
                for ask in asked.as_py():
                    s, n = ask["a"], ask["b"]
                    if ask["kind"] == UNDECIDED:
                        for col, value in zip(out, (ask["route"], s, n, text[s : s + n + length - 1], k, h), strict=True):
                            col.append(value)
                        continue
                    for start in range(s, s + n):  # the earliest of each window stands for its equals in this batch
                        window = text[start : start + length]
                        old = windows.get(window)
                        if old is None:
                            windows[window] = (k, h, start)
                            continue
                        least, later = sorted((old, (k, h, start)))
                        windows[window] = least
                        if least != later:
                            for col, value in zip(out, (0, later[2], 0, b"", later[0], later[1]), strict=True):
                                col.append(value)
                    if len(windows) >= 1 << 17:
                        yield _window_rows(windows, rows)
                        windows = {}
                if len(out[0]) >= 1 << 14:
                    yield rows(*out)
                    out = ([], [], [], [], [], [])
            if windows:
                yield _window_rows(windows, rows)
            if out[0]:
                yield rows(*out)

    return run


def _window_rows(windows: dict[bytes, tuple[int, int, int]], rows) -> pa.RecordBatch:
    data = list(windows)
    own = np.array(list(windows.values()), dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)
    route = np.zeros(len(data), dtype=U64)
    for at in range(0, flat.shape[1] // 8 * 8, 8):
        route = mix64(route * MIXERS[1] + np.ascontiguousarray(flat[:, at : at + 8]).view(U64)[:, 0])
    return rows(route.view(np.int64), own[:, 2], np.ones(len(data), dtype=np.int64), data, own[:, 0], own[:, 1])


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes ``data[at:]`` within ``group`` through ``length`` bytes; (members, group) of those not alone."""
    member = np.arange(len(at))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for depth in range(0, length, 8):
        width = min(8, length - depth)
        digit = np.ascontiguousarray(words[at[member] + depth]).view(">u8")[:, 0].astype(U64) >> U64(8 * (8 - width))
        order = np.lexsort((digit, group))
        member, group, digit = member[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(member) else np.zeros(0, bool)
        group = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]]) if len(member) else new
        member, group = member[~alone], group[~alone]
    return member, group


def _last_passes(length: int):
    """Sort the windows of undecided runs; later equals become spans (start, end, k, h)."""

    def decide(route, start, count, data: list[bytes], k, h) -> pa.RecordBatch:
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        offset = np.cumsum(sizes) - sizes
        joined = np.frombuffer(b"".join(data), dtype=np.uint8)
        row = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        _, group = np.unique(route, return_inverse=True)
        member, group = radix_groups(joined, offset[row] + shift, group[row], length)
        r, s = row[member], start[row[member]] + shift[member]
        order, head = _firsts((k[r], h[r], s), (group,))
        later, first = order, order[head]
        differ = (k[r[later]] != k[r[first]]) | (h[r[later]] != h[r[first]]) | (s[later] != s[first])
        later = later[differ]
        owner, begin, end = _merged(r[later], s[later], s[later] + length)
        return pa.RecordBatch.from_arrays([pa.array(begin), pa.array(end), pa.array(k[owner]), pa.array(h[owner])], names=["a", "b", "k", "h"])

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        route, start, count, k, h = (block.column(c).to_numpy() for c in ("route", "start", "count", "k", "h"))
        data = block.column("bytes").to_pylist()
        settled = np.flatnonzero(count == 0)
        if len(settled):
            yield pa.RecordBatch.from_arrays([pa.array(start[settled]), pa.array(start[settled] + length), pa.array(k[settled]), pa.array(h[settled])], names=["a", "b", "k", "h"])
        ends = np.concatenate([np.flatnonzero(np.diff(route)) + 1, [len(route)]])
        first = 0
        weight = np.concatenate([[0], np.cumsum(count)])
        for n, e in enumerate(ends):
            if n + 1 < len(ends) and weight[ends[n + 1]] - weight[first] <= AT_ONCE:
                continue
            yield decide(*(x[first:e] for x in (route, start, count, data, k, h)))
            first = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_route(batches, work, 1 << 15)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(documents with k, h and text, spans (k, h, a, b) to remove); docs has doc_id and text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "h": F.xxhash64(text), "text": text})
    runs = keyed.where(F.octet_length("text") >= length).select("k", "h", "text").mapInArrow(_first_pass(length), ROWS)
    met = shelve(runs.repartition("route").sortWithinPartitions(*SECOND_ORDER).mapInArrow(_second_pass(length, BLOCK, HOT), ROWS))
    asked = met.where(F.col("kind") >= UNDECIDED).groupBy("k", "h").agg(F.collect_list(F.struct("kind", "route", "a", "b")).alias("asked"))
    # all columns go along and short texts do not, so that both uses of the documents read one exchange
    fetched = keyed.where(F.octet_length("text") >= length).join(asked, ["k", "h"]).mapInArrow(_fetch(length), "route long, start long, count long, bytes binary, k long, h long")
    sorted_ = fetched.repartition("route").sortWithinPartitions("route").mapInArrow(_last_passes(length), "a long, b long, k long, h long")
    spans = met.where(F.col("kind") == SPAN).select("k", "h", "a", "b").unionByName(sorted_)
    return keyed, spans


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut_out(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs with ``spans`` array<struct<a,b>>, what was cut out, and ``kept`` in place of the text: binary, or a string
    from which a character that was cut in two is dropped."""
    keyed, spans = repeated_spans(docs, length)
    of = spans.groupBy("k", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    copy = F.row_number().over(Window.partitionBy("k", "h").orderBy("k"))
    others = [c for c in docs.columns if c != "text"]
    kind = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    whole = F.octet_length("text") >= length
    long_ = keyed.where(whole).join(of, ["k", "h"], "left").withColumn("copy", copy)
    short = keyed.where(~whole).withColumns({"spans": F.lit(None).cast(kind), "copy": F.lit(1)})  # neither joined nor numbered
    wanted = [*others, "text", "spans", "copy"]
    rows = long_.select(*wanted).unionByName(short.select(*wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for b in slices(batches):
            kept, cuts = [], []
            for text, found, n in zip(texts_as_bytes(b.column("text")), b.column("spans"), b.column("copy").to_pylist(), strict=True):
                if n > 1 and len(text) >= length:
                    merged = [(0, len(text))]
                else:
                    merged = merge_spans([(s["a"], s["b"]) for s in found.as_py() or []])
                at, parts = 0, []
                for s, e in merged:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                cuts.append([{"a": s, "b": e} for s, e in merged])
            columns = [b.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(cuts, span)], names=[*others, "kept", "spans"])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", kind)])
    return rows.mapInArrow(run, schema)


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut out of the texts, and n_chars of what is left."""
    text = cut_out(docs, length, as_text=True).withColumnRenamed("kept", "text")
    sized = text.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else text
    return sized.select(*docs.columns)


def op6_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what stays of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    kept = cut_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
