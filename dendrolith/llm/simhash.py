"""SimHash near-duplicate groups, found through tables of distances to pivot fingerprints.

Every distinct fingerprint gets a row of a pivot table: its Hamming distances to 41 reference fingerprints, one base
pattern and ten variants of it in each of four 16-bit blocks. By the triangle inequality, two fingerprints within r
bits differ by r at most in every coordinate, so that a pair with a larger coordinate difference is discarded unseen;
the survivors are verified on the fingerprints.

The table also deals the pairs out. A variant differs from the base inside one block only, hence the difference of the
two coordinates depends on that block alone. Two fingerprints within 2 bits differ in two blocks at most, so they agree
on all coordinate differences of some two blocks: each of the six pairs of blocks gives a key, and pairs are looked for
inside a key only. Where a key holds more than HOT fingerprints (large families of near copies), its rows go on to keys
over quarters of the remaining bits, and once more over quarters of those. As fingerprints are distinct and up to four
values of a block share their coordinates, a key of the last level holds at most 4 x 4 x 2^8 of them. Only fingerprints
travel: the coordinates follow from them and are worked out again where pairs meet. Each task links the members of a key to the smallest of their local component
rather than writing all pairs, which keeps every component whole.

Edge cases: a null or blank text has fingerprint zero and is linked like any other. Rows with a null doc_id get a
fingerprint and the component of their group; component_id is the smallest doc_id that is not null, else null. Repeated
rows each give a row. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrolith.llm.common import U64, cut, mix64, slices, table, texts_as_bytes
from dendrolith.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
BLOCKS = 4
PIVOTS_PER_BLOCK = 10
HOT = 4096
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of one text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.array(hashes[at : at + 4096], dtype="<u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = (2 * bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h long, fp long) for every row of (doc_id, text); h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts_as_bytes(b.column("text"))], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps)], names=["doc_id", "h", "fp"])

    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    return docs.select(F.col("doc_id").cast("long"), h, "text").mapInArrow(run, "doc_id long, h long, fp long")


def pivots(seed: int = SEED) -> np.ndarray:
    """The base reference and, block by block, its variants."""
    noise = mix64(np.arange(1, 2 + BLOCKS * PIVOTS_PER_BLOCK, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    width = 64 // BLOCKS
    masks = [U64(((1 << width) - 1) << (width * b)) for b in range(BLOCKS) for _ in range(PIVOTS_PER_BLOCK)]
    return np.concatenate([noise[:1], noise[0] ^ (noise[1:] & np.array(masks, dtype=U64))])


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, as bytes."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.uint8)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    refs = pivots()
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(U64)
        rows = pivot_table(fps, refs)
        local = (rows[:, 1:].astype(np.int8) - rows[:, :1].astype(np.int8)).reshape(len(fps), BLOCKS, PIVOTS_PER_BLOCK)
        block_key = np.zeros((len(fps), BLOCKS), dtype=U64)
        for j in range(PIVOTS_PER_BLOCK):
            block_key = mix64(block_key * U64(31) + local[:, :, j].astype(np.int64).view(U64) + U64(17))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
            key = mix64(block_key[:, i] * U64(3) + mix64(block_key[:, j] + U64(n + 1))).view(np.int64)
            free = sum(((1 << 16) - 1) << (16 * q) for q in range(BLOCKS) if q not in (i, j))
            free = pa.array(np.full(len(fps), free, dtype=U64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), free, b.column("fp")], names=["key", "free", "fp"])


def _quartered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the next level: the old key and two quarters of the bits that it left free."""
    for b in batches:
        free = b.column("free").to_numpy(zero_copy_only=False).view(U64)
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(U64)
        old = b.column("key").to_numpy(zero_copy_only=False).view(U64)
        for mask in np.unique(free):
            at = np.flatnonzero(free == mask)
            bits = [p for p in range(64) if int(mask) >> p & 1]
            quarter = [sum(1 << p for p in bits[q * len(bits) // 4 : (q + 1) * len(bits) // 4]) for q in range(4)]
            for i, j in combinations(range(4), 2):
                own = U64(quarter[i] | quarter[j])
                key = mix64(old[at] + mix64((fps[at] & own) + U64(i * 4 + j + 1)))
                rest = np.full(len(at), int(mask) & ~int(own), dtype=U64)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rest.view(np.int64)), b.column("fp").take(take)], names=["key", "free", "fp"])


def local_links(fps: np.ndarray, coords: np.ndarray, radius: int = RADIUS, block: int = 512) -> np.ndarray:
    """For each fingerprint of one key, the index of the smallest member of its local component."""
    n = len(fps)
    parent = np.arange(n)
    wide = coords.astype(np.int16)
    for a in range(0, n, block):
        for c in range(a, n, block):
            far = np.zeros((min(block, n - a), min(block, n - c)), dtype=bool)
            for col in range(0, wide.shape[1], PIVOTS_PER_BLOCK // 2):  # a few coordinates discard nearly all
                far |= np.abs(wide[a : a + block, col][:, None] - wide[c : c + block, col][None, :]) > radius
            x, y = np.nonzero(~far)
            x, y = x + a, y + c
            keep = x < y
            x, y = x[keep], y[keep]
            keep = np.abs(wide[x] - wide[y]).max(axis=1, initial=0) <= radius
            x, y = x[keep], y[keep]
            keep = np.bitwise_count(fps[x] ^ fps[y]) <= radius
            parent = _merged(parent, x[keep], y[keep])
    return parent


def _merged(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest-member labels after the links x-y join the components in ``parent``."""
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        if np.array_equal(low, high):
            return parent
        np.minimum.at(parent, high, low)
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links (src, dst) inside each key."""

    refs = pivots()

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        src, dst = [], []
        coords = pivot_table(fps, refs)
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if e - s == 2:  # most keys
                if np.abs(coords[s].astype(np.int16) - coords[s + 1]).max() <= RADIUS and int(fps[s] ^ fps[s + 1]).bit_count() <= RADIUS:
                    src.append(fps[s : s + 1])
                    dst.append(fps[s + 1 : e])
            elif e - s > 2:
                to = local_links(fps[s:e], coords[s:e])
                moved = np.flatnonzero(to != np.arange(e - s))
                src.append(fps[s:e][moved])
                dst.append(fps[s:e][to[moved]])
        join = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, U64)).view(np.int64))
        return pa.RecordBatch.from_arrays([join(src), join(dst)], names=["src", "dst"])

    held: tuple[np.ndarray, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key").to_numpy(zero_copy_only=False)
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(U64)
        if held:
            keys, fps = (np.concatenate(x) for x in zip(held, (keys, fps), strict=True))
        last = int(np.searchsorted(keys, keys[-1], side="left"))  # rows of one task come in key order
        if last:
            yield links(keys[:last], fps[:last])
        held = keys[last:], fps[last:]
    if held:
        yield links(*held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (fp long) whose components are those of all pairs within RADIUS."""
    schema = "key long, free long, fp long"
    rows = distinct.select("fp").mapInArrow(_keyed, schema)
    found = None
    for level in range(3):
        rows = cut(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, "key")
        last = level == 2
        part = sized if last else sized.where(F.col("n") <= HOT)
        links = cut(part.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "src long, dst long").distinct())
        found = links if found is None else found.union(links)
        if last:
            break
        hot = sized.where(F.col("n") > HOT).select("key", "free", "fp")
        if hot.isEmpty():
            break
        rows = hot.mapInArrow(_quartered, schema)
    return found


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to (doc_id, h, fp long, component long, component_id long)."""
    printed = cut(fingerprints(docs))
    distinct = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    component = connected_components(near_links(distinct))
    linked = distinct.join(component, distinct["fp"] == component["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.join(smallest, "component").select("fp", "component", "component_id")
    return printed.join(cut(of), "fp").select("doc_id", "h", "fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group: the smallest doc_id (null last), then the smallest hash of the text."""
    return one_of_each(docs, near_duplicate_groups(docs.select("doc_id", "text")))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each component of groups (doc_id, h, component): the smallest doc_id (null last), then the smallest hash of the text."""
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    kept = best.select(F.coalesce("best.doc_id", F.lit(0)).alias("_k"), F.col("best.none").alias("_none"), F.col("best.h").alias("_h"))
    keyed = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    copy = F.row_number().over(Window.partitionBy("_k", "_none", "_h").orderBy("_k"))  # wholly equal rows meet here
    return keyed.join(kept, ["_k", "_none", "_h"]).withColumn("_copy", copy).where("_copy = 1").select(*docs.columns)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
