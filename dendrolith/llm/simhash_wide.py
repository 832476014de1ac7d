"""SimHash groups at a similarity: documents whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

The wide form of the SimHash operator. Two bits of 64 link almost equal texts only: at a similarity of 0.8, a bit of two
fingerprints differs with probability acos(8/9) / pi = 0.1515, which makes 39 +- 6 of 256 bits. Equal sequences of words
are one node; every node gets a 256-bit SimHash of its distinct shingles, and two nodes are candidates within RADIUS (64)
bits, over four standard deviations more than the similarity needs; where the smaller set has under SMALL shingles, whose
bits vary more, within RADIUS_SMALL.

At such a radius no choice of blocks of the fingerprint deals pairs out, as unrelated texts agree in every short block.
Pairs are dealt out by anchors instead: the shingles of a node that are least under each of ANCHORS hash functions. Two
nodes at 0.8 share no anchor with probability 0.2^12 = 4e-9. Inside an anchor, the members' distances to reference
fingerprints make a pivot table: references are members chosen farthest first, a pair whose coordinates differ by more
than its radius anywhere is discarded unseen, and the rest are verified on their fingerprints. A pair is looked at under
the first anchor that it shares only. What survives is verified on the whole shingle sets, so that a link is exact.

An anchor with over MOST_MEMBERS nodes or MOST_SHINGLES shingles (a passage that many texts hold) goes on to keys of two
shared anchors, then of three (pairs at 0.8 share fewer with probability 2e-7 and 5e-6); a family that is still larger
is dealt out in cells, a pair of hashed blocks each, so that no task holds it whole. A task links members in turn, skips
pairs that are in one component already and returns a spanning set of links, never all pairs.

Shingles and nodes are 64-bit hashes: two different ones of n are taken for one with probability n^2 / 2^65.

Edge cases: a text of at most SHINGLE words is one shingle; null and blank texts are one node, like no other. Rows with a
null doc_id belong to groups like any other. Repeated rows each give a row; extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.llm.backoff import word_hashes
from dendrolith.llm.common import U64, cut, mix64, slices, texts_as_bytes
from dendrolith.llm.components import connected_components

SHINGLE = 5
#: Jaccard similarity in hundredths.
SIMILARITY = 80
#: 64-bit words of a fingerprint.
WIDTH = 4
RADIUS, RADIUS_SMALL, SMALL = 64, 84, 32
ANCHORS = 12
MOST_MEMBERS, MOST_SHINGLES = 4096, 1 << 22
LEVELS = 3
PIVOTS = 8
SEED = 42

ODD = mix64(np.arange(1, ANCHORS + 1, dtype=U64) + U64(SEED)) | U64(1)
SALT = mix64(np.arange(101, 101 + WIDTH, dtype=U64) + U64(SEED))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of the word shingles of each text; none for a blank text."""
    words, counts = word_hashes([t.lower() for t in texts])
    out = []
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        own = words[end - n : end]
        size = min(n, shingle)
        h = np.full(max(n - size + 1, 0) if n else 0, SEED + size, dtype=U64)
        for k in range(size):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + own[k : k + len(h)])
        out.append(np.unique(h))
    return out


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set in WIDTH words: a bit is set if it is in over half of the shingles' hashes."""
    votes = np.zeros(64 * WIDTH, dtype=np.int64)
    for at in range(0, len(found), 255):
        block = found[at : at + 255]
        bits = np.unpackbits(mix64(block[:, None] ^ SALT).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(found), bitorder="little").view(U64)


def anchors(found: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each hash function."""
    if not len(found):
        return ODD.copy()
    least = np.full(ANCHORS, np.iinfo(U64).max)
    for at in range(0, len(found), 4096):
        block = found[at : at + 4096]
        block = block ^ (block >> U64(32))
        least = np.minimum(least, np.multiply.outer(ODD, block).min(axis=1))
    return least


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, node, size, print, anchors) for every row of (doc_id, text); h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts = texts_as_bytes(b.column("text"))
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts], dtype=U64)
            sets = shingle_sets(texts, shingle)
            prints = [wide_fingerprint(s).tobytes() for s in sets]
            keys = np.array([anchors(s) for s in sets], dtype=U64).reshape(-1)
            keys = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * ANCHORS, pa.array(keys.view(np.int64)))
            columns = [b.column("doc_id"), b.column("h"), pa.array(nodes.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "size", "print", "anchors"])

    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    return docs.select(F.col("doc_id").cast("long"), h, "text").mapInArrow(run, "doc_id long, h long, node long, size long, print binary, anchors array<long>")


def dealt(nodes: DataFrame, most: int = MOST_MEMBERS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(key, used, node, size, print, anchors): the nodes that share an anchor, or as many as it takes; used marks which."""
    rows = nodes.select("node", "size", F.posexplode("anchors").alias("last", "anchor"))
    rows = rows.select("node", "size", "last", F.expr("shiftleft(1, last)").alias("used"), F.xxhash64("last", "anchor").alias("key"))
    found = None
    for level in range(LEVELS):
        stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
        sized = cut(rows.join(stats, "key"))
        fits = (F.col("n") <= most) & (F.col("total") <= most_shingles)
        part = sized.where(fits).select("key", "used", "node")
        hot = sized.where(~fits)
        if level == LEVELS - 1:
            blocks = F.greatest(F.ceil(2 * F.col("n") / most), F.ceil(2 * F.col("total") / most_shingles))
            cells = hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
            cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            cells = cells.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "used", "node")
            part = part.union(cells)
        found = part if found is None else found.union(part)
        if level == LEVELS - 1 or hot.isEmpty():
            break
        more = hot.join(nodes.select("node", "anchors"), "node").select("node", "size", "last", "used", "key", F.posexplode("anchors").alias("next", "anchor")).where("next > last")
        rows = more.select("node", "size", F.col("next").alias("last"), F.expr("used + shiftleft(1, next)").alias("used"), F.xxhash64("key", "next", "anchor").alias("key"))
    return found.join(nodes.select("node", "size", "print", "anchors"), "node").select("key", "used", "node", "size", "print", "anchors")


class Members:
    """The nodes of one key: pivot table, fingerprints and which pairs are to be looked at here."""

    def __init__(self, used: int, sizes: np.ndarray, prints: np.ndarray, own: np.ndarray):
        self.used, self.sizes, self.prints, self.own = used, sizes, prints, own
        self.radius = np.where(sizes < SMALL, RADIUS_SMALL, RADIUS)
        self.first = (used & -used).bit_length() - 1
        self.upto = used.bit_length()
        self.coords = self.pivot_table() if len(sizes) > 4 * PIVOTS else None

    def distances(self, x: int, others: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bitwise_count(self.prints[others] ^ self.prints[x]).sum(axis=1, dtype=np.int16)

    def pivot_table(self) -> np.ndarray:
        """Distances to references, each the member that is farthest from those before."""
        rows, x = [], 0
        nearest = np.full(len(self.sizes), np.iinfo(np.int16).max, dtype=np.int16)
        for _ in range(PIVOTS):
            rows.append(self.distances(x))
            nearest = np.minimum(nearest, rows[-1])
            x = int(nearest.argmax())
        return np.stack(rows, axis=1)

    def candidates(self, x: int) -> np.ndarray:
        """Members after ``x`` within its radius, under the first anchors that the pair shares."""
        y = np.arange(x + 1, len(self.sizes))
        low, high = np.minimum(self.sizes[y], self.sizes[x]), np.maximum(self.sizes[y], self.sizes[x])
        y = y[100 * low >= SIMILARITY * high]
        if self.coords is not None and len(y):
            y = y[np.abs(self.coords[y] - self.coords[x]).max(axis=1) <= np.maximum(self.radius[y], self.radius[x])]
        if len(y):
            y = y[self.distances(x, y) <= np.maximum(self.radius[y], self.radius[x])]
        if len(y):
            shared = ((self.own[y, : self.upto] == self.own[x, : self.upto]) << np.arange(self.upto)).sum(axis=1)
            y = y[shared == self.used]
        return y


def groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that hold every row of their keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < most and sum(x.nbytes for x in held) < 1 << 26:
            continue
        block = pa.Table.from_batches(held)
        keys = block.column("key").to_numpy()
        at = int(np.searchsorted(keys, keys[-1], side="left"))
        if at:
            yield block.slice(0, at)
        held = block.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def keyed_members(block: pa.Table) -> Iterator[tuple[int, int, Members]]:
    """Of every key: start, end and members."""
    keys, used, sizes = (block.column(c).to_numpy() for c in ("key", "used", "size"))
    prints = np.frombuffer(b"".join(block.column("print").to_pylist()), dtype=U64).reshape(-1, WIDTH)
    own = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in block.column("anchors").chunks]).reshape(-1, ANCHORS)
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    for s, e in zip(edges, edges[1:], strict=False):
        if e - s > 1:
            yield s, e, Members(int(used[s]), sizes[s:e], prints[s:e], own[s:e])


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a candidate inside their key."""
    for block in groups(batches):
        keep = np.zeros(block.num_rows, dtype=bool)
        for s, e, members in keyed_members(block):
            for x in range(e - s - 1):
                y = members.candidates(x)
                if len(y):
                    keep[s + x] = True
                    keep[s + y] = True
        yield from block.filter(pa.array(keep)).combine_chunks().to_batches()


def spanning_links(members: Members, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members whose whole sets are similar enough; pairs that are in one component by then are left out."""
    n, out = len(sets), []
    parent = np.arange(n)
    ids = starts = None
    for x in range(n - 1):
        y = members.candidates(x)
        y = y[parent[y] != parent[x]]
        if not len(y):
            continue
        if len(y) < 16:
            shared = np.array([len(np.intersect1d(sets[x], sets[k], assume_unique=True)) for k in y])
        else:
            if ids is None:  # shingles as small numbers, once for the key
                flat = np.concatenate(sets)
                ids = np.unique(flat, return_inverse=True)[1].astype(np.int32)
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flag = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
            mine = ids[starts[x] : starts[x + 1]]
            flag[mine] = True
            shared = np.array([int(np.count_nonzero(flag[ids[starts[k] : starts[k + 1]]])) for k in y])
            flag[mine] = False
        alike = y[100 * shared >= SIMILARITY * (len(sets[x]) + members.sizes[y] - shared)]
        for k in alike.tolist():
            if parent[k] != parent[x]:
                out.append((x, k))
                low, high = sorted((int(parent[x]), int(parent[k])))
                parent[parent == high] = low
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in groups(batches, 1 << 12):
        node = block.column("node").to_numpy()
        packed = block.column("shingles").to_pylist()
        src, dst = [], []
        for s, e, members in keyed_members(block):
            sets = [np.frombuffer(p, dtype="<u8") for p in packed[s:e]]
            for x, y in spanning_links(members, sets):
                src.append(node[s + x])
                dst.append(node[s + y])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts_as_bytes(b.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


ROWS = "key long, used int, node long, size long, print binary, anchors array<long>"


def links(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_MEMBERS) -> DataFrame:
    """nodes (node, size, print, anchors, doc_id, h), docs (doc_id, h, text) to verified links (src, dst)."""
    alive = cut(dealt(nodes, most).repartition("key").sortWithinPartitions("key").mapInArrow(_alive, ROWS))
    asked = nodes.join(alive.select("node").distinct(), "node").select("node", F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    held = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("node", "text")
    sets = cut(held.mapInArrow(_sets(shingle), "node long, shingles binary").dropDuplicates(["node"]))
    whole = alive.join(sets, "node").select("key", "used", "node", "size", "print", "anchors", "shingles")
    return cut(whole.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "src long, dst long").distinct())


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_MEMBERS) -> DataFrame:
    """(doc_id, text) rows to (doc_id, h, component): the documents of one component are linked by similar pairs."""
    signed = cut(signatures(docs, shingle))
    one = F.min(F.struct("doc_id", "h")).alias("one")
    first = [F.first(c).alias(c) for c in ("size", "print", "anchors")]
    nodes = cut(signed.groupBy("node").agg(one, *first).select("node", "size", "print", "anchors", "one.doc_id", "one.h"))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    parts = connected_components(links(nodes, texts, shingle, most))
    return signed.select("doc_id", "h", "node").join(parts, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("component"))
