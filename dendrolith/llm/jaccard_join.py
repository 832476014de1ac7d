"""Exact Jaccard join of documents on word shingles, by prefixes of token combinations.

A token is the 64-bit hash of a shingle, a document's set its distinct tokens; equal sets are one node. Two sets of sizes x
and y at a similarity s share t = ceil(s x) tokens of x at least, so x misses x - t of its own tokens at most. In any order
of all tokens, the first tokens of x up to x - t + 1 units hold a signature that y has in its own prefix too. Tokens are
ordered by the number of sets that hold them, and a unit depends on the token's class:

- a rare token (in RARE sets at most) is a signature by itself and a unit;
- frequent tokens are dealt into cells by their hash; in a cell whose signatures are combinations of k tokens (two, beyond
  COMMON sets three), the prefix is extended by k - 1 tokens that count for nothing, and each further one is a unit: a set
  that lost fewer tokens than the prefix has units still shares k tokens of some cell. The number of cells grows with the
  size of the set, so that a cell has a few tokens and combinations stay linear. It depends on a bucket of sizes; a set
  is signed for its own bucket and the next, as similar sets are at most one apart. Small sets use single tokens only.

Counting every token of a corpus is not needed. A quarter of the tokens, chosen by hash (all tokens of small sets), are
counted first; a set with over x - t of them in no other set has no partner and goes. The rest are counted whole, tokens of
one set only are taken out (they count in the prefix, but nobody shares them), and the test is made again.

Sets that share a signature meet in families, the components of (set, least set of a signature). A family of MOST sets
at most is verified in one task on whole sets; sets that are in one component by then are not compared again. A larger one
first compares all members with a few of them, drawn anew in each of ROUNDS rounds, each block of members in a task of its
own; then the members outside its largest component are compared with all others, dealt out in pairs of blocks. No pair
goes unverified unless both are in one component already, and no link is lost. Where a large family holds many sets that
are alike but do not link, the last step grows with the square of the number of members outside the largest component.

Tokens and nodes are 64-bit hashes: two different ones of n are taken for one with probability n^2 / 2^65.

Edge cases: fewer words than a shingle are one token; null and blank texts have an empty set, link with nothing and are
their own component. Rows with a null doc_id belong to components like any other; component_id is the smallest doc_id that
is not null, else null. Repeated rows each give a row; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import U64, cut, mix64, slices, table, texts_as_bytes
from dendrolith.llm.components import connected_components
from dendrolith.llm.simhash_wide import groups, shingle_sets

SHINGLE = 4
#: Jaccard similarity in hundredths.
SIMILARITY = 85
#: Sets that hold a token of the first and second class at most.
RARE, COMMON = 8, 128
#: Sets of up to so many tokens send all of them to be counted, and use single tokens as signatures.
SMALL, SINGLE = 64, 40
#: Other sets send the tokens whose mixed hash, of 64 bits, is below this.
QUARTER = 1 << 62
#: Of the bitmap that thins out the texts to read again; its size does not follow the corpus.
BITS = 1 << 24
#: Of a prefix's frequent tokens, about as many fall into a cell.
PER_CELL = 4
#: Members of a family, and tokens of them, that one task compares.
MOST, MOST_TOKENS = 2048, 1 << 22
ROUNDS, DRAWN = 2, 32


def at_least(size: Column | int, similarity: int) -> Column | int:
    """Tokens that a set of this size shares at least with any partner."""
    return -((-size * similarity) // 100) if isinstance(size, int) else F.ceil(size * similarity / 100).cast("long")


def first_look(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """A row per document with the tokens, mixed, that have to be counted first.

    ``wanted`` tokens count for this set: all of a set of SMALL tokens, whose partners offer all of theirs, else a quarter.
    ``offered`` ones only count for others. A token that two sets of one batch hold is known to be shared: it leaves both
    lists and goes, once for the batch, into ``told``, so that a very common token sends a row per batch, not per holder.
    ``missing`` is the number of wanted tokens; equal sets of a batch are one, the others have ``counted`` 0."""
    all_of = SMALL * 100 // similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            sets = shingle_sets(texts_as_bytes(b.column("text")), shingle)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), len(s)) for s in sets], dtype=U64)
            counted = np.zeros(len(sets), dtype=bool)
            counted[np.unique(nodes, return_index=True)[1]] = True
            held = np.where(counted, sizes, 0)
            tokens = mix64(np.concatenate([*(s for s, c in zip(sets, counted, strict=True) if c), np.zeros(0, U64)]))
            owner = np.repeat(np.arange(len(sets)), held)
            few = tokens < U64(QUARTER)
            used = few | (sizes[owner] <= all_of)
            tokens, owner, few = tokens[used], owner[used], few[used]
            wants = few | (sizes[owner] <= SMALL)
            order = np.argsort(tokens, kind="stable")
            starts = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order][:1] + U64(1)) != 0) if len(order) else order
            many = np.diff(np.append(starts, len(order))) > 1
            shared = np.zeros(len(order), dtype=bool)
            shared[order] = np.repeat(many, np.diff(np.append(starts, len(order))))
            missing = np.bincount(owner[wants & ~shared], minlength=len(sets))
            told = tokens[order][starts[many]]

            def lists(chosen: np.ndarray) -> pa.Array:
                ends = np.append(0, np.cumsum(np.bincount(owner[chosen], minlength=len(sets)))).astype(np.int32)  # noqa: B023
                return pa.ListArray.from_arrays(ends, pa.array(tokens[chosen].view(np.int64)))  # noqa: B023

            first = pa.ListArray.from_arrays(np.append(0, np.full(len(sets), len(told))).astype(np.int32), pa.array(told.view(np.int64)))
            columns = [b.column("doc_id"), b.column("h"), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(counted.astype(np.int64)), pa.array(missing), lists(wants & ~shared), lists(~wants & ~shared), first]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "size", "counted", "missing", "wanted", "offered", "told"])

    return named(docs).mapInArrow(run, "doc_id long, h long, node long, size long, counted long, missing long, wanted array<long>, offered array<long>, told array<long>")


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


OFFERED, WANTED, TOLD = 0, 1, 2


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token to how many wanted tokens of a node other sets hold too."""
    for block in groups(batches, 1 << 16):
        keys, nodes, flags = (block.column(c).to_numpy() for c in ("key", "node", "flag"))
        starts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
        shared = (np.minimum.reduceat(nodes, starts) != np.maximum.reduceat(nodes, starts)) | (np.maximum.reduceat(flags, starts) == TOLD)
        good = np.repeat(shared, np.diff(np.append(starts, len(keys)))) & (flags == WANTED)
        found, n = np.unique(nodes[good], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["node", "n"])


def possible(looked: DataFrame, similarity: int) -> DataFrame:
    """(node, size, doc_id, h) of the sets that may have a partner, each with one of its rows."""
    rows = None
    for flag, column in ((OFFERED, "offered"), (WANTED, "wanted"), (TOLD, "told")):
        own = looked.select(F.explode(column).alias("key"), "node", F.lit(flag).alias("flag"))
        rows = own if rows is None else rows.union(own)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_credits, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    sums = [F.first("size").alias("size"), F.sum("missing").alias("missing"), F.sum("counted").alias("counted"), F.min(F.struct("doc_id", "h")).alias("one")]
    nodes = looked.where("size > 0").groupBy("node").agg(*sums)
    missed = F.col("missing") - F.coalesce("n", F.lit(0))
    kept = nodes.join(found, "node", "left").where(missed <= (F.col("size") - at_least(F.col("size"), similarity)) * F.col("counted"))
    return kept.select("node", "size", "one.doc_id", "one.h")


def thinned(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``docs`` (doc_id, h, text) without most rows that ``nodes`` does not name, by a bitmap of BITS bits, whatever the corpus."""
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "h"), F.lit(BITS)) + 1
    maps = nodes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in maps:
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    marks = nodes.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = marks.value
        for b in batches:
            at = b.column("p").to_numpy() - 1
            good = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield b.select(["doc_id", "h", "text"]).filter(pa.array(good))

    return named(docs).withColumn("p", place).mapInArrow(run, "doc_id long, h long, text string")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            sets = shingle_sets(texts_as_bytes(b.column("text")), shingle)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            packed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), packed], names=["node", "tokens"])

    return run


def ordered_sets(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """(node, size, tokens, holders): the tokens that other sets hold too, in the global order, with how many sets hold them."""
    asked = nodes.select("node", F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    texts = thinned(docs, nodes).join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("node", "text")
    tokens = cut(texts.mapInArrow(_sets(shingle), "node long, tokens array<long>")).select("node", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")  # a repeated row only makes the test weaker
    found = tokens.select("node", "token").join(counts.hint("merge"), "token").groupBy("node").agg(F.collect_set(F.struct("n", "token")).alias("found")).join(nodes.select("node", "size"), "node")
    kept = found.where(F.size("found") >= at_least(F.col("size"), similarity)).select("node", "size", F.array_sort("found").alias("found"))
    return kept.select("node", "size", F.col("found.token").alias("tokens"), F.col("found.n").alias("holders"))


def buckets(size: int, similarity: int) -> tuple[int, int, int]:
    """The bucket of a size and the least sizes of the one before and of its own; similar sizes are one bucket apart at most."""
    before, low, k = 1, 1, 0
    while low * 100 // similarity < size:
        before, low, k = low, low * 100 // similarity + 1, k + 1
    return k, before, low


def signatures(size: int, tokens: np.ndarray, holders: np.ndarray, similarity: int) -> np.ndarray:
    """Hashes of the single tokens and token combinations of one set's prefix."""
    need = size - at_least(size, similarity) + 1 - (size - len(tokens))
    rare = int(np.searchsorted(holders, RARE, side="right"))
    order, values = tokens.view(U64), []
    for least in buckets(size, similarity)[1:]:  # the smallest set that this one meets in its own bucket, and in the next
        cells = max(1, round(least * (100 - similarity) / 100 / (PER_CELL - 1)))
        singles = len(order) if least < SINGLE else rare
        values.append(mix64(order[: min(need, singles)]))
        units, at, held = min(need, singles), singles, {}
        hashed = mix64(order + U64(0x51ED))
        while units < need and at < len(order):
            k = 2 if holders[at] <= COMMON else 3
            cell = held.setdefault((k, int(hashed[at] % U64(cells))), [])
            cell.append(at)
            units += len(cell) >= k
            at += 1
        for (k, _), members in held.items():
            if len(members) < k:
                continue
            chosen = np.array(list(combinations(members, k)))
            h = np.full(len(chosen), cells * 4 + k, dtype=U64)
            for j in range(k):
                h = mix64(h * U64(0x9E3779B97F4A7C15) + order[chosen[:, j]])
            values.append(h)
    return np.unique(np.concatenate(values)).view(np.int64)


def _signed(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [signatures(s, np.array(t, dtype=np.int64), np.array(n), similarity) for s, t, n in zip(*(b.column(c).to_pylist() for c in ("size", "tokens", "holders")), strict=True)]
            nodes = np.repeat(b.column("node").to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), pa.array(nodes)], names=["key", "node"])

    return run


def families(sets: DataFrame, similarity: int) -> DataFrame:
    """(node, family) of the sets that share a signature with another one."""
    signed = sets.mapInArrow(_signed(similarity), "key long, node long")
    least = signed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    links = signed.join(least.hint("merge"), "key").where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct()
    return connected_components(cut(links)).select("node", F.col("component").alias("family"))


LEFT, RIGHT, BOTH = 0, 1, 2


def compared(sides: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Links between left and right members, or among those on both sides, that join parts; parts are joined on the way."""
    sizes, parts, out = sizes.astype(np.int64), np.unique(parts, return_inverse=True)[1], []
    ids = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum([0, *map(len, sets)])
    flag = np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool)
    right, both = np.flatnonzero(sides == RIGHT), np.flatnonzero(sides == BOTH)
    for x in np.flatnonzero(sides != RIGHT).tolist():
        y = right if sides[x] == LEFT else both[both > x]
        y = y[parts[y] != parts[x]]
        y = y[100 * np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x])]
        if not len(y):
            continue
        mine = ids[ends[x] : ends[x + 1]]
        flag[mine] = True
        if 8 * len(y) < len(sets):
            shared = np.array([int(np.count_nonzero(flag[ids[ends[k] : ends[k + 1]]])) for k in y])
        else:
            shared = np.add.reduceat(np.append(flag[ids], False).astype(np.int32), ends[:-1])[y]
        flag[mine] = False
        for k in y[100 * shared >= similarity * (sizes[x] + sizes[y] - shared)].tolist():
            if parts[k] != parts[x]:
                out.append((x, k))
                parts[parts == parts[k]] = parts[x]
    return out


ROWS = "key long, side int, part long, node long, size long, tokens array<long>"


def _verified(similarity: int):
    """Rows sorted by key, the cell of a comparison, to links between nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 1 << 12):
            keys, sides, parts, node, sizes = (block.column(c).to_numpy() for c in ("key", "side", "part", "node", "size"))
            tokens = block.column("tokens").combine_chunks()
            tokens = pa.concat_arrays(tokens.chunks) if isinstance(tokens, pa.ChunkedArray) else tokens
            at, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
            src, dst = [], []
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s > 1:
                    links = compared(sides[s:e], parts[s:e], sizes[s:e], [values[at[k] : at[k + 1]] for k in range(s, e)], similarity)
                    src += [node[s + x] for x, _ in links]
                    dst += [node[s + y] for _, y in links]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def verified(cells: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """cells (key, side, part, node) with the whole sets of their members to (src, dst)."""
    rows = cells.join(sets.select("node", "size", "tokens"), "node").select("key", "side", "part", "node", "size", "tokens")
    return cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(similarity), "src long, dst long"))


def numbers_to(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def links_of(members: DataFrame, sets: DataFrame, similarity: int, most: int = MOST, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """members (node, family) to verified links whose components are those of all similar pairs inside a family."""
    sized = cut(members.join(sets.select("node", F.size("tokens").alias("m")), "node"))
    totals = sized.groupBy("family").agg(F.count("*").alias("n"), F.sum("m").alias("total"))
    rows = sized.join(totals, "family")
    large = (F.col("n") > most) | (F.col("total") > most_tokens)
    found = verified(rows.where(~large).select(F.col("family").alias("key"), F.lit(BOTH).alias("side"), F.col("node").alias("part"), "node"), sets, similarity)
    rows = cut(rows.where(large).select("family", "node", "n", "total"))
    if rows.isEmpty():
        return found
    blocks = F.greatest(F.ceil(2 * F.col("n") / most), F.ceil(2 * F.col("total") / most_tokens)).cast("long")
    now = rows.withColumns({"part": F.col("node"), "blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks)})
    for r in range(ROUNDS):
        drawn = now.where(F.pmod(F.xxhash64("node", F.lit(r)), F.col("n")) < DRAWN).withColumn("block", numbers_to("blocks"))
        ahead = [F.xxhash64("family", F.lit(r), "block").alias("key"), F.lit(LEFT).alias("side"), "part", "node"]
        cells = now.select(*ahead).union(drawn.select(ahead[0], F.lit(RIGHT).alias("side"), "part", "node"))
        found = found.union(verified(cells, sets, similarity))
        now = labelled(now.drop("part"), connected_components(found))
    now = cut(now)
    parts = now.groupBy("family", "part").agg(F.count("*").alias("members"))
    main = parts.groupBy("family").agg(F.max(F.struct("members", "part")).alias("main")).select("family", F.col("main.part").alias("main"))
    now = now.join(main, "family")
    rest, core = now.where("part <> main"), now.where("part = main").join(now.where("part <> main").select("family").distinct(), "family", "left_semi")
    pair = rest.withColumn("other", numbers_to("blocks"))
    among = pair.select(F.xxhash64("family", F.lit("among"), F.least("block", "other"), F.greatest("block", "other")).alias("key"), "block", "other", "part", "node")
    side = F.when(F.col("block") == F.col("other"), BOTH).when(F.col("block") < F.col("other"), LEFT).otherwise(RIGHT)
    beside = pair.select(F.xxhash64("family", F.lit("beside"), "block", "other").alias("key"), F.lit(LEFT).alias("side"), "part", "node")
    facing = core.withColumn("other", numbers_to("blocks")).join(rest.select("family", F.col("block").alias("other")).distinct(), ["family", "other"], "left_semi")
    facing = facing.select(F.xxhash64("family", F.lit("beside"), "other", "block").alias("key"), F.lit(RIGHT).alias("side"), "part", "node")
    cells = among.select("key", side.alias("side"), "part", "node").union(beside).union(facing)
    return found.union(verified(cells, sets, similarity))


def labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with the component that the links so far put them in."""
    return members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, most: int = MOST, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, text) rows to (doc_id, h, n_shingles, component_id)."""
    looked = cut(first_look(docs, shingle, similarity))
    rows = looked.select("doc_id", "h", "node", "size")
    sets = cut(ordered_sets(docs, cut(possible(looked, similarity)), shingle, similarity))
    links = links_of(cut(families(sets, similarity)), sets, similarity, most, most_tokens)
    nodes = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(connected_components(links), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(placed.join(least, "component").select("node", "component_id"))
    found = rows.where("size > 0").join(of.hint("merge"), "node").select("doc_id", "h", F.col("size").alias("n_shingles"), "component_id")
    return found.union(rows.where("size = 0").select("doc_id", "h", "size", F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
