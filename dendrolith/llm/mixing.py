"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). In the network, each
pattern offers its words once, twice and three times at convex costs, a pattern feeds the quotas of its sources, and each
quota holds its source's target; the cheapest maximal flow tells how often each pattern's words are used and where they
go. Whole rounds of a pattern take every document of it; the last, partial round takes documents in a seeded order up to
the words that remain. The cut-off of that order is found by three rounds of 4,096-bucket histograms, so that no source
is ever sorted or collected in one task. A document in several sources counts against one quota, drawn from its own
values by the shares in which the flow sends its pattern's words to them.

The driver holds one row per pattern, MOST_PATTERNS at most (more stop the query with an error), and solves patterns that
share no source apart from each other, so that sources without overlap take linear time.

Rows that agree in doc_id and text are told apart by a global row number among all such rows, which a range sort deals
out evenly; as they are equal, it does not matter which of them is taken. All other rows' places follow from their own
values alone.

Edge cases: null is a source of its own, the last in order; a null or blank text has size 0 and nothing is taken from
it; sources without words get target 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrolith.llm.common import cut, n_words, number_rows, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
COSTS = (1, 4, 16)
SEED = 7
#: Rows up to which a counted table is sent to all tasks.
MOST_BROADCAST = 10_000
#: Membership patterns that the driver takes.
MOST_PATTERNS = 1_000_000
DIGITS, DIGIT_BITS = 3, 12


def capped_shares(sizes: list[int], weights: list[float], most: int = MOST_COPIES) -> list[float]:
    """Shares of the total by weight; a share over ``most`` times its size stops there and the excess is shared anew."""
    total, share, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        for i in open_:
            share[i] = total * weights[i] / weight
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            break
        for i in over:
            share[i] = float(most * sizes[i])
            total -= share[i]
            open_.discard(i)
    return share


class FlowNetwork:
    """Integer capacities and costs; successive cheapest paths."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = []  # head, room, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, tail: int, head: int, room: int, cost: int = 0) -> int:
        self.out[tail].append(len(self.arcs))
        self.arcs.append([head, room, cost])
        self.out[head].append(len(self.arcs))
        self.arcs.append([tail, 0, -cost])
        return len(self.arcs) - 2

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, source: int, sink: int) -> None:
        while True:
            dist: list[float] = [float("inf")] * len(self.out)
            via, waits = [-1] * len(self.out), [False] * len(self.out)
            dist[source], queue = 0, deque([source])
            while queue:
                u = queue.popleft()
                waits[u] = False
                for a in self.out[u]:
                    head, room, cost = self.arcs[a]
                    if room > 0 and dist[u] + cost < dist[head]:
                        dist[head], via[head] = dist[u] + cost, a
                        if not waits[head]:
                            waits[head] = True
                            queue.append(head)
            if via[sink] < 0:
                return
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.arcs[via[v] ^ 1][0]
            room = min(self.arcs[a][1] for a in path)
            for a in path:
                self.arcs[a][1] -= room
                self.arcs[a ^ 1][1] += room


def _solved(patterns: list[tuple[tuple[int, ...], int]], targets: dict[int, float], costs: tuple[int, ...]) -> list[list[int]]:
    """The flow of patterns that are linked by their sources."""
    place = {q: 2 + len(patterns) + n for n, q in enumerate(targets)}
    net = FlowNetwork(2 + len(patterns) + len(targets))
    source, sink = 0, 1
    for q, t in targets.items():
        net.arc(place[q], sink, round(t))
    feeds = []
    for p, (members, size) in enumerate(patterns):
        for cost in costs:
            net.arc(source, 2 + p, size, cost)
        feeds.append([net.arc(2 + p, place[q], len(costs) * size) for q in members])
    net.solve(source, sink)
    return [[net.used(a) for a in arcs] for arcs in feeds]


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], costs: tuple[int, ...] = COSTS) -> list[list[int]]:
    """Words that each pattern (members, size) sends to each of its members, in the members' order."""
    parent = list(range(len(targets)))

    def root(q: int) -> int:
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        return q

    for members, _ in patterns:
        for q in members[1:]:
            low, high = sorted((root(members[0]), root(q)))
            parent[high] = low
    linked: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        linked.setdefault(root(members[0]) if members else -1, []).append(p)
    out: list[list[int]] = [[] for _ in patterns]
    for own in linked.values():
        sources = dict.fromkeys(q for p in own for q in patterns[p][0])
        for p, feed in zip(own, _solved([patterns[p] for p in own], {q: targets[q] for q in sources}, costs), strict=True):
            out[p] = feed
    return out


def few(df: DataFrame) -> list:
    """The rows of a table that has a row per pattern or source; an error beyond MOST_PATTERNS."""
    rows = df.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} sources or membership patterns")
    return rows


def seeded_place(seed: int, *columns: str) -> Column:
    """36 bits that order documents by chance, from their own values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - DIGITS * DIGIT_BITS)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of the driver's if its rows, which are counted, are few; beyond that Spark chooses the join."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def cut_offs(docs: DataFrame, words: dict[int, int]) -> dict[int, int]:
    """For each pattern the place below which documents add up to about ``words``. docs: (pattern, size, place)."""
    spark, width = docs.sparkSession, 1 << DIGIT_BITS
    prefix, left = {p: 0 for p, w in words.items() if w > 0}, {p: w for p, w in words.items() if w > 0}
    done: dict[int, int] = {p: 0 for p, w in words.items() if w <= 0}
    for level in range(DIGITS):
        if not left:
            break
        shift = DIGIT_BITS * (DIGITS - 1 - level)
        want = spark.createDataFrame([(p, prefix[p], left[p]) for p in left], "pattern int, prefix long, words long")
        digit = F.shiftright("place", shift) % width
        sums = docs.join(small(want, len(left)), "pattern").where(F.shiftright("place", shift + DIGIT_BITS) == F.col("prefix")).groupBy("pattern", "words", digit.alias("digit")).agg(F.sum("size").alias("size"))
        up_to = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("digit")))
        over = up_to.where("upto > words").groupBy("pattern").agg(F.min_by(F.struct("digit", "size", "upto"), "digit").alias("at")).select("pattern", "at.*").collect()
        crossed = {r["pattern"]: r for r in over}
        for p in list(left):
            if p not in crossed:  # every document of the range fits
                done[p] = (prefix[p] + 1) << (shift + DIGIT_BITS)
                del left[p], prefix[p]
                continue
            r = crossed[p]
            left[p] -= r["upto"] - r["size"]
            prefix[p] = prefix[p] * width + r["digit"]
            if level == DIGITS - 1:
                done[p] = prefix[p] + (2 * left[p] >= r["size"])
    return done


def decide(docs: DataFrame, targets: dict[str | None, float], seed: int = SEED, place_by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(sources, rounds, below, shares), a row per membership pattern: whole rounds, the place below which one more is due,
    and of each quota that the pattern feeds the share of its words up to there.

    docs has size long, ``sources`` array<string> (the sources that a document is in) and the columns of ``place_by``.
    """
    names = list(targets)
    at = {s: i for i, s in enumerate(names)}
    sized = few(docs.groupBy("sources").agg(F.sum("size").cast("long").alias("size")))
    sized.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    members = [list(dict.fromkeys(r["sources"])) for r in sized]
    feeds = route([(tuple(at[s] for s in m), r["size"]) for m, r in zip(members, sized, strict=True)], [targets[s] for s in names])
    taken = [sum(f) for f in feeds]
    rounds = [min(MOST_COPIES, t // r["size"]) if r["size"] else 0 for t, r in zip(taken, sized, strict=True)]
    rest = {p: 0 if rounds[p] >= MOST_COPIES else taken[p] - rounds[p] * r["size"] for p, r in enumerate(sized)}
    shares = [[(s, sum(f[: k + 1]) / t if t else 1.0) for k, s in enumerate(m)] for m, f, t in zip(members, feeds, taken, strict=True)]
    spark = docs.sparkSession
    of = T.StructField("_sources", T.ArrayType(T.StringType()))
    known = spark.createDataFrame([(r["sources"], p) for p, r in enumerate(sized)], T.StructType([of, T.StructField("pattern", T.IntegerType())]))
    placed = docs.join(small(known, len(sized)), F.col("sources").eqNullSafe(F.col("_sources"))).select("pattern", "size", seeded_place(seed, *place_by).alias("place"))
    below = cut_offs(placed, rest)
    share = T.ArrayType(T.StructType([T.StructField("quota", T.StringType()), T.StructField("upto", T.DoubleType())]))
    kind = T.StructType([of, T.StructField("_rounds", T.IntegerType()), T.StructField("_below", T.LongType()), T.StructField("_shares", share)])
    return small(spark.createDataFrame([(r["sources"], rounds[p], below[p], shares[p]) for p, r in enumerate(sized)], kind), len(sized))


def with_copies(docs: DataFrame, decisions: DataFrame, seed: int = SEED, place_by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (with ``sources``), ``copies``, 0 to 3, and ``quota``, the source whose target a document counts against; each
    row's own values and its pattern's decision suffice."""
    joined = docs.join(decisions, F.col("sources").eqNullSafe(F.col("_sources")))
    extra = (seeded_place(seed, *place_by) < F.col("_below")).cast("int")
    drawn = seeded_place(seed + 1, *place_by) / float(1 << DIGITS * DIGIT_BITS)
    quota = F.get(F.filter("_shares", lambda s: drawn < s["upto"]), 0)["quota"]
    return joined.withColumn("copies", F.col("_rounds") + extra).withColumn("quota", quota).drop("_sources", "_rounds", "_below", "_shares")


def text_crc() -> Column:
    return F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with ``_row``: zero, or a number of its own for each row that agrees with another one in doc_id and _crc.

    Only such rows move. Their keys are counted and sent to all tasks if they are few; beyond that Spark chooses the join.
    """
    keys = cut(docs.groupBy(F.col("doc_id").alias("_d"), F.col("_crc").alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1").select("_d", "_c"))
    n = keys.count()
    if not n:
        return docs.withColumn("_row", F.lit(0).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_crc") == F.col("_c"))
    alone = docs.join(small(keys, n), same, "left_anti").withColumn("_row", F.lit(0).cast("long"))
    repeated, _ = number_rows(docs.join(small(keys, n), same, "left_semi"), [F.col("doc_id"), F.col("_crc"), F.col("sources")], "_row")
    return alone.unionByName(repeated.withColumn("_row", F.col("_row") + 1))


def measured(docs: DataFrame) -> DataFrame:
    """The narrow table that decisions are made on."""
    own = cut(docs.select("doc_id", "source", n_words("text").alias("size"), text_crc().alias("_crc"), F.array("source").alias("sources")))
    return told_apart(own)


def source_targets(own: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, tuple[int, float]]:
    """Size and target of each source; sources weigh in code-point order, null last."""
    sized = few(own.groupBy("source").agg(F.sum("size").cast("long").alias("size")))
    sized.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    shares = capped_shares([r["size"] for r in sized], [weights[i % len(weights)] for i in range(len(sized))])
    return {r["source"]: (r["size"], t) for r, t in zip(sized, shares, strict=True)}


PLACE_BY = ("doc_id", "_crc", "_row")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Each document as often as the mix takes it; only texts of repeated rows move."""
    own = measured(docs)
    targets = {s: t for s, (_, t) in source_targets(own, weights).items()}
    wide = told_apart(docs.withColumns({"_crc": text_crc(), "sources": F.array("source")}))
    mixed = with_copies(wide, decide(own, targets, place_by=PLACE_BY), place_by=PLACE_BY)
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").withColumn("_again", again).select(*docs.columns)


def op5_flow_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; ``taken`` counts words, repeats included."""
    own = measured(table(spark, sf_dir, "documents"))
    found = source_targets(own)
    mixed = with_copies(own, decide(own, {s: t for s, (_, t) in found.items()}, place_by=PLACE_BY), place_by=PLACE_BY)
    rows = spark.createDataFrame([(s, n, t) for s, (n, t) in found.items()], "_source string, source_size long, target double")
    return mixed.join(small(rows, len(found)), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
