"""Point-in-time features of sales: what was known about a client at each moment, by merge-sort trees of clients' events.

Every fact is an event of a client with an event time e and a time a >= e from which it may be known. A probe (client, t)
and a window of d ask for the events with t - d < e and a <= t; as a >= e, the end of the window takes care of itself. A
client's tree has dyadic blocks of event time: leaves of 2^k microseconds and, over them, blocks of 2^(k+1) and so on up to
2^TOP (12.7 days). A block holds its events sorted by a, with prefix sums and the prefix maximum of (e, click): a binary
search for t answers a probe. A window explodes into the few blocks that it covers. Its oldest leaf is covered in part; an
event there counts from a until e + d, so that leaf also holds prefix sums in the order of e, over events with a < e + d,
and the answer is those known by t less those expired by t.

The leaf width follows the client: the widest of WIDTHS whose fullest leaf holds about LEAF events at most. For nearly all
clients that is the top level: the tree is one level of blocks. For a client with a large part of all rows, leaves are
narrow. There, availability is cut into parts of the same width. A block keeps its prefix sums by part; they are made of
events already summed by leaf and part, and what a window's whole blocks hold at the start of a part is the same for all
probes of that part and oldest leaf, so it is worked out once. A probe adds what becomes known inside its own part, from the
events of that part, and its oldest leaf, from the events of that leaf. So an event is sent three times at most, not once a
level, and no client, sale, item or block meets in one task, whatever its share, short of many events of a client within one
second; facts of one kind that happen and become known in the same microsecond are summed before.

Distinct items are made events too: the items of a sale are in a window from a until s + d (s: sold_at); of a client's and
item's intervals in the order of a, each one counts from the end of those before it, if it ends later. As all have one
length, that end is the running maximum of s, plus d; for large clients the maximum is carried over by leaf. The label is
an event as well: a sale at s is ahead of t by up to 7 days if s - 7 days lies in the window (t - 7 days, t].

Definitions: times without a zone are UTC. A sale's t is sold_at plus crc32(sale_id) modulo 259,200 seconds. Cents are
floor(100 x + 0.5), 0 for null. An event may be known DELAY after arrived_at; a line from the later of that of its sale
and shipped_at.

Edge cases: sales without client_id or sold_at give no row and are no events, nor are facts without client, time or
arrival; lines without shipped_at or sale never count; lines without item count but are no item. Clicks equal in all columns
count once, repeated sales and lines as often as they stand, repeated sales also give a row each. A null sale_id adds 0 seconds.
last_click_id is that of the latest click, then the largest id; null ids come last. Empty tables give zeros or an empty
result; extra columns only tell clicks apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrolith.llm.common import cut, table, tidy
from dendrolith.llm.simhash_wide import groups

SECOND = 1_000_000
DAY = 86_400 * SECOND
WINDOWS, AHEAD_DAYS = (2, 14), 7
DELAY = 240 * 60 * SECOND
SPREAD = 259_200
#: log2 of microseconds: of the top level, and the leaf widths to choose from, down to one second.
TOP, WIDTHS = 40, (40, 37, 34, 31, 28, 24, 20)
#: Width by which events are counted first.
COUNTED = 31
#: Events of a client in a leaf.
LEAF = 2048

CLICK, PURCHASE, SALE, LINES, AHEAD, ITEM = range(6)
#: ITEM + 1 + w: an item's interval in window w only.
MEASURES = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a time; one without a zone is UTC whatever the session's zone."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name))
    since = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {since}) * {DAY}L + (extract(HOUR FROM {since}) * 60 + extract(MINUTE FROM {since})) * {60 * SECOND}L + cast(extract(SECOND FROM {since}) * {SECOND} AS bigint)")


def cents(name: str) -> Column:
    return F.coalesce(F.floor(100 * F.col(name) + 0.5), F.lit(0)).cast("long")


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """(client, e, a, kind, n, cents, id) of each different click."""
    every = F.xxhash64(*[F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in clicks.columns])
    e = micros(clicks, "ts")
    kind = F.when(F.col("kind") == "purchase", PURCHASE).otherwise(CLICK)
    rows = clicks.select(F.col("client_id").cast("long").alias("client"), e.alias("e"), F.greatest(e, micros(clicks, "arrived_at") + DELAY).alias("a"), kind.alias("kind"), cents("value").alias("cents"), F.col("click_id").cast("long").alias("id"), every.alias("_row"), F.col("arrived_at").isNull().alias("_late"))
    rows = rows.where(~F.col("_late") & F.col("client").isNotNull() & F.col("e").isNotNull()).drop("_late").distinct()
    return rows.select("client", "e", "a", "kind", F.lit(1).cast("long").alias("n"), "cents", "id")


def probes_of(sales: DataFrame) -> DataFrame:
    """(sale, client, t, copies) of the sales to describe."""
    late = F.coalesce(F.crc32(F.col("sale_id").cast("string")), F.lit(0)) % SPREAD
    rows = sales.select(F.col("sale_id").cast("long").alias("sale"), F.col("client_id").cast("long").alias("client"), (micros(sales, "sold_at") + late * SECOND).alias("t"))
    return rows.where("client IS NOT NULL AND t IS NOT NULL").groupBy("sale", "client", "t").agg(F.count("*").alias("copies"))


def sold(sales: DataFrame) -> DataFrame:
    """(sale, client, s, a, cents): a is null where the sale never arrives."""
    s = micros(sales, "sold_at")
    known = F.when(F.col("arrived_at").isNotNull(), F.greatest(s, micros(sales, "arrived_at") + DELAY))
    return sales.select(F.col("sale_id").cast("long").alias("sale"), F.col("client_id").cast("long").alias("client"), s.alias("s"), known.alias("a"), cents("total").alias("cents")).where("client IS NOT NULL AND s IS NOT NULL")


def lines_of(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """(client, s, a, item, n, cents): equal lines of a sale are summed before they meet their sale."""
    rows = lines.select(F.col("sale_id").cast("long").alias("sale"), F.col("item_id").cast("long").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("cents")).where("sale IS NOT NULL AND shipped IS NOT NULL")
    rows = rows.groupBy("sale", "item", "shipped").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    known = sales.where("a IS NOT NULL").select("sale", "client", "s", "a")
    return rows.join(known.hint("merge"), "sale").select("client", "s", F.greatest("a", "shipped").alias("a"), "item", "n", "cents")


def together(*columns: Column | str) -> Column:
    """Columns as one grouping key, ``at``: rows dealt out by client before are dealt out anew by all of them, so that a
    large client is not aggregated in one task."""
    return F.struct(*columns).alias("at")


def crowded_seconds(facts: DataFrame, leaf: int, narrowest: int = WIDTHS[-1]) -> DataFrame:
    """(client, b, n): facts by leaves of 2^narrowest, of the blocks of 2^COUNTED that hold over half a leaf's events.

    Others have no say in a client's width: what they hold at any width fits, and twice that is a leaf's events at most. Of a
    block, however many facts it has, a row per narrowest leaf goes on."""
    held = facts.groupBy(together("client", F.shiftright("e", narrowest).alias("b"))).agg(F.count("*").alias("n")).select("at.*", "n")
    block = Window.partitionBy("client", F.shiftright("b", COUNTED - narrowest))
    return held.withColumn("_held", F.sum("n").over(block)).where(2 * F.col("_held") > leaf).drop("_held")


def leaf_widths(facts: DataFrame, leaf: int) -> DataFrame:
    """(client, k) of the clients whose tree has more than its top level. facts: (client, e).

    Facts are counted by leaves of 2^COUNTED first; where a client holds far more than a leaf in one of those, its crowded ones
    are counted again by seconds. No width parts what has one time: of the widths whose fullest leaf holds no more than a leaf's events,
    or twice what the narrowest leaf holds anyway, a client has the widest."""
    fine = [k for k in WIDTHS if k < COUNTED]

    def fullest(base: DataFrame, levels: list[int]) -> DataFrame:
        level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("b", k - levels[-1]).alias("at")) for k in levels])).alias("level")
        full = base.select("client", "n", level).groupBy(together("client", "level.k", "level.at")).agg(F.sum("n").alias("n"))
        return full.groupBy("at.client", "at.k").agg(F.max("n").alias("n"))

    counted = facts.groupBy(together("client", F.shiftright("e", COUNTED).alias("b"))).agg(F.count("*").alias("n")).select("at.*", "n")
    many = counted.groupBy("client").agg(F.sum("n").alias("n")).where(F.col("n") > leaf).select("client")
    full = fullest(counted.join(many.hint("merge"), "client", "left_semi"), [k for k in WIDTHS if k >= COUNTED])
    full = cut(full)
    dense = full.where((F.col("k") == COUNTED) & (F.col("n") > 16 * leaf)).select("client")
    if not dense.isEmpty():
        full = full.union(fullest(crowded_seconds(facts, leaf, fine[-1]).join(dense.hint("merge"), "client", "left_semi"), fine))
    least = full.groupBy("client").agg(F.min_by("n", "k").alias("least"))
    fits = F.col("n") <= F.greatest(F.lit(leaf), 2 * F.col("least"))
    widest = full.join(least, "client").groupBy("client").agg(F.max(F.when(fits, F.col("k"))).alias("k"))
    return widest.where(F.col("k") < TOP)


def with_width(rows: DataFrame, widths: DataFrame) -> DataFrame:
    return rows.join(widths.hint("merge"), "client", "left").withColumn("k", F.coalesce("k", F.lit(TOP)))


def item_events(lines: DataFrame, widths: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """One event per stretch of time in which an item is in a window through one sale and through none before it."""
    rows = lines.where("item IS NOT NULL").groupBy("client", "item", "s").agg(F.min("a").alias("a"))
    rows = with_width(rows, widths)
    before = Window.partitionBy("at").orderBy("a", F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    few = rows.where(F.col("k") == TOP).withColumn("at", together("client", "item")).withColumn("upto", F.max("s").over(before)).select("client", "s", "a", "upto")
    many = rows.where(F.col("k") < TOP).withColumn("at", together("client", "item", F.expr("shiftright(a, k)").alias("leaf")))
    ends = many.groupBy("at").agg(F.max("s").alias("last"))
    earlier = Window.partitionBy("at.client", "at.item").orderBy("at.leaf").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("at", F.max("last").over(earlier).alias("carried"))
    many = many.withColumn("own", F.max("s").over(before)).join(carried.hint("merge"), "at")
    rows = few.union(many.select("client", "s", "a", F.greatest("own", "carried").alias("upto")))
    from_ = [F.greatest(F.col("a"), F.col("upto") + d * DAY) for d in days]
    free = F.col("upto").isNull() | (F.col("upto") + max(days) * DAY <= F.col("a"))
    each = F.array(*[F.struct(F.lit(ITEM + 1 + w).alias("kind"), p.alias("a"), (p < F.col("s") + days[w] * DAY).alias("some")) for w, p in enumerate(from_)])
    one = F.array(F.struct(F.lit(ITEM).alias("kind"), F.col("a").alias("a"), F.lit(True).alias("some")))
    found = rows.select("client", F.col("s").alias("e"), F.explode(F.when(free, one).otherwise(each)).alias("x")).where("x.some")
    return found.select("client", "e", "x.a", "x.kind", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"), F.lit(None).cast("long").alias("id"))


EVENT = ["client", "e", "a", "kind", "n", "cents", "id"]


def simple(rows: DataFrame, e: Column, a: Column, kind: int, n: Column, cents: Column) -> DataFrame:
    return rows.select("client", e.alias("e"), a.alias("a"), F.lit(kind).alias("kind"), n.cast("long").alias("n"), cents.cast("long").alias("cents"), F.lit(None).cast("long").alias("id"))


def blocks(starts: np.ndarray, ends: np.ndarray, k: np.ndarray, top: int = TOP) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Dyadic blocks that tile the leaves [start, end) of each row: (rows, levels above its leaves, block numbers)."""
    lo, hi, rows, up = starts.copy(), ends.copy(), np.arange(len(starts)), 0
    while len(rows):
        last = k[rows] + up >= top
        left = (lo < hi) & ((lo & 1 == 1) | last)
        while left.any():
            yield rows[left], up, lo[left]
            lo[left] += 1
            left = (lo < hi) & last
        right = (lo < hi) & (hi & 1 == 1)
        hi[right] -= 1
        yield rows[right], up, hi[right]
        more = lo < hi
        rows, lo, hi, up = rows[more], lo[more] >> 1, hi[more] >> 1, up + 1


SPAN = "client long, k int, part long, w int, oldest long"


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, the whole leaves after ``oldest`` up to ``part``, to the dyadic blocks that tile them."""
    for b in batches:
        k, part, oldest = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "part", "oldest"))
        for rows, up, block in blocks(oldest + 1, part + 1, k):
            if len(rows):
                own = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array((k[rows] + up).astype(np.int32)), pa.array(block)], names=[*own.schema.names, "level", "block"])


#: Rows of a cell. ``part`` null: the events of a leaf, or of a whole block at the top, with probes that ask for window w (-1:
#: for all). Else: the events that become known in that part, with probes, and rows of sums known before it: those of window w
#: for the probes whose oldest leaf is ``oldest``.
ROWS = ("key", "part", "k", "w", "oldest", "kind", "e", "a", "n", "cents", "id", "sale", "client")
ANSWER = "sale long, client long, t long, w int, " + ", ".join(f"{m} long" for m in MEASURES) + ", last long, last_id long"


def answers(cell: np.ndarray, event: dict[str, np.ndarray], at: np.ndarray, t: np.ndarray, span: int, expire: bool) -> tuple[np.ndarray, np.ndarray]:
    """For probes (cell, t), sums of all measures over the events of their cell that are known by t and, with ``expire``, are
    not older than the span; and the row of the last click (-1: none). Each is a binary search.

    ``cell`` and ``event`` are the events, in the order of cells."""
    e, a, kind, n, cents = (event[c] for c in ("e", "a", "kind", "n", "cents"))
    times = np.unique(np.concatenate([a, e + span, t]))
    place = lambda c, x: c.astype(np.int64) << 32 | np.searchsorted(times, x)
    item = (kind >= ITEM) | (kind == AHEAD)
    measures = [n * (kind <= PURCHASE), n * (kind == PURCHASE), cents * (kind <= PURCHASE), n * (kind == SALE), cents * (kind == SALE), n * (kind == LINES), cents * (kind == LINES), n * item]
    measures = np.stack(measures, axis=1).astype(np.int64)
    asked = place(at, t)

    def upto(key: np.ndarray) -> np.ndarray:
        """Sums over the events of the probe's cell whose key is not after the probe."""
        order = np.argsort(key, kind="stable")
        sums = np.concatenate([np.zeros((1, measures.shape[1]), dtype=np.int64), np.cumsum(measures[order], axis=0)])
        held = key[order]
        return sums[np.searchsorted(held, asked, side="right")] - sums[np.searchsorted(held, at.astype(np.int64) << 32, side="left")]

    since = place(cell, a)
    total = upto(since)
    if expire:
        total = total - upto(place(cell, e + span))
    clicks = np.flatnonzero(kind <= PURCHASE)
    last = np.full(len(t), -1)
    if len(clicks):
        rank = np.empty(len(clicks), dtype=np.int64)
        rank[np.lexsort((event["id"][clicks], e[clicks]))] = np.arange(len(clicks))
        of_rank = clicks[np.argsort(rank)]
        order = np.argsort(since[clicks], kind="stable")
        own = cell[clicks][order].astype(np.int64)
        best = np.maximum.accumulate(own * (len(clicks) + 1) + rank[order] + 1)
        found = np.searchsorted(since[clicks][order], asked, side="right") - 1
        good = (found >= 0) & (own[found] == at)
        last[good] = of_rank[best[found[good]] % (len(clicks) + 1) - 1]
        late = (last >= 0) & (e[last] <= t - span)  # the latest click has left the window
        last[late] = -1
    return total, last


NO_ID = -(1 << 62)


def _answered(days: tuple[int, ...], ahead: int):
    spans = [d * DAY for d in days] + [ahead * DAY]

    def kinds(w: int) -> tuple[int, ...]:
        return (AHEAD,) if w == len(days) else (CLICK, PURCHASE, SALE, LINES, ITEM, ITEM + 1 + w)

    def cells(block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray], bool]]:
        """(window, probe rows, cells, events, whether they expire) of the comparisons that a block of whole cells holds."""
        held = {c: block.column(c).fill_null(NO_ID if c == "id" else 0).to_numpy() for c in ("key", "part", "k", "oldest", "e", "a", "n", "cents", "id")}
        kind, w = (block.column(c).fill_null(-1).to_numpy() for c in ("kind", "w"))
        known = block.column("part").is_valid().to_numpy()
        cell = np.concatenate([[0], np.cumsum(np.diff(held["key"]) != 0)])
        held |= {"kind": kind, "cell": cell}
        for number, span in enumerate(spans):
            fits = np.isin(kind, kinds(number))
            events = np.flatnonzero(~known & fits & (held["a"] < held["e"] + span))
            probes = np.flatnonzero(~known & (kind < 0) & ((w == number) | (w == -1)))
            yield number, probes, events, held, True
            # inside a part, the oldest leaf of a window is one of two
            probes = np.flatnonzero(known & (kind < 0))
            oldest = (held["a"][probes] - span) >> held["k"][probes]
            least = np.full(int(cell[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cell[probes], oldest)
            for more in (0, 1):
                own = probes[oldest == least[cell[probes]] + more]
                bound = least[cell] + more
                before = (w == number) & (held["oldest"] == bound)
                inside = (w == -1) & ((held["e"] >> held["k"]) > bound)
                yield number, own, np.flatnonzero(known & fits & (before | inside)), held, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 1 << 16):
            for number, probes, events, held, expire in cells(block):
                if not len(probes) or not len(events):
                    continue
                own = {c: held[c][events] for c in ("e", "a", "n", "cents", "id", "kind")}
                t = held["a"][probes]
                total, last = answers(held["cell"][events], own, held["cell"][probes], t, spans[number], expire)
                some = np.flatnonzero((total != 0).any(axis=1) | (last >= 0))
                if not len(some):
                    continue
                total, last = total[some], last[some]
                ids, none = own["id"][last], last < 0
                asked = block.select(["sale", "client"]).take(pa.array(probes[some]))
                columns = [asked.column("sale"), asked.column("client"), pa.array(t[some]), pa.array(np.full(len(some), number, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(len(MEASURES))]]
                columns += [pa.array(own["e"][last], mask=none), pa.array(ids, mask=none | (ids == NO_ID))]
                columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANSWER.split(", ")])
        tidy()

    return run


TYPES = {c: "int" if c in ("k", "w", "kind") else "long" for c in ROWS}


def cell_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of cells; columns that are not given are null."""
    return df.select(*[columns.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in ROWS])


def own_columns(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def known_before(events: DataFrame, spans: DataFrame, kinds: int) -> DataFrame:
    """What the whole blocks of each span hold at the start of its part: a row per span and kind of event.

    events: (client, k, leaf, part, kind, n, cents, e, id); spans: (client, k, part, w, oldest)."""
    sums = [F.sum(F.when(F.col("kind") == j, F.col(c))).alias(f"{c}{j}") for j in range(kinds) for c in ("n", "cents")]
    last = F.max(F.when(F.col("kind") <= PURCHASE, F.struct("e", "id"))).alias("last")
    summed = events.groupBy(together("client", "k", "leaf", "part")).agg(*sums, last).select("at.*", *[f"{c}{j}" for j in range(kinds) for c in ("n", "cents")], "last")
    again = [F.sum(f"{c}{j}").alias(f"{c}{j}") for j in range(kinds) for c in ("n", "cents")] + [F.max("last").alias("last")]
    level = F.explode(F.expr(f"sequence(k, {TOP})")).alias("level")
    tree = summed.select("*", level).groupBy(together("client", "level", F.expr("shiftright(leaf, level - k)").alias("block"), "part")).agg(*again)
    tiles = cut(spans.mapInArrow(_exploded, f"{SPAN}, level int, block long"))
    visits = tiles.select(together("client", "level", "block", "part")).distinct()
    both = tree.unionByName(visits, allowMissingColumns=True).withColumn("block_", F.struct("at.client", "at.level", "at.block"))
    earlier = Window.partitionBy("block_").orderBy("at.part").rangeBetween(Window.unboundedPreceding, -1)
    held = both.select("at", *[F.sum(f"{c}{j}").over(earlier).alias(f"{c}{j}") for j in range(kinds) for c in ("n", "cents")], F.max("last").over(earlier).alias("last")).dropDuplicates(["at"])
    span = together("client", "k", "part", "w", "oldest")
    found = tiles.select(span.alias("span"), together("client", "level", "block", "part")).join(held, "at").groupBy("span").agg(*again)
    click = lambda j: F.col("last") if j <= PURCHASE else F.lit(None).cast("struct<e:bigint,id:bigint>")
    stacked = F.explode(F.array(*[F.struct(F.lit(j).alias("kind"), F.col(f"n{j}").alias("n"), F.col(f"cents{j}").alias("cents"), click(j).alias("last")) for j in range(kinds)])).alias("x")
    return found.select("span.*", stacked).where("x.n IS NOT NULL").select(*[c.split()[0] for c in SPAN.split(", ")], "x.kind", "x.n", "x.cents", F.coalesce("x.last.e", F.lit(0)).alias("e"), F.col("x.last.id").alias("id"))


def cells_of_large(events: DataFrame, probes: DataFrame, spans: list[int], kinds: int) -> DataFrame:
    """Cells of clients with leaves below the top: the events of each leaf, and those that become known in each part."""
    events = events.groupBy(together("client", "k", "e", "a", "kind")).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("id").alias("id")).select("at.*", "n", "cents", "id")
    events = cut(events.withColumns({"leaf": F.expr("shiftright(e, k)"), "part": F.expr("shiftright(a, k)")}))
    windows = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.expr(f"shiftright(t - {span}L, k)").alias("oldest")) for w, span in enumerate(spans)])).alias("x")
    probes = probes.withColumn("part", F.expr("shiftright(t, k)"))
    asked = probes.select("sale", "client", "t", "k", "part", windows)
    before = known_before(events, asked.select(together("client", "k", "part", "x.w", "x.oldest")).distinct().select("at.*"), kinds)
    leaf = lambda of: F.xxhash64(F.lit("leaf"), "client", of)
    part, every = F.xxhash64(F.lit("part"), "client", "part"), F.lit(-1)
    fact = own_columns("kind", "e", "a", "n", "cents", "id")
    ask = own_columns("sale", "client") | {"a": F.col("t")}
    rows = [
        cell_rows(events, key=leaf("leaf"), **fact),
        cell_rows(events, key=part, part=F.col("part"), k=F.col("k"), w=every, **fact),
        cell_rows(before, key=part, a=F.expr("shiftleft(part, k)"), **own_columns("part", "k", "w", "oldest", "kind", "e", "n", "cents", "id")),
        cell_rows(asked, key=leaf("x.oldest"), w=F.col("x.w"), **ask),
        cell_rows(probes, key=part, part=F.col("part"), k=F.col("k"), w=every, **ask),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).union(rows[4])


def cells_of_small(events: DataFrame, probes: DataFrame, longest: int) -> DataFrame:
    """Cells of clients whose only level is the top: a cell is a block, a probe asks each for all windows at once."""
    asked = probes.withColumn("block", F.explode(F.sequence(F.shiftright(F.col("t") - longest, TOP), F.shiftright("t", TOP))))
    held = cell_rows(events, key=F.xxhash64("client", F.shiftright("e", TOP)), **own_columns("kind", "e", "a", "n", "cents", "id"))
    return held.union(cell_rows(asked, key=F.xxhash64("client", "block"), w=F.lit(-1), a=F.col("t"), **own_columns("sale", "client")))


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, days: tuple[int, ...] = WINDOWS, ahead: int = AHEAD_DAYS, leaf: int = LEAF) -> DataFrame:
    """A row per sale and window: sale_id, d, t_us, label and the features."""
    clicked, known = cut(distinct_clicks(clicks)), sold(sales)
    lined, probes = cut(lines_of(lines, known)), probes_of(sales)
    widths = cut(leaf_widths(clicked.select("client", "e").union(known.select("client", "s")).union(lined.select("client", "s")), leaf))
    zero, one = F.lit(0), F.lit(1)
    events = (
        clicked.union(simple(known.where("a IS NOT NULL"), F.col("s"), F.col("a"), SALE, one, F.col("cents")))
        .union(simple(known, F.col("s") - ahead * DAY, F.col("s") - ahead * DAY, AHEAD, one, zero))
        .union(simple(lined.groupBy("client", "s", "a").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")), F.col("s"), F.col("a"), LINES, F.col("n"), F.col("cents")))
        .union(item_events(lined, widths, days))
    )
    events, probes = with_width(events, widths), with_width(probes, widths)
    events, probes = cut(events), cut(probes)
    spans = [d * DAY for d in (*days, ahead)]
    small = cells_of_small(events.where(F.col("k") == TOP).select(*EVENT), probes.where(F.col("k") == TOP), max(spans))
    large = cells_of_large(events.where(F.col("k") < TOP), probes.where(F.col("k") < TOP), spans, ITEM + 1 + len(days))
    found = small.union(large).repartition("key").sortWithinPartitions("key").mapInArrow(_answered(days, ahead), ANSWER)
    nothing = probes.select("sale", "client", "t", F.lit(-1).alias("w"), *[F.lit(0).cast("long").alias(m) for m in MEASURES], *[F.lit(None).cast("long").alias(c) for c in ("last", "last_id")], "copies")
    rows = nothing.union(found.withColumn("copies", F.lit(0).cast("long")))
    of = lambda w, c: F.when(F.col("w") == w, F.col(c))
    sums = [F.coalesce(F.sum(of(w, m)), F.lit(0)).alias(f"{m}{w}") for w in range(len(days)) for m in MEASURES]
    lasts = [F.max(F.when((F.col("w") == w) & F.col("last").isNotNull(), F.struct("last", "last_id"))).alias(f"last{w}") for w in range(len(days))]
    label = F.coalesce(F.sum(of(len(days), "n_items")), F.lit(0)) > 0
    whole = rows.groupBy("sale", "client", "t").agg(*sums, *lasts, label.alias("label"), F.max("copies").alias("copies"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), *[F.col(f"{m}{w}").alias(m) for m in MEASURES], F.col(f"last{w}.last_id").alias("last_click_id")) for w, d in enumerate(days)])).alias("x")
    whole = whole.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select("sale", "t", "label", each)
    columns = ["n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"]
    return whole.select(F.col("sale").alias("sale_id"), "x.d", F.col("t").alias("t_us"), "label", *[f"x.{c}" for c in columns])


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and label of every sale, for windows of 2 and 14 days."""
    return features(*(table(spark, sf_dir, name) for name in ("clicks", "sales", "sale_lines")))


OP12_SQL = """
WITH p AS (
  SELECT sale_id, client_id, epoch_us(sold_at) + 1000000 * ((4294967295 - list_reduce(
           list_concat([4294967295], list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: xor(v >> 1, (v & 1) * 3988292384)))) % 259200) AS t
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), w AS (SELECT unnest([2, 14]) AS d
), q AS (SELECT sale_id, client_id, t, d, t - d * 86400000000 AS since FROM p, w
), c AS (
  SELECT client_id, epoch_us(ts) AS e, epoch_us(arrived_at) + 14400000000 AS a, kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS v, click_id FROM (SELECT DISTINCT * FROM clicks)
), s AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS e, epoch_us(arrived_at) + 14400000000 AS a, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS v FROM sales
), l AS (
  SELECT sale_id, item_id, epoch_us(shipped_at) AS b, coalesce(floor(100 * amount + 0.5), 0)::BIGINT AS v FROM sale_lines
), fc AS (
  SELECT sale_id, t, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(v) AS click_cents, max({'e': e, 'i': click_id}).i AS last_click_id
  FROM q JOIN c USING (client_id) WHERE e > since AND e <= t AND a <= t GROUP BY ALL
), fs AS (
  SELECT q.sale_id, t, d, count(*) AS n_sales, sum(v) AS sale_cents FROM q JOIN s USING (client_id) WHERE e > since AND e <= t AND a <= t GROUP BY ALL
), fl AS (
  SELECT q.sale_id, t, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(l.v) AS line_cents
  FROM q JOIN s USING (client_id) JOIN l ON l.sale_id = s.sale_id WHERE e > since AND e <= t AND a <= t AND b <= t GROUP BY ALL
), ahead AS (
  SELECT DISTINCT p.sale_id, t FROM p JOIN s USING (client_id) WHERE e > t AND e <= t + 604800000000
)
SELECT q.sale_id, q.d, q.t AS t_us, ahead.t IS NOT NULL AS label, coalesce(n_clicks, 0)::BIGINT AS n_clicks, coalesce(n_purchases, 0)::BIGINT AS n_purchases,
       coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id, coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM q LEFT JOIN fc ON fc.sale_id = q.sale_id AND fc.t = q.t AND fc.d = q.d LEFT JOIN fs ON fs.sale_id = q.sale_id AND fs.t = q.t AND fs.d = q.d
LEFT JOIN fl ON fl.sale_id = q.sale_id AND fl.t = q.t AND fl.d = q.d LEFT JOIN ahead ON ahead.sale_id = q.sale_id AND ahead.t = q.t
"""
