"""Sweeps over collections of trees as edge tables (tree, child, parent, length): from the root down, and from the tips up.

Both strip the tips off the trees, again and again, while at least a fifth of what is left are tips: a bushy tree is gone
after a few layers, each smaller than the one before, and children meet only at their own parent. What is left has long
paths and goes by pointer doubling: after k rounds every node knows the node 2^k steps above it, and the sweep over the
steps between. Rounds grow with the logarithm of the size and of the depth, no tree meets in one task; a caterpillar of a
million tips takes twenty rounds, and a table of its paths is never made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrolith.operators import groves as G
from dendrolith.operators.scans import running, settled

MOST_ROUNDS = 64
#: Of a sum of squares a tip, what counts as none.
FLAT = 1e-9
#: Layers are stripped while a node in so many is a tip.
SPARSE = 5
#: Rows of inner nodes up to which the planner may send them to every task, and so through the driver.
FEW = 100_000


def nodes_of(edges: DataFrame) -> DataFrame:
    """(tree, node, parent, length, _kids): every node once with its number of children, the root with a null parent and
    length 0; settled, as sweeps read it several times."""
    inner = edges.where("parent is not null").select("tree", F.col("child").alias("node"), "parent", F.col("length").cast("double").alias("length"))
    ends = inner.select("tree", F.col("parent").alias("node"), F.lit(1).cast("long").alias("_k")).union(edges.where("parent is null and child is not null").select("tree", "child", F.lit(0).cast("long")))
    counted = ends.groupBy("tree", "node").agg(F.sum("_k").alias("_kids"))
    return settled(inner.join(counted.hint("merge"), ["tree", "node"], "full").na.fill({"length": 0.0, "_kids": 0}))


def _counted(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their numbers of children; those that bring them are settled."""
    if "_kids" in nodes.columns:
        return nodes
    kids = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_kids"))
    return settled(nodes.join(kids.hint("merge"), ["tree", "node"], "left").na.fill({"_kids": 0}))


def _rounds(now: DataFrame, step) -> DataFrame:
    """Apply ``step`` until no node has a jump left."""
    for _ in range(MOST_ROUNDS):
        now = settled(now)
        if now.where("jump is not null").isEmpty():
            return now
        now = step(now)
    raise ValueError("the edges have a loop, or a depth of over 2^64")


def _strip(rest: DataFrame, sends: Sequence[Column], takes: Sequence[Column]) -> tuple[list[DataFrame], DataFrame | None, list[int]]:
    """Layers of tips from the outside in, what long paths are left, and how many rows lie inside each layer.

    ``rest`` has tree, node, parent, _open (children not yet stripped) and more; the tips' ``sends`` are aggregated at
    their parents, whose other columns become ``takes``."""
    layers, inside = [], []
    while True:
        leaf = rest.where("_open = 0")
        sent = leaf.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_gone"), *sends)
        layers.append(leaf)
        rest = rest.where("_open > 0").join(sent.hint("merge"), ["tree", "node"], "left")
        rest = settled(rest.select("tree", "node", "parent", (F.col("_open") - F.coalesce("_gone", F.lit(0))).alias("_open"), *takes))
        n, tips = rest.agg(F.count("*"), F.count_if(F.col("_open") == 0)).first()
        inside.append(n)
        if not n:
            return layers, None, inside
        if tips * SPARSE < n:
            return layers, rest, inside


def down(nodes: DataFrame, maps: dict[str, tuple[Column, Column]], roots: dict[str, Column] | None = None, keep: Sequence[str] = (), above: bool = False) -> DataFrame:
    """(tree, node, keep..., names...): value(node) = slope * value(parent) + shift along every path from the root.

    ``nodes`` has tree, node, parent and what the columns of ``maps`` read; the root's value is 0 or that of ``roots``.
    A slope of one gives sums, a slope of zero sets a value that the nodes below inherit. Affine maps compose, so that the
    map from 2^k steps above is that of two half ways. With ``above`` the parent's value of each name comes as above_name."""
    roots = roots or {}
    top = F.col("parent").isNull()
    columns = []
    for name, (slope, shift) in maps.items():
        columns += [F.when(top, 0.0).otherwise(slope.cast("double")).alias(f"a_{name}"), F.when(top, roots.get(name, F.lit(0.0)).cast("double")).otherwise(shift.cast("double")).alias(f"b_{name}")]
    carried = [k for k in keep if k != "parent"]
    both = [f"{k}_{n}" for n in maps for k in "ab"]
    start = _counted(nodes).select("tree", "node", "parent", F.col("_kids").alias("_open"), *carried, *columns)
    layers, core, inside = _strip(start, [], [*carried, *both])
    out = ["tree", "node", "parent", *carried]

    def below(rows: DataFrame, known: DataFrame | None, few: bool) -> DataFrame:
        if known is None:  # roots
            return rows.select(*out, *[F.col(f"b_{n}").alias(n) for n in maps], *[F.lit(None).cast("double").alias(f"above_{n}") for n in maps if above])
        far = known.select("tree", F.col("node").alias("parent"), *[F.col(n).alias(f"_{n}") for n in maps])
        value = lambda n: F.when(top, F.col(f"b_{n}")).otherwise(F.col(f"a_{n}") * F.col(f"_{n}") + F.col(f"b_{n}")).alias(n)
        return rows.join(far if few else far.hint("merge"), ["tree", "parent"], "left").select(*out, *map(value, maps), *[F.col(f"_{n}").alias(f"above_{n}") for n in maps if above])

    known = None
    if core is not None:
        found = _down_paths(core.select("tree", "node", F.col("parent").alias("jump"), *both), list(maps))
        known = settled(below(core, found, False))
    for k in range(len(layers) - 1, -1, -1):
        rows = below(layers[k], known, inside[k] <= FEW)
        rows = settled(rows) if k else rows
        known = rows if known is None else known.unionByName(rows)
    return known.select("tree", "node", *keep, *maps, *[f"above_{n}" for n in maps if above])


def _down_paths(start: DataFrame, names: list[str]) -> DataFrame:
    """(tree, node, names...) of nodes (tree, node, jump, a_name, b_name) by pointer doubling."""

    def step(now: DataFrame) -> DataFrame:
        far = now.select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), *[F.col(f"{k}_{n}").alias(f"_{k}_{n}") for n in names for k in "ab"])
        joined = now.join(far.hint("merge"), ["tree", "jump"], "left")
        out = []
        for n in names:
            a, b, up = F.col(f"a_{n}"), F.col(f"b_{n}"), F.col("jump").isNotNull()
            out += [F.when(up, a * F.col(f"_a_{n}")).otherwise(a).alias(f"a_{n}"), F.when(up, a * F.col(f"_b_{n}") + b).otherwise(b).alias(f"b_{n}")]
        return joined.select("tree", "node", F.col("_jump").alias("jump"), *out)

    return _rounds(start, step).select("tree", "node", *[F.col(f"b_{n}").alias(n) for n in names])


FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "or": F.bit_or}
TWO = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
    "or": lambda a, b: F.coalesce(a.bitwiseOR(b), a, b),
}


def up(nodes: DataFrame, values: dict[str, tuple[str, Column]], scale: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(tree, node, keep..., names...): each value folded over the node and all nodes below it.

    ``values`` names a fold (sum, min, max, or) and what a node itself brings; nulls bring nothing. With ``scale`` a node's
    sums count that many times at its parent. In the doubling, the descendants at fewer than 2^(k+1) steps are those at
    fewer than 2^k, and the same of the nodes exactly 2^k steps below."""
    carried = [k for k in keep if k != "parent"]
    weight = ["_scale"] if scale is not None else []
    own = [v.alias(n) for n, (_, v) in values.items()]
    start = _counted(nodes).select("tree", "node", "parent", F.col("_kids").alias("_open"), *carried, *([scale.cast("double").alias("_scale")] if weight else []), *own)
    sends = [FOLD[k](F.col("_scale") * F.col(n) if weight else F.col(n)).alias(f"_{n}") for n, (k, _) in values.items()]
    takes = [TWO[k](F.col(n), F.col(f"_{n}")).alias(n) for n, (k, _) in values.items()]
    layers, core, _ = _strip(start, sends, [*carried, *weight, *takes])
    found = [x.select("tree", "node", *keep, *values) for x in layers]
    if core is not None:

        def step(now: DataFrame) -> DataFrame:
            sent = now.where("jump is not null").groupBy("tree", F.col("jump").alias("node")).agg(*sends)
            far = now.select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), *[F.col(w).alias("_far") for w in weight])
            kept = now.join(sent.hint("merge"), ["tree", "node"], "left").select("tree", "node", "jump", *weight, *takes)
            return kept.join(far.hint("merge"), ["tree", "jump"], "left").select("tree", "node", F.col("_jump").alias("jump"), *[(F.col(w) * F.col("_far")).alias(w) for w in weight], *values)

        rows = _rounds(core.select("tree", "node", F.col("parent").alias("jump"), *weight, *values), step).drop("jump", "_scale")
        found.append(rows.join(core.select("tree", "node", *keep).hint("merge"), ["tree", "node"]).select("tree", "node", *keep, *values) if keep else rows)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def is_tip(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a column tip."""
    if "_kids" in nodes.columns:
        return nodes.withColumn("tip", F.col("_kids") == 0)
    above = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct().withColumn("_above", F.lit(True))
    return nodes.join(above, ["tree", "node"], "left").withColumn("tip", F.col("_above").isNull()).drop("_above")


def ranks(edges: DataFrame) -> DataFrame:
    """(tree, node, preorder, postorder, depth, size) from 0, siblings by name.

    A node's preorder rank is its parent's, plus one, plus the sizes of its earlier siblings' subtrees; its postorder rank
    follows from that, its depth and its own size. Sizes are summed from the tips up, ranks from the root down."""
    sized = up(nodes_of(edges), {"size": ("sum", F.lit(1).cast("long"))}, keep=["parent", "_kids"])
    kids = settled(running(sized, ["tree", "parent"], ["node"], {"upto": F.col("size")}))
    before = F.col("upto") - F.col("size")
    found = down(kids, {"pre": (F.lit(1.0), 1 + before), "depth": (F.lit(1.0), F.lit(1.0))}, keep=["size"])
    pre, depth = F.col("pre").cast("long"), F.col("depth").cast("long")
    return found.select("tree", "node", pre.alias("preorder"), (pre - depth + F.col("size") - 1).alias("postorder"), depth.alias("depth"), "size")


def clade_bits(edges: DataFrame, taxa: DataFrame, words: int) -> DataFrame:
    """(tree, node, bits array<long>, n): the tips under each node as a set of fixed width.

    ``taxa`` is (name, at): a tip's place from 0; ``words`` holds 63 places each. A set is 8 * words bytes whatever the
    names are; sets of children are united by an OR aggregate, level by level of the doubling."""
    tipped = settled(is_tip(nodes_of(edges)).join(taxa.select(F.col("name").alias("node"), "at"), "node", "left"))
    if not (bad := tipped.where("tip and at is null").select("node").first()) is None:
        raise ValueError(f"tip {bad[0]!r} is not among the taxa")
    word = lambda w: F.when(F.col("tip"), F.when(F.floor(F.col("at") / 63) == w, F.expr("shiftleft(1L, cast(at % 63 as int))")).otherwise(F.lit(0).cast("long")))
    found = up(tipped, {f"w{w}": ("or", word(w)) for w in range(words)})
    bits = F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(words)])
    size = F.aggregate("bits", F.lit(0), lambda n, b: n + F.bit_count(b))
    return found.select("tree", "node", bits.alias("bits")).withColumn("n", size.cast("long"))


def heights_below(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, tip, height, low, above): heights from a collection of rooted trees, the height of the latest tip
    under each node and that of its parent."""
    far = settled(down(_counted(nodes), {"distance": (F.lit(1.0), F.col("length"))}, keep=["parent", "_kids"], above=True))
    tip, top = F.col("_kids") == 0, F.col("_top")
    near = up(far, {"_near": ("min", F.when(tip, F.col("distance")))}, keep=["parent", "_kids", "distance", "above_distance"])
    rows = near.join(far.groupBy("tree").agg(F.max("distance").alias("_top")), "tree")
    return rows.select("tree", "node", "parent", tip.alias("tip"), (top - F.col("distance")).alias("height"), (top - F.col("_near")).alias("low"), (top - F.col("above_distance")).alias("above"))


def to_ratios(placed: DataFrame) -> DataFrame:
    """(tree, node, parent, low, height, above, ratio) of inner nodes: their place between their lower bound and their parent; the root's own height.

    ``placed`` is what ``heights_below`` gives, or has tree, node, parent, tip, height and low."""
    inner = _above(placed.where("not tip"))
    ratio = F.when(F.col("parent").isNull(), F.col("height")).otherwise((F.col("height") - F.col("low")) / (F.col("above") - F.col("low")))
    return inner.select("tree", "node", "parent", "low", "height", "above", ratio.alias("ratio"))


def _above(inner: DataFrame) -> DataFrame:
    """``inner`` with the height of each node's parent."""
    if "above" in inner.columns:
        return inner
    return inner.join(inner.select("tree", F.col("node").alias("parent"), F.col("height").alias("above")), ["tree", "parent"], "left")


def from_ratios(inner: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(tree, node, keep..., height) of inner nodes from (tree, node, parent, low, ratio): h = low + ratio (h(parent) - low), affine in the parent."""
    return down(inner, {"height": (F.col("ratio"), (1 - F.col("ratio")) * F.col("low"))}, {"height": F.col("ratio")}, keep)


def ratio_log_jacobian(inner: DataFrame) -> DataFrame:
    """(tree, lj) of the transform from ratios, from (tree, node, parent, low, height)."""
    rows = _above(inner).where("parent is not null and above is not null")
    return rows.groupBy("tree").agg(F.sum(F.log(F.col("above") - F.col("low"))).alias("lj"))


def ratio_gradients(inner: DataFrame, slopes: DataFrame, jacobian: bool | None = False) -> DataFrame:
    """(tree, node, slope): the gradient by ratios and the root's height, from that by heights (tree, node, by_height).

    A node's height moves every height below it by the product of the ratios in between, so that the whole slope by a height
    is its own plus, over the children, their ratio times their whole slope: a scaled sweep from the tips up. With
    ``jacobian`` the log of the transform's determinant is added to what is differentiated; None gives both, the second
    as with_jacobian."""
    known = _above(inner).join(slopes.select("tree", "node", "by_height").hint("merge"), ["tree", "node"], "left").na.fill({"by_height": 0.0})
    gap = F.when(F.col("parent").isNotNull(), 1 / (F.col("above") - F.col("low")))
    added = _above(inner).where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_kids"), F.sum(gap).alias("_g"))
    known = settled(known.join(added.hint("merge"), ["tree", "node"], "left").na.fill({"_kids": 0, "_g": 0.0}))
    sums = {} if jacobian else {"slope": ("sum", F.col("by_height"))}
    if jacobian or jacobian is None:
        sums["slope" if jacobian else "with_jacobian"] = "sum", F.col("by_height") + F.col("_g")
    whole = up(known, sums, F.col("ratio"), ["parent", "above", "low"])
    out = lambda n: F.when(F.col("parent").isNull(), F.col(n)).otherwise(F.col(n) * (F.col("above") - F.col("low"))).alias(n)
    return whole.select("tree", "node", *map(out, sums))


def height_slopes(placed: DataFrame, by_length: DataFrame, rate: Column | float = 1.0) -> DataFrame:
    """(tree, node, by_height) of inner nodes from slopes by branch lengths (tree, node, slope): a branch is its rate times
    the height of its parent less its own. ``placed`` has tree, node, parent, tip and what ``rate`` reads."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    own = placed.join(by_length.select("tree", "node", "slope"), ["tree", "node"]).withColumn("_s", rate * F.col("slope"))
    ends = own.select("tree", F.explode(F.array(F.struct("node", (-F.col("_s")).alias("s")), F.struct(F.col("parent").alias("node"), F.col("_s").alias("s")))).alias("e"))
    sums = ends.select("tree", "e.node", "e.s").where("node is not null").groupBy("tree", "node").agg(F.sum("s").alias("by_height"))
    return placed.where("not tip").select("tree", "node").join(sums, ["tree", "node"])


def roots_on_branches(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """(tree, node, share, distance, sse, r, slope, intercept): the best place of a root on the branch above every node.

    ``dates`` is (node, date) of the tips; tips without a date are left out. Of the tips on either side of a branch, the
    count and the sums of dates, distances, their squares and products come from two sweeps: from the tips up for the side
    below, and from the root down for the side above, where a step to a child adds the subtrees beside it. With the root at
    x from the lower end, distances are those below plus x and those above plus length - x, so that the residual of their
    regression on the dates is a parabola in x, whose least value in the branch is closed. ``distance`` is x, ``share`` x over
    the length. Where the residual does not depend on x (under three dated tips, or all on one side) x is the middle.
    Equal residuals are all kept; order by sse to rank. Trees that fit in a task are dealt out by tree once and worked out
    whole; the others go by the two sweeps."""
    dates = dates.select("node", F.col("date").cast("double").alias("date"))
    small, large = G.parted(edges)
    dated = small.select("tree", "child", "parent", F.col("length").cast("double").alias("length")).join(dates.withColumnRenamed("node", "child"), "child", "left").select("tree", "child", "parent", "length", "date")
    keys = ", ".join(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in (("tree", "tree"), ("node", "child")))
    sums = G.by_tree(dated, _side_sums, f"{keys}, length double, " + ", ".join(f"{s}_{k} double" for s in "au" for k in SIDE))
    if large is not None:
        sums = sums.union(_swept_side_sums(large, dates))
    return _best_places(sums)


#: Of the dated tips on one side of a branch, seen from its end: their number, the sums of distances and dates, of squares and products.
SIDE = ["n", "d", "dd", "t", "tt", "td"]


def _side_sums(table: pa.Table) -> pa.Table:
    """(tree, node, length, a_..., u_...): the sums above and below every branch of whole trees."""
    grove = G.Grove(table)
    up, filled = grove.up, lambda x: np.where(np.isnan(x), 0.0, x)
    length = np.where(up >= 0, filled(grove.values("length", 0.0)), 0.0)
    far, seen = grove.sink(length), (grove.kids == 0) & grove.present("date")
    date = np.where(seen, grove.values("date", 0.0), 0.0)
    brings = {"n": np.ones(len(up)), "d": far, "dd": far**2, "t": date, "tt": date**2, "td": date * far}
    low = {k: filled(grove.rise(np.where(seen, v, 0.0))) for k, v in brings.items()}
    p = np.where(up >= 0, far[up], 0.0)
    # beside a step to a child: tips below its parent and not below itself, at far(p) + far(x) - 2 far(parent) from any p further down
    n, d, dd, t, tt, td = (low[k][up] - low[k] for k in SIDE)
    a = 2 * p
    beside = {"n": n, "d": d - a * n, "dd": dd - 2 * a * d + a * a * n, "t": t, "tt": tt, "td": td - a * t}
    o = {k: grove.sink(v) for k, v in beside.items()}
    above = {"n": o["n"], "d": o["d"] + p * o["n"], "dd": o["dd"] + 2 * p * o["d"] + p * p * o["n"], "t": o["t"], "tt": o["tt"], "td": o["td"] + p * o["t"]}
    under = {"n": low["n"], "d": low["d"] - far * low["n"], "dd": low["dd"] - 2 * far * low["d"] + far * far * low["n"], "t": low["t"], "tt": low["tt"], "td": low["td"] - far * low["t"]}
    at = np.flatnonzero(up >= 0)
    rows = pa.array(grove.row[at])
    sides = {f"{s}_{k}": side[k][at] for s, side in (("a", above), ("u", under)) for k in SIDE}
    return pa.table({"tree": pc.take(table.column("tree"), rows), "node": pc.take(table.column("child"), rows), "length": length[at], **sides})


def _swept_side_sums(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """The same of trees of any size."""
    far = down(nodes_of(edges), {"far": (F.lit(1.0), F.col("length"))}, keep=["parent", "length", "_kids"])
    tipped = settled(far.join(dates, "node", "left"))
    seen = (F.col("_kids") == 0) & F.col("date").isNotNull()
    brings = {"n": F.lit(1.0), "d": F.col("far"), "dd": F.col("far") ** 2, "t": F.col("date"), "tt": F.col("date") ** 2, "td": F.col("date") * F.col("far")}
    below = settled(up(tipped, {k: ("sum", F.when(seen, v)) for k, v in brings.items()}, keep=["parent", "length", "_kids", "far"]).na.fill(0.0, list(brings)))
    over = below.where("_kids > 0").select("tree", F.col("node").alias("parent"), *[F.col(k).alias(f"p_{k}") for k in [*brings, "far"]])
    steps = settled(below.join(over.hint("merge"), ["tree", "parent"], "left").na.fill(0.0, [f"p_{k}" for k in [*brings, "far"]]))
    # beside a step from a to its child: tips below a and not below the child, at far(p) + far(x) - 2 far(a) from any p further down
    n, t, tt = (F.col(f"p_{k}") - F.col(k) for k in ("n", "t", "tt"))
    a = 2 * F.col("p_far")
    d = F.col("p_d") - F.col("d") - a * n
    dd = F.col("p_dd") - F.col("dd") - 2 * a * (F.col("p_d") - F.col("d")) + a * a * n
    td = F.col("p_td") - F.col("td") - a * t
    plus = F.lit(1.0)
    sums = down(steps, {"o_n": (plus, n), "o_d": (plus, d), "o_dd": (plus, dd), "o_t": (plus, t), "o_tt": (plus, tt), "o_td": (plus, td)}, keep=["parent", "length", "far", "p_far", *brings])
    rows = sums.where("parent is not null")
    p, v = F.col("p_far"), F.col("far")
    above = {"n": F.col("o_n"), "d": F.col("o_d") + p * F.col("o_n"), "dd": F.col("o_dd") + 2 * p * F.col("o_d") + p * p * F.col("o_n"), "t": F.col("o_t"), "tt": F.col("o_tt"), "td": F.col("o_td") + p * F.col("o_t")}
    under = {"n": F.col("n"), "d": F.col("d") - v * F.col("n"), "dd": F.col("dd") - 2 * v * F.col("d") + v * v * F.col("n"), "t": F.col("t"), "tt": F.col("tt"), "td": F.col("td") - v * F.col("t")}
    return rows.select("tree", "node", "length", *[x.alias(f"a_{k}") for k, x in above.items()], *[x.alias(f"u_{k}") for k, x in under.items()])


def _best_places(rows: DataFrame) -> DataFrame:
    """Minimise the residual of distances on dates along each branch. a_ and u_ are the sums above and below it, seen from its ends."""
    total = {k: F.col(f"a_{k}") + F.col(f"u_{k}") for k in ("n", "t", "tt")}
    length, m = F.col("length"), F.col("m")
    rows = rows.withColumns({"m": total["n"], "mt": total["t"], "mtt": total["tt"]})
    # distances are y + x s with s = 1 below and -1 above, y already holding the length above: all moments are polynomials in x
    y = F.col("u_d") + F.col("a_d") + length * F.col("a_n")
    yy = F.col("u_dd") + F.col("a_dd") + 2 * length * F.col("a_d") + length * length * F.col("a_n")
    s = F.col("u_n") - F.col("a_n")
    ys = F.col("u_d") - F.col("a_d") - length * F.col("a_n")
    ty = F.col("u_td") + F.col("a_td") + length * F.col("a_t")
    ts = F.col("u_t") - F.col("a_t")
    rows = rows.withColumns({"y": y, "yy": yy, "s": s, "ys": ys, "ty": ty, "ts": ts})
    cov = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / m
    rows = rows.withColumns({"c_tt": cov("mtt", "mt", "mt"), "c_yy": cov("yy", "y", "y"), "c_ys": cov("ys", "y", "s"), "c_ss": m - F.col("s") * F.col("s") / m, "c_ty": cov("ty", "mt", "y"), "c_ts": cov("ts", "mt", "s")})
    # residual(x) = c_yy + 2 x c_ys + x^2 c_ss - (c_ty + x c_ts)^2 / c_tt
    share = lambda a, b: F.when(F.col("c_tt") > FLAT * m, F.col(a) * F.col(b) / F.col("c_tt")).otherwise(0.0)
    rows = rows.withColumns({"r0": F.col("c_yy") - share("c_ty", "c_ty"), "r1": F.col("c_ys") - share("c_ty", "c_ts"), "r2": F.col("c_ss") - share("c_ts", "c_ts")})
    turn = F.when((m >= 3) & (F.col("u_n") > 0) & (F.col("a_n") > 0) & (F.col("r2") > FLAT * m), -F.col("r1") / F.col("r2")).otherwise(length / 2)
    x = F.least(F.greatest(turn, F.lit(0.0)), length)
    rows = rows.withColumn("x", F.when(length > 0, x).otherwise(0.0))
    x = F.col("x")
    ty, yy = F.col("c_ty") + x * F.col("c_ts"), F.col("c_yy") + 2 * x * F.col("c_ys") + x * x * F.col("c_ss")
    slope = F.when(F.col("c_tt") > FLAT * m, ty / F.col("c_tt"))
    intercept = (F.col("y") + x * F.col("s")) / m - slope * F.col("mt") / m
    sse = F.greatest(yy - F.when(F.col("c_tt") > FLAT * m, ty * ty / F.col("c_tt")).otherwise(0.0), F.lit(0.0))
    r = F.when((F.col("c_tt") > FLAT * m) & (yy > 0), ty / F.sqrt(F.col("c_tt") * yy))
    return rows.select("tree", "node", F.when(length > 0, x / length).otherwise(0.5).alias("share"), x.alias("distance"), sse.alias("sse"), r.alias("r"), slope.alias("slope"), intercept.alias("intercept"))
