"""Trees and tree collections as edge tables (tree, child, parent, length); the root's parent is null.

Path quantities use pointer doubling: each round replaces every node's jump by the jump of its target, so that the
number of joins grows with the logarithm of the depth, not with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrolith.operators.scans import settled
from dendrolith.operators.sweeps import down, nodes_of, up


def roots(edges: DataFrame) -> DataFrame:
    """(tree, node): parents that are nobody's child, or children without a parent."""
    inner = edges.where("parent is not null")
    tops = inner.select("tree", F.col("parent").alias("node")).distinct().join(inner.select("tree", F.col("child").alias("node")), ["tree", "node"], "left_anti")
    return tops


def root_paths(edges: DataFrame) -> DataFrame:
    """(tree, node, depth, distance) from the root of each node."""
    found = down(nodes_of(edges), {"depth": (F.lit(1.0), F.lit(1.0)), "distance": (F.lit(1.0), F.col("length"))})
    return found.select("tree", "node", F.col("depth").cast("long").alias("depth"), "distance")


def ancestors(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(tree, node, ancestor, steps, distance), every node included as its own ancestor at 0 steps."""
    one = edges.where("parent is not null").select("tree", F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps"), F.col("length").cast("double").alias("distance"))
    nodes = edges.select("tree", F.col("child").alias("node")).union(edges.where("parent is not null").select("tree", "parent")).distinct()
    out, reach = one, one  # pairs at 1..2^r steps, and at exactly 2^r steps
    for _ in range(max_rounds):
        reach = reach.cache()
        if reach.isEmpty():
            return nodes.select("tree", "node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("distance")).union(out)
        far = reach.select("tree", F.col("node").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("steps").alias("_s"), F.col("distance").alias("_x"))
        step = lambda left: left.join(far, ["tree", "ancestor"]).select("tree", "node", F.col("_a").alias("ancestor"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("distance") + F.col("_x")).alias("distance"))  # noqa: E731,B023
        out = out.union(step(out))
        reach = step(reach)
    raise ValueError(f"the edges have a loop, or a depth of over 2^{max_rounds}")


def tips(edges: DataFrame) -> DataFrame:
    """(tree, node) without children."""
    children = edges.select("tree", F.col("child").alias("node"))
    return children.join(edges.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")


def tip_counts(edges: DataFrame) -> DataFrame:
    """(tree, node, n_tips) of internal nodes."""
    counted = up(nodes_of(edges), {"n_tips": ("sum", (F.col("_kids") == 0).cast("long"))}, keep=["_kids"])
    return counted.where("_kids > 0").select("tree", "node", "n_tips")


def clades(edges: DataFrame) -> DataFrame:
    """(tree, node, clade): sorted tip names under each internal node."""
    up = tips(edges).join(ancestors(edges), ["tree", "node"])
    return up.where("steps > 0").groupBy("tree", F.col("ancestor").alias("node")).agg(F.concat_ws(",", F.sort_array(F.collect_list("node"))).alias("clade"))


def splits(edges: DataFrame) -> DataFrame:
    """(tree, split, length): non-trivial bipartitions, written as the side that holds the first tip."""
    names = tips(edges).groupBy("tree").agg(F.sort_array(F.collect_list("node")).alias("all"))
    under = tips(edges).join(ancestors(edges), ["tree", "node"]).groupBy("tree", F.col("ancestor").alias("child")).agg(F.sort_array(F.collect_list("node")).alias("side"))
    rows = under.join(edges.where("parent is not null"), ["tree", "child"]).join(names, "tree")
    first = F.element_at("all", 1)
    side = F.when(F.array_contains("side", first), F.col("side")).otherwise(F.array_except("all", "side"))
    kept = rows.where((F.size("side") > 1) & (F.size("side") < F.size("all") - 1))
    return kept.groupBy("tree", F.concat_ws(",", side).alias("split")).agg(F.sum("length").alias("length"))


def _split_sums(splits_: DataFrame, trees: DataFrame | None) -> DataFrame:
    """(a, b, na, nb, sa, sb, m, dot) of all pairs of trees a < b: splits, squared lengths, shared splits, their products."""
    own = splits_.groupBy("tree").agg(F.count("*").alias("n"), F.sum(F.col("length") ** 2).alias("ss"))
    if trees is not None:
        own = trees.select("tree").distinct().join(own, "tree", "left").select("tree", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ss", F.lit(0.0)).alias("ss"))
    l, r = splits_.alias("l"), splits_.alias("r")
    both = l.join(r, (F.col("l.split") == F.col("r.split")) & (F.col("l.tree") < F.col("r.tree")))
    shared = both.groupBy(F.col("l.tree").alias("a"), F.col("r.tree").alias("b")).agg(F.count("*").alias("m"), F.sum(F.col("l.length") * F.col("r.length")).alias("dot"))
    a, b = own.selectExpr("tree as a", "n as na", "ss as sa"), own.selectExpr("tree as b", "n as nb", "ss as sb")
    pairs = a.join(b, F.col("a") < F.col("b"))  # a row per pair of trees is the result
    return pairs.join(shared, ["a", "b"], "left").na.fill({"m": 0, "dot": 0.0})


def robinson_foulds(splits_: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """(a, b, rf, normalised, branch_score) of all pairs of trees; ``trees`` (tree) adds trees without inner splits."""
    n = F.col("na") + F.col("nb")
    rf = (n - 2 * F.col("m")) / 2
    score = F.sqrt(F.greatest(F.col("sa") + F.col("sb") - 2 * F.col("dot"), F.lit(0.0)))
    return _split_sums(splits_, trees).select("a", "b", rf.alias("rf"), F.when(n > 0, 2 * rf / n).otherwise(0.0).alias("normalised"), score.alias("branch_score"))


def k_tree_scores(splits_: DataFrame) -> DataFrame:
    """(a, b, k, score): the factor that brings tree b closest to tree a, and the branch score that is left."""
    k = F.when(F.col("sb") > 0, F.col("dot") / F.col("sb")).otherwise(0.0)
    left = F.sqrt(F.greatest(F.col("sa") - k * F.col("dot"), F.lit(0.0)))
    return _split_sums(splits_, None).select("a", "b", k.alias("k"), left.alias("score"))


def patristic(edges: DataFrame) -> DataFrame:
    """(tree, i, j, d): path lengths between tips, by their lowest common ancestor."""
    up = tips(edges).join(ancestors(edges), ["tree", "node"])
    depth = root_paths(edges).select("tree", F.col("node").alias("ancestor"), "depth")
    l, r = up.alias("l"), up.alias("r")
    meet = l.join(r, (F.col("l.tree") == F.col("r.tree")) & (F.col("l.ancestor") == F.col("r.ancestor")) & (F.col("l.node") < F.col("r.node")))
    rows = meet.select(F.col("l.tree").alias("tree"), F.col("l.node").alias("i"), F.col("r.node").alias("j"), F.col("l.ancestor").alias("ancestor"), (F.col("l.distance") + F.col("r.distance")).alias("d"))
    return rows.join(depth, ["tree", "ancestor"]).groupBy("tree", "i", "j").agg(F.max_by("d", "depth").alias("d"))


def subsplit_network(edges: DataFrame) -> DataFrame:
    """(parent_clade, sides, n, share): how each clade is divided, as a share of the trees that hold the clade."""
    named = clades(edges).unionByName(tips(edges).select("tree", "node", F.col("node").cast("string").alias("clade")))
    child = edges.where("parent is not null").select("tree", F.col("child").alias("node"), F.col("parent"))
    pairs = child.join(named, ["tree", "node"]).groupBy("tree", F.col("parent").alias("node")).agg(F.concat_ws("|", F.sort_array(F.collect_list("clade"))).alias("sides"))
    counted = pairs.join(named, ["tree", "node"]).groupBy("clade", "sides").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("clade")))


def lengths(edges: DataFrame, rate: str = "rate") -> DataFrame:
    """(tree, n, total, mean_rate, scaled_rate): tree length and branch-rate summaries."""
    inner = edges.where("parent is not null")
    return inner.groupBy("tree").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.avg(rate).alias("mean_rate"), (F.sum(F.col(rate) * F.col("length")) / F.sum("length")).alias("scaled_rate"))


def heights(edges: DataFrame) -> DataFrame:
    """(tree, node, height): the distance below which the farthest tip lies."""
    paths = root_paths(edges)
    top = paths.groupBy("tree").agg(F.max("distance").alias("_top"))
    return paths.join(top, "tree").select("tree", "node", (F.col("_top") - F.col("distance")).alias("height"))


def lower_bounds(edges: DataFrame, heights_: DataFrame) -> DataFrame:
    """(tree, node, lower): the height of the latest tip under each internal node."""
    up = tips(edges).join(ancestors(edges), ["tree", "node"]).where("steps > 0")
    return up.join(heights_, ["tree", "node"]).groupBy("tree", F.col("ancestor").alias("node")).agg(F.max("height").alias("lower"))


def height_bounds(edges: DataFrame, heights_: DataFrame) -> DataFrame:
    """(tree, node, bound): the greatest height of a node's children."""
    kids = edges.where("parent is not null").select("tree", F.col("child").alias("node"), "parent")
    return kids.join(heights_, ["tree", "node"]).groupBy("tree", F.col("parent").alias("node")).agg(F.max("height").alias("bound"))


def log_jacobian(edges: DataFrame, heights_: DataFrame) -> DataFrame:
    """(tree, lj): of the transform from height ratios, over internal nodes but the root."""
    bounds = lower_bounds(edges, heights_)
    parents = edges.where("parent is not null").select("tree", F.col("child").alias("node"), F.col("parent"))
    parent_height = heights_.select("tree", F.col("node").alias("parent"), F.col("height").alias("_h"))
    return bounds.join(parents, ["tree", "node"]).join(parent_height, ["tree", "parent"]).groupBy("tree").agg(F.sum(F.log(F.col("_h") - F.col("lower"))).alias("lj"))


def check(edges: DataFrame) -> DataFrame:
    """(tree, n_roots, n_many_parents, n_loops): zero faults means one root, one parent each and no loops."""
    inner = edges.where("parent is not null")
    many = inner.groupBy("tree", "child").agg(F.count("*").alias("n")).groupBy("tree").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_many_parents"), F.sum(F.lit(0)).alias("_"))
    loops = inner.groupBy("tree").agg(F.sum((F.col("child") == F.col("parent")).cast("long")).alias("n_loops"))
    return roots(edges).groupBy("tree").agg(F.count("*").alias("n_roots")).join(many.drop("_"), "tree").join(loops, "tree")


def rate_correlation(edges: DataFrame, rate: str = "rate") -> DataFrame:
    """(tree, n, correlation) between the rates of branches and of the branches above them."""
    inner = edges.where("parent is not null")
    above = inner.select("tree", F.col("child").alias("parent"), F.col(rate).alias("_above"))
    return inner.join(above, ["tree", "parent"]).groupBy("tree").agg(F.count("*").alias("n"), F.corr(rate, "_above").alias("correlation"))


def inherited_rates(edges: DataFrame, own: DataFrame, root_rate: float) -> DataFrame:
    """(tree, node, rate): local clocks, a node's own rate (tree, node, rate) or that of the nearest ancestor with one."""
    given = settled(nodes_of(edges).join(own.select("tree", "node", F.col("rate").cast("double").alias("_r")), ["tree", "node"], "left"))
    slope = F.when(F.col("_r").isNull(), 1.0).otherwise(0.0)
    return down(given, {"rate": (slope, F.coalesce("_r", F.lit(0.0)))}, {"rate": F.coalesce("_r", F.lit(float(root_rate)))})


def node_by_name(edges: DataFrame, name: str) -> DataFrame:
    """The edges above the nodes of that name."""
    return edges.where(F.col("child") == name)


def scaled(edges: DataFrame, factor: float) -> DataFrame:
    return edges.withColumn("length", F.col("length") * factor)


def dated_heights(tips_: DataFrame, date: str) -> DataFrame:
    """(tree, node, height) of dated tips: the latest date minus the own."""
    return tips_.select("tree", "node", (F.max(date).over(Window.partitionBy("tree")) - F.col(date)).alias("height"))
