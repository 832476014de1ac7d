"""Consensus trees and pruned trees: collections of trees as relations of clades and edges.

A clade is a set of taxa of fixed width (``sweeps.clade_bits``). Its weight is the share, or the sum of the weights, of
the trees that hold it. Two clades are compatible if one holds the other or they share no taxon.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrolith.operators import groves as G
from dendrolith.operators.scans import settled
from dendrolith.operators.sweeps import MOST_ROUNDS, clade_bits, nodes_of, up


def weights(clades: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """(bits, n, weight, trees): the weight of every clade of clades (tree, bits, n), a tree counting once, and the trees with it.

    ``trees`` (tree, weight) gives trees weights, as a model average does; they are brought to a sum of one. A tree without
    clades counts in that sum; without ``trees`` every tree of ``clades`` weighs the same."""
    held = clades.select("tree", "bits", "n").distinct()
    if trees is None:
        trees = held.select("tree").distinct().withColumn("weight", F.lit(1.0))
    return _shares(_sums(held, trees), trees)


def _sums(held: DataFrame, trees: DataFrame) -> DataFrame:
    # trees are many: the planner is kept from sending them to the driver and every task
    return held.join(trees.select("tree", "weight").hint("merge"), "tree").groupBy("bits", "n").agg(F.sum("weight").alias("weight"), F.count("*").alias("trees"))


def _shares(sums: DataFrame, trees: DataFrame) -> DataFrame:
    total = trees.agg(F.sum("weight").alias("_total"))
    return sums.crossJoin(total).select("bits", "n", (F.col("weight") / F.col("_total")).alias("weight"), "trees")  # one row


def clade_weights(edges: DataFrame, taxa: DataFrame, words: int, trees: DataFrame | None = None, fewest: int = 1) -> DataFrame:
    """``weights`` of the clades of at least ``fewest`` taxa of a collection of trees (tree, child, parent).

    ``taxa`` and ``words`` are those of ``clade_bits``. Edges and weights are dealt out by tree once, a task sums the clades of
    its trees, and only sums go on; trees too large for a task go by ``clade_bits``. Without ``trees`` every tree weighs the same."""
    small, large = G.parted(edges)
    rows = G.weighted(G.placed(small, taxa), trees)
    found = G.by_tree(rows, _clades_held(words, fewest), G.sets_schema(["bits"], words, "weight double, trees long"))
    if trees is None:
        trees = edges.select("tree").distinct().withColumn("weight", F.lit(1.0))
    size = F.aggregate("bits", F.lit(0), lambda n, b: n + F.bit_count(b)).cast("long")
    sums = G.gathered(found, ["bits"], words, ["weight", "trees"]).select("bits", size.alias("n"), "weight", "trees")
    if large is not None:
        held = clade_bits(large, taxa, words).where(F.col("n") >= fewest).select("tree", "bits", "n").distinct()
        sums = sums.union(_sums(held, trees)).groupBy("bits", "n").agg(F.sum("weight").alias("weight"), F.sum("trees").alias("trees"))
    return _shares(sums, trees)


def _clades_held(words: int, fewest: int) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        grove = G.Grove(table)
        sets = grove.sets(words)
        weight, times = G.weights_in(grove)
        kept = (G.sizes_of(sets) >= fewest) & (times[grove.tree] > 0)
        once = G.summed({"tree": grove.tree[kept, None], "bits": sets[kept]}, {})
        tree = once.column("tree_0").to_numpy()
        bits = np.stack([once.column(f"bits_{w}").to_numpy() for w in range(words)], axis=1)
        return G.summed({"bits": bits}, {"weight": weight[tree], "trees": times[tree]})

    return work


def conflict(a: Column, b: Column) -> Column:
    """Whether two sets overlap and neither holds the other."""
    both = F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    some = F.exists(both, lambda x: x != 0)
    return some & (both != a) & (both != b)


def places(bits: str = "bits") -> Column:
    """The places of a set, from 0."""
    own = lambda b, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda j: F.when(F.getbit(b, j) == 1, i * 63 + j)), lambda p: p.isNotNull())
    return F.flatten(F.transform(bits, own))


def greedy(weighted: DataFrame, least: float = 0.0) -> DataFrame:
    """(bits, n, weight): clades taken by weight, the largest first, while they are compatible with those taken before.

    Ties go by the bits. Clades of over half the weight are compatible with each other and need no comparison. The others
    are decided in rounds that are the same as one after the other: a clade is taken once nothing heavier that it conflicts
    with is open, and what conflicts with a taken one is out. Conflicting pairs meet on a taxon that both hold."""
    ranked = settled(weighted.where(F.col("weight") > least).select("bits", "n", "weight"))
    listed = ranked.withColumn("taxon", F.explode(places()))
    a = listed.select(F.col("taxon"), F.col("bits").alias("a"), F.col("weight").alias("wa"))
    b = listed.select(F.col("taxon"), F.col("bits").alias("b"), F.col("weight").alias("wb"))
    heavier = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b")))
    # two clades of over half the weight stand in one tree together, hence never conflict
    pairs = settled(a.join(b, "taxon").where(heavier & (F.col("wb") <= 0.5) & conflict(F.col("a"), F.col("b"))).select("a", "b").distinct())
    open_, taken = ranked, None
    for _ in range(MOST_ROUNDS * 1024):
        blocked = pairs.select(F.col("b").alias("bits")).distinct()
        now = settled(open_.join(blocked, "bits", "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
        out = pairs.join(now.select(F.col("bits").alias("a")), "a", "left_semi").select(F.col("b").alias("bits")).distinct()
        open_ = settled(open_.join(now.select("bits"), "bits", "left_anti").join(out, "bits", "left_anti"))
        pairs = pairs.join(open_.select(F.col("bits").alias("a")), "a", "left_semi").join(open_.select(F.col("bits").alias("b")), "b", "left_semi")
        pairs = settled(pairs)
        if open_.isEmpty():
            return taken
    raise RuntimeError("clades are left undecided")


def tree_of(clades: DataFrame, taxa: DataFrame) -> DataFrame:
    """(bits, n, parent): compatible clades and single taxa (name, at), each with the least clade that holds it.

    Clades that hold a taxon are nested, so that its clades in the order of size are a path; neighbours on it are child and
    parent. A clade is seen from each of its taxa, and asks for its parent from one."""
    own = clades.select("bits", "n")
    wide = own.agg(F.max(F.size("bits")).alias("w"))
    single = taxa.crossJoin(wide).select(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.when(F.floor(F.col("at") / 63) == i, F.expr("shiftleft(1L, cast(at % 63 as int))")).otherwise(F.lit(0).cast("long"))).alias("bits"), F.lit(1).cast("long").alias("n"))  # one row
    every = settled(own.union(single.join(own.select("bits"), "bits", "left_anti")))
    ask = every.select("bits", "n", F.array_min(places()).alias("taxon"))
    hold = every.withColumn("taxon", F.explode(places())).select("taxon", F.col("bits").alias("parent"), F.col("n").alias("m"))
    above = ask.join(hold, "taxon").where(F.col("m") > F.col("n")).groupBy("bits", "n").agg(F.min_by("parent", "m").alias("parent"))
    return every.join(above, ["bits", "n"], "left").select("bits", "n", "parent")


def pruned(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(tree, child, parent, length) of the trees over the tips kept (node), or (tree, node) where trees keep different ones.

    Nodes without a kept tip go; of the others those with one child go too, and their branches are added up: each node asks
    the node above, which asks on while it is one to go, by pointer doubling along such chains only. The root stays the
    highest node with two children. A tree with fewer than two kept tips has no edges."""
    by = [c for c in ("tree", "node") if c in kept.columns]
    marked = settled(nodes_of(edges).join(kept.select(*by).distinct().withColumn("_kept", F.lit(1).cast("long")).hint("merge"), by, "left"))
    held = up(marked, {"k": ("sum", F.when(F.col("_kids") == 0, F.col("_kept")))}, keep=["parent", "length", "_kids"]).where("k > 0")
    held = settled(held)
    kids = held.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_alive"))
    stays = (F.col("_kids") == 0) | (F.coalesce("_alive", F.lit(0)) >= 2)
    alive = settled(held.join(kids.hint("merge"), ["tree", "node"], "left").select("tree", "node", F.col("parent").alias("jump"), "length", stays.alias("stays")))

    def beyond(rows: DataFrame) -> DataFrame:
        """``rows`` with what lies beyond the node above, where that one is to go."""
        far = chain.select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("length").alias("_length"), F.lit(True).alias("_on"))
        joined = rows.join(far.hint("merge"), ["tree", "jump"], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
        return joined.select("tree", "node", F.when(F.col("_on"), F.col("_jump")).otherwise(F.col("jump")).alias("jump"), (F.col("length") + F.coalesce("_length", F.lit(0.0))).alias("length"), "_on")

    chain = alive.where("not stays").select("tree", "node", "jump", "length")
    for _ in range(MOST_ROUNDS):
        longer = settled(beyond(chain))
        chain = longer.drop("_on")
        if longer.where("_on").isEmpty():
            return beyond(alive.where("stays")).where("jump is not null").select("tree", F.col("node").alias("child"), F.col("jump").alias("parent"), "length")
    raise ValueError("the edges have a loop")
