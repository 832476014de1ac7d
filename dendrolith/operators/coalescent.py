"""Coalescent likelihoods as windows over ordered events.

Events are rows (tree, t, kind): a sampling event adds a lineage, a coalescence removes one, a grid point changes
nothing. ``intervals`` orders them once per tree; every likelihood is a sum over its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLING, COALESCENCE, GRID = "s", "c", "g"


def intervals(events: DataFrame, tree: str = "tree", order: Sequence[str] = ("id",)) -> DataFrame:
    """Adds dt, k (lineages before the event), n_coal and n_grid (events of the kind passed before)."""
    w = Window.partitionBy(tree).orderBy("t", *order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(before), F.lit(0))
    dt = F.col("t") - F.coalesce(F.lag("t").over(w), F.col("t"))
    n_s, n_c = count(SAMPLING), count(COALESCENCE)
    return events.withColumns({"dt": dt, "k": (n_s - n_c).cast("long"), "n_coal": n_c.cast("long"), "n_grid": count(GRID).cast("long")})


def pairs() -> Column:
    return F.col("k") * (F.col("k") - 1) / 2


def is_coal() -> Column:
    return F.col("kind") == COALESCENCE


def total(rows: DataFrame, term: Column, tree: str = "tree") -> DataFrame:
    return rows.groupBy(tree).agg(F.sum(term).alias("lp"))


def constant(rows: DataFrame, theta: float, tree: str = "tree") -> DataFrame:
    return total(rows, -pairs() * F.col("dt") / theta - F.when(is_coal(), F.log(F.lit(theta))).otherwise(0.0), tree)


def exponential(rows: DataFrame, n0: float, rate: float, tree: str = "tree") -> DataFrame:
    """Population n0 exp(-rate t)."""
    start = F.col("t") - F.col("dt")
    area = (F.exp(F.col("t") * rate) - F.exp(start * rate)) / (n0 * rate) if rate else F.col("dt") / n0
    return total(rows, -pairs() * area - F.when(is_coal(), F.log(F.lit(n0)) - F.col("t") * rate).otherwise(0.0), tree)


def classical_skyline(rows: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, n_coal, theta, lp) of every interval that ends in a coalescence: its own best population size."""
    per = rows.groupBy(tree, "n_coal").agg(F.sum(pairs() * F.col("dt")).alias("theta"), F.max(is_coal().cast("int")).alias("ends"))
    return per.where("ends = 1 and theta > 0").select(tree, "n_coal", "theta", (-1 - F.log("theta")).alias("lp"))


def piecewise(rows: DataFrame, sizes: Sequence[float], bin_: Column, tree: str = "tree", log_space: bool = False) -> DataFrame:
    """Population size by bin; bins beyond the last stay there. The simultaneous first events add nothing."""
    values = F.lit([float(s) for s in sizes]).cast("array<double>")
    own = F.element_at(values, F.least(bin_.cast("int"), F.lit(len(sizes) - 1)) + 1)
    size = F.exp(own) if log_space else own
    return total(rows, -pairs() * F.col("dt") / size - F.when(is_coal(), F.log(size)).otherwise(0.0), tree)


def skyride(rows: DataFrame, sizes: Sequence[float], tree: str = "tree", log_space: bool = False) -> DataFrame:
    """A size per coalescence."""
    return piecewise(rows, sizes, F.col("n_coal"), tree, log_space)


def skyline(rows: DataFrame, sizes: Sequence[float], groups: Sequence[int], tree: str = "tree") -> DataFrame:
    """A size per group of consecutive coalescences."""
    bounds, passed = [], 0
    for g in groups:
        passed += g
        bounds.append(passed)
    bin_ = sum(((F.col("n_coal") >= b).cast("int") for b in bounds[:-1]), F.lit(0))
    return piecewise(rows, sizes, bin_, tree)


def grid_events(events: DataFrame, cutoff: float, n_sizes: int, tree: str = "tree") -> DataFrame:
    """Events with the grid points cutoff * i / (n_sizes - 1), i = 1.. n_sizes - 1, added to every tree."""
    points = F.explode(F.lit([cutoff * i / (n_sizes - 1) for i in range(1, n_sizes)]).cast("array<double>")).alias("t")
    grid = events.select(tree).distinct().select(tree, points).withColumns({"kind": F.lit(GRID), "id": F.lit(1 << 40).cast("long")})
    return events.select(tree, "t", "kind", "id").unionByName(grid)


def skygrid(events: DataFrame, sizes: Sequence[float], cutoff: float, tree: str = "tree", log_space: bool = False) -> DataFrame:
    rows = intervals(grid_events(events, cutoff, len(sizes), tree), tree)
    return piecewise(rows, sizes, F.col("n_grid"), tree, log_space)


def piecewise_linear(events: DataFrame, sizes: Sequence[float], cutoff: float, tree: str = "tree") -> DataFrame:
    """Population size linear between grid points, constant after the last."""
    rows = intervals(grid_events(events, cutoff, len(sizes), tree), tree)
    step = cutoff / (len(sizes) - 1)
    values = F.lit([float(s) for s in sizes]).cast("array<double>")
    last = len(sizes) - 1
    i = F.least(F.col("n_grid").cast("int"), F.lit(last))
    low, high = F.element_at(values, i + 1), F.element_at(values, F.least(i + 2, F.lit(last + 1)))
    at = lambda t: F.when(i >= last, F.element_at(values, -1)).otherwise(low + (high - low) * (t - i * step) / step)
    end, start = at(F.col("t")), at(F.col("t") - F.col("dt"))
    flat = F.abs(end - start) < 1e-12
    area = F.when(flat, F.col("dt") / end).otherwise(F.col("dt") * (F.log(end) - F.log(start)) / F.when(flat, 1.0).otherwise(end - start))
    return total(rows, -pairs() * area - F.when(is_coal(), F.log(end)).otherwise(0.0), tree)


def lineages(events: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, t, k): lineages just after each event."""
    w = Window.partitionBy(tree).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("kind") == SAMPLING, 1).when(F.col("kind") == COALESCENCE, -1).otherwise(0)
    return events.select(tree, "t", "id", F.sum(sign).over(w).alias("k"))


def constant_gradient(rows: DataFrame, theta: float, tree: str = "tree") -> DataFrame:
    """(tree, slope): derivative of the constant population's log density by theta."""
    return total(rows, pairs() * F.col("dt") / theta**2 - F.when(is_coal(), 1 / theta).otherwise(0.0), tree).withColumnRenamed("lp", "slope")


def piecewise_gradient(rows: DataFrame, sizes: Sequence[float], bin_: Column, tree: str = "tree") -> DataFrame:
    """(tree, bin, slope): derivative by the size of each bin that events fall in; bins beyond the last stay there."""
    own = F.least(bin_, F.lit(len(sizes) - 1)).cast("int")
    size = F.element_at(F.lit([float(x) for x in sizes]).cast("array<double>"), F.col("bin") + 1)
    slope = pairs() * F.col("dt") / size**2 - F.when(is_coal(), 1 / size).otherwise(0.0)
    return rows.withColumn("bin", own).groupBy(tree, "bin").agg(F.sum(slope).alias("slope"))
