"""Pairwise distances and population-genetic summaries over site patterns.

Pairs of taxa are generated inside each distinct pattern and summed with the pattern's weight. That needs no join; the
partial sums have one row per pair of taxa in each task, whatever the number of sites.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SATURATED = 1000.0


def pair_counts(patterns: DataFrame, n_taxa: int, states: str = "ACGT") -> DataFrame:
    """(i, j, n, diff, ts, tv) over taxon indexes i < j: comparable sites, differences, transitions and transversions."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(n_taxa - 1)))
    left = patterns.select("pattern", "weight", ends.alias("i")).where(F.col("i") < n_taxa - 1)
    pairs = left.select("weight", "pattern", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(n_taxa - 1))).alias("j"))
    both = pairs.select("i", "j", "weight", F.substring("pattern", F.col("i") + 1, F.lit(1)).alias("a"), F.substring("pattern", F.col("j") + 1, F.lit(1)).alias("b"))
    known = both.where(F.lit(states).contains(F.col("a")) & F.lit(states).contains(F.col("b")))
    differ = F.col("a") != F.col("b")
    transition = F.concat(F.least("a", "b"), F.greatest("a", "b")).isin("AG", "CT")
    total = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0)).cast("long")
    return known.groupBy("i", "j").agg(F.sum("weight").cast("long").alias("n"), total(differ).alias("diff"), total(differ & transition).alias("ts"), total(differ & ~transition).alias("tv"))


def p_distance() -> Column:
    return F.when(F.col("n") > 0, F.col("diff") / F.col("n")).otherwise(F.lit(SATURATED))


def jc69_distance() -> Column:
    p = p_distance()
    return F.when((F.col("n") > 0) & (p < 0.75), -0.75 * F.log(1 - 4 * p / 3)).otherwise(F.lit(SATURATED))


def k2p_distance() -> Column:
    p, q = F.col("ts") / F.col("n"), F.col("tv") / F.col("n")
    a, b = 1 - 2 * p - q, 1 - 2 * q
    return F.when((a > 0) & (b > 0), -0.5 * F.log(a) - 0.25 * F.log(b)).otherwise(F.lit(SATURATED))


def kimura_protein_distance() -> Column:
    p = p_distance()
    inside = 1 - p - 0.2 * p * p
    return F.when((F.col("n") > 0) & (inside > 0), -F.log(inside)).otherwise(F.lit(SATURATED))


MODELS = {"raw": p_distance, "jc69": jc69_distance, "k2p": k2p_distance, "kimura": kimura_protein_distance}


def distances(patterns: DataFrame, n_taxa: int, model: str = "jc69", states: str = "ACGT") -> DataFrame:
    """(i, j, n, diff, d)."""
    return pair_counts(patterns, n_taxa, states).select("i", "j", "n", "diff", MODELS[model]().alias("d"))


def hamming(patterns: DataFrame, n_taxa: int) -> DataFrame:
    """Share of sites whose characters differ, gaps included."""
    counted = pair_counts(patterns, n_taxa, "ACGTRYMWSKBDHVN?-")
    return counted.select("i", "j", (F.col("diff") / F.col("n")).alias("d"))


def nearest_pair(distance: DataFrame) -> DataFrame:
    """The closest pair; the first in index order wins a tie."""
    return distance.agg(F.min(F.struct("d", "i", "j")).alias("m")).select("m.i", "m.j", "m.d")


def ts_tv(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("ts").cast("long").alias("ts"), F.sum("tv").cast("long").alias("tv")).withColumn("ratio", F.col("ts") / F.col("tv"))


def kappa(counts: DataFrame, freqs: DataFrame) -> DataFrame:
    """Transition/transversion rate ratio from the counts and the state frequencies; both sides are one row."""
    f = freqs.agg(*[F.sum(F.when(F.col("state") == s, F.col("freq")).otherwise(0.0)).alias(s) for s in "ACGT"])
    factor = (F.col("A") + F.col("G")) * (F.col("C") + F.col("T")) / (F.col("A") * F.col("G") + F.col("C") * F.col("T"))
    return ts_tv(counts).crossJoin(F.broadcast(f)).select("ts", "tv", "ratio", (F.col("ratio") * factor).alias("kappa"))


def unordered_pairs(patterns: DataFrame, n_taxa: int) -> DataFrame:
    """(pair, n): how often each unordered pair of different states is seen over all pairs of taxa."""
    ends = patterns.select("pattern", "weight")
    each = [F.length(F.col("pattern")) - F.length(F.regexp_replace("pattern", s, "")) for s in "ACGT"]
    counted = ends.select("weight", *[c.cast("long").alias(s) for c, s in zip(each, "ACGT", strict=True)])
    names = ["AC", "AG", "AT", "CG", "CT", "GT"]
    sums = counted.agg(*[F.sum(F.col(n[0]) * F.col(n[1]) * F.col("weight")).cast("long").alias(n) for n in names])
    return sums.unpivot([], names, "pair", "n")


def relative_rates(pairs: DataFrame) -> DataFrame:
    """Counts relative to the GT pair."""
    base = pairs.agg(F.sum(F.when(F.col("pair") == "GT", F.col("n")).otherwise(0)).alias("gt"))
    return pairs.join(base).select("pair", "n", (F.col("n") / F.col("gt")).alias("rate"))


def diversity(counts: DataFrame) -> DataFrame:
    """Mean number of differences over all pairs."""
    return counts.agg(F.avg("diff").alias("pi"))


def minor_counts() -> Column:
    """Count of the second most frequent resolved state of a pattern."""
    n = [F.length("pattern") - F.length(F.regexp_replace("pattern", s, "")) for s in "ACGT"]
    return F.element_at(F.sort_array(F.array(*n), asc=False), 2)


def segregating(patterns: DataFrame) -> DataFrame:
    minor = minor_counts()
    total = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0)).cast("long")
    return patterns.agg(total(minor > 0).alias("s"), total(minor == 1).alias("singletons"))


def constants(n: int) -> dict[str, float]:
    """Harmonic constants of the neutrality statistics."""
    a1 = sum(1 / i for i in range(1, n))
    a2 = sum(1 / i**2 for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    cn = 1.0 if n == 2 else 2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2))
    an1 = a1 + 1 / n
    dn = cn + (n - 2) / (n - 1) ** 2 + 2 / (n - 1) * (1.5 - (2 * an1 - 3) / (n - 2) - 1 / n)
    v = ((n / (n - 1)) ** 2 * a2 + a1**2 * dn - 2 * n * a1 * (a1 + 1) / (n - 1) ** 2) / (a1**2 + a2)
    u = n / (n - 1) * (a1 - n / (n - 1)) - v
    vf = (dn + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1) * (4 * a2 - 6 + 8 / n)) / (a1**2 + a2)
    uf = (n / (n - 1) + (n + 1) / (3 * (n - 1)) - 2 * 2 / (n * (n - 1)) + 2 * (n + 1) / (n - 1) ** 2 * (an1 - 2 * n / (n + 1))) / a1 - vf
    return {"a1": a1, "e1": c1 / a1, "e2": c2 / (a1**2 + a2), "u": u, "v": v, "uf": uf, "vf": vf}


def tajima(counts: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """pi, S, Watterson's theta and Tajima's D."""
    k = constants(n)
    both = diversity(counts).join(segregating(patterns))
    theta = F.col("s") / k["a1"]
    return both.select("pi", "s", theta.alias("theta"), ((F.col("pi") - theta) / F.sqrt(k["e1"] * F.col("s") + k["e2"] * F.col("s") * (F.col("s") - 1))).alias("d"))


def fu_li(counts: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Fu and Li's D* and F*."""
    k = constants(n)
    both = diversity(counts).join(segregating(patterns))
    s, one = F.col("s"), F.col("singletons")
    ratio = n / (n - 1)
    d = (ratio * s - k["a1"] * one) / F.sqrt(k["u"] * s + k["v"] * s * s)
    f = (F.col("pi") - (n - 1) / n * one) / F.sqrt(k["uf"] * s + k["vf"] * s * s)
    return both.select("s", "singletons", d.alias("d_star"), f.alias("f_star"))


def rank_nearest(distance: DataFrame) -> DataFrame:
    """Each taxon's nearest other taxon."""
    both = distance.select("i", "j", "d").union(distance.select("j", "i", "d"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where("r = 1").drop("r")


def standard_error(p: float, n: int) -> float:
    """Binomial standard error of a p-distance."""
    return sqrt(p * (1 - p) / n)
