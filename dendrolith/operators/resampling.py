"""Bootstrap, jackknife and their intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrolith.functions.special import pnorm, qnorm
from dendrolith.operators.scans import ranked, settled


#: P(X <= k) of a Poisson variable with mean one.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)]))
#: The same as digests: a digest is under one of them if its uniform number is under that number, which 48 bits hold exactly.
BOUNDS = [format(int(np.ceil(p * (1 << 48))), "012x") for p in POISSON]


def digest(seed: int, *keys: Column) -> Column:
    """Twelve hexadecimal digits of the keys, the same on every engine."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 12)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the digest of the keys, the same on every engine."""
    return F.conv(digest(seed, *keys), 16, 10).cast("long") / float(1 << 48)


def poisson_draw(u: Column, bounds: Sequence[float] | Sequence[str] = tuple(POISSON.tolist())) -> Column:
    """Poisson(1) by inversion of a uniform number or, with ``BOUNDS``, of a digest."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out.cast("long")


def drawn(rows: DataFrame, seed: int, *keys: Column) -> DataFrame:
    """``rows`` with ``_w``, a Poisson(1) draw by the digest of the keys, where it is not 0.

    The digest comes out of a generator, so that it is worked out once a row: a plain column is put into the filter, each
    comparison and each sum that use it, and worked out anew there."""
    each = rows.withColumn("_d", F.explode(F.array(digest(seed, *keys)))).where(F.col("_d") >= BOUNDS[0])
    return each.withColumn("_w", poisson_draw(F.col("_d"), BOUNDS)).drop("_d")


def bootstrap_weights(patterns: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, pattern, weight): site weights of bootstrap replicates.

    Each site is drawn Poisson(1) times by the digest of pattern, number and replicate, so that replicates need no total
    and no order; a replicate's number of sites is Poisson distributed about the alignment's.
    """
    sites = patterns.select("pattern", F.explode(F.sequence(F.lit(1).cast("long"), F.col("weight").cast("long"))).alias("k"))
    each = sites.select("pattern", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return drawn(each, seed, F.col("replicate"), F.col("pattern"), F.col("k")).groupBy("replicate", "pattern").agg(F.sum("_w").alias("weight"))


def jackknife_sites(columns: DataFrame, share: float, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, site, pattern): each replicate deletes about ``share`` of the sites by a seeded digest."""
    each = columns.select("site", "pattern", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return each.where(uniform(seed, F.col("replicate"), F.col("site")) >= share).select("replicate", "site", "pattern")


def normal_interval(theta: np.ndarray, estimate: float, alpha: float = 0.05) -> tuple[float, float]:
    half = qnorm(1 - alpha / 2) * float(np.std(theta, ddof=1))
    return estimate - half, estimate + half


def bca_interval(jackknife: np.ndarray, boot: np.ndarray, estimate: float, alpha: float = 0.05, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Bias-corrected and accelerated percentiles; ``weights`` count the sites behind each jackknife value."""
    boot = np.sort(boot)
    w = np.ones(len(jackknife)) if weights is None else np.asarray(weights, dtype=float)
    z0 = qnorm(min(max(float((boot < estimate).mean()), 1e-9), 1 - 1e-9))
    d = np.average(jackknife, weights=w) - jackknife
    a = float((w * d**3).sum() / (6 * (w * d**2).sum() ** 1.5)) if (d != 0).any() else 0.0
    out = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + qnorm(q)
        p = pnorm(z0 + z / (1 - a * z))
        out.append(float(boot[min(len(boot) - 1, max(0, int(np.ceil(p * len(boot))) - 1))]))
    return out[0], out[1]


def bca_intervals(boot: DataFrame, jackknife: DataFrame, estimates: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(by, z0, acceleration, low, high): bias-corrected and accelerated intervals of many groups, as ``bca_interval``.

    ``boot`` has (by, value) replicates, ``jackknife`` (by, value, weight) leave-one-out values with the number of rows behind
    each, ``estimates`` (by, value). Acceleration comes from sums of powers about the weighted mean; the quantiles of the
    replicates from their counted ranks. Nothing but the groups' few numbers is ever in one place."""
    by = list(by)
    boot = settled(boot.select(*by, "value"))  # read for the shares, for the ranks' ranges and for the ranks: drawn once
    means = jackknife.groupBy(*by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("_m"))
    d = F.col("_m") - F.col("value")
    powers = jackknife.join(means, by).groupBy(*by).agg(F.sum(F.col("weight") * d**2).alias("_two"), F.sum(F.col("weight") * d**3).alias("_three"))
    a = F.when(F.col("_two") > 0, F.col("_three") / (6 * F.col("_two") ** 1.5)).otherwise(0.0)
    counted = boot.join(estimates.select(*by, F.col("value").alias("_e")), by).groupBy(*by).agg(F.count("*").alias("_n"), F.avg((F.col("value") < F.col("_e")).cast("double")).alias("_p"))
    rows = counted.join(powers.select(*by, a.alias("acceleration")), by)
    share = F.least(F.greatest(F.col("_p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = rows.withColumn("z0", normal_quantile(share))
    for name, q in (("_low", alpha / 2), ("_high", 1 - alpha / 2)):
        z = F.col("z0") + float(qnorm(q))
        p = normal_probability(F.col("z0") + z / (1 - F.col("acceleration") * z))
        rows = rows.withColumn(name, F.least(F.greatest(F.ceil(p * F.col("_n")), F.lit(1)), F.col("_n")))
    ranks = ranked(boot, by, ["value"], "_rank").join(rows, by)
    at = lambda c: F.max(F.when(F.col("_rank") == F.col(c), F.col("value")))
    return ranks.groupBy(*by, "z0", "acceleration").agg(at("_low").alias("low"), at("_high").alias("high"))


def normal_probability(x: Column) -> Column:
    """P(Z <= x), from the series of the integral of the density about zero; beyond 6.5 it is 0 or 1 to ten digits."""
    near = F.least(F.greatest(x, F.lit(-6.5)), F.lit(6.5))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(near.alias("term"), near.alias("sum")), lambda acc, k: F.struct((acc["term"] * near * near / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * near * near / (2 * k + 1)).alias("sum")))
    return 0.5 + terms["sum"] * F.exp(-near * near / 2) / float(np.sqrt(2 * np.pi))


def normal_quantile(p: Column, halvings: int = 50) -> Column:
    """The x with P(Z <= x) = p, by halving [-6.5, 6.5]."""
    start = F.struct(F.lit(-6.5).alias("low"), F.lit(6.5).alias("high"))

    def half(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        under = normal_probability(middle) < p
        return F.struct(F.when(under, middle).otherwise(acc["low"]).alias("low"), F.when(under, acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, half)
    return (found["low"] + found["high"]) / 2


def leave_one_out_means(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, weight): the mean without one of the rows of each value, and how many rows have that value."""
    by = list(by)
    totals = df.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    kinds = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("weight"))
    return kinds.join(totals.where("_n > 1"), by).select(*by, ((F.col("_s") - F.col("_v")) / (F.col("_n") - 1)).alias("value"), "weight")


def bootstrap_means(df: DataFrame, by: str, value: str, replicates: int, seed: int = 1, row: Column | None = None) -> DataFrame:
    """(by, replicate, mean): Poisson bootstrap of group means, added up from partial sums.

    ``row`` tells rows apart, by default their number, so that equal rows are drawn apart.
    """
    own = df.select(F.col(by).alias("_k"), F.col(value).cast("double").alias("_v"), (F.monotonically_increasing_id() if row is None else row).alias("_row"))
    each = own.select("_k", "_v", "_row", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = drawn(each, seed, F.col("replicate"), F.col("_row"))
    return each.groupBy(F.col("_k").alias(by), "replicate").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))


def roulette_draws(weights: DataFrame, by: Sequence[str], item: str, weight: str, u: Column) -> DataFrame:
    """(by, item): of each group one item, drawn in proportion to the weights by the group's uniform number."""
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(item).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    return weights.withColumn("_upto", upto).withColumn("_u", u).where("_upto > _u").groupBy(*by).agg(F.min_by(item, "_upto").alias(item))


def roulette(weights: Sequence[float], u: float) -> int:
    """Index drawn in proportion to the weights by a uniform number."""
    return int(np.searchsorted(np.cumsum(weights) / np.sum(weights), u, side="right"))
