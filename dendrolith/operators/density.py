"""Log densities as column expressions and smoothing priors as windows."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma, log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrolith.functions.text import ln

LOG_2PI = log(2 * pi)


def _times_ln(k: float, x: Column) -> Column:
    """k ln x, the log of x to the power k: 0 for k = 0, at zero too."""
    return F.when(x.isNotNull(), F.lit(0.0)) if k == 0 else k * ln(x)


def exponential(x: Column, rate) -> Column:
    return F.log(F.lit(rate)) - rate * x


def normal(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    return -0.5 * LOG_2PI - log(sigma) - 0.5 * ((x - mean) / sigma) ** 2


def half_normal(x: Column, sigma: float = 1.0) -> Column:
    return F.when(x >= 0, normal(x, 0.0, sigma) + log(2))


def lognormal(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return normal(ln(x), mu, sigma) - ln(x)


def cauchy(x: Column, location: float = 0.0, scale: float = 1.0) -> Column:
    return -F.log(pi * scale * (1 + ((x - location) / scale) ** 2))


def kumaraswamy(x: Column, a: float, b: float) -> Column:
    return log(a * b) + _times_ln(a - 1, x) + _times_ln(b - 1, 1 - x**a)


def one_on_x(x: Column) -> Column:
    return -ln(x)


def gamma(x: Column, shape: float, rate: float, shift: float = 0.0) -> Column:
    z = x - shift
    return shape * log(rate) - lgamma(shape) + _times_ln(shape - 1, z) - rate * z


def beta(x: Column, a: float, b: float) -> Column:
    return lgamma(a + b) - lgamma(a) - lgamma(b) + _times_ln(a - 1, x) + _times_ln(b - 1, 1 - x)


def beta_prime(x: Column, a: float, b: float) -> Column:
    return lgamma(a + b) - lgamma(a) - lgamma(b) + _times_ln(a - 1, x) - (a + b) * ln(1 + x)


def dirichlet(xs: Sequence[Column], alphas: Sequence[float]) -> Column:
    out = F.lit(lgamma(sum(alphas)) - sum(map(lgamma, alphas)))
    for x, a in zip(xs, alphas, strict=True):
        if a != 1:
            out = out + (a - 1) * ln(x)
    return out


def weibull(x: Column, shape: float, scale: float) -> Column:
    return log(shape / scale) + _times_ln(shape - 1, x / scale) - (x / scale) ** shape


def ctmc_scale(rate: Column, tree_time: Column) -> Column:
    """Gamma(1/2, tree time) on a rate."""
    return 0.5 * ln(tree_time) - lgamma(0.5) - 0.5 * ln(rate) - rate * tree_time


def uniform_topology(n_tips: Column) -> Column:
    """-ln of the number of unrooted binary trees, (2n - 5)!!."""
    factors = F.sequence(F.lit(1), F.greatest(F.lit(1), 2 * n_tips.cast("int") - 5), F.lit(2))
    return -F.aggregate(factors, F.lit(0.0), lambda s, k: s + F.log(k))


def gmrf(df: DataFrame, field: str, order: Sequence[str], value: str, precision: float) -> DataFrame:
    """(field, lp): Gaussian first differences."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(field).orderBy(*order))
    return _field(df.withColumn("_s", step * step), field, precision)


def gmrf_time_aware(df: DataFrame, field: str, order: Sequence[str], value: str, time: str, precision: float) -> DataFrame:
    """First differences weighted by two over the sum of the neighbouring gaps; the first gap is one."""
    w = Window.partitionBy(field).orderBy(*order)
    gaps = df.withColumn("_g", F.col(time) - F.lag(time).over(w)).withColumn("_g", F.coalesce("_g", F.lit(1.0)))
    step = F.col(value) - F.lag(value).over(w)
    return _field(gaps.withColumn("_s", step * step * 2 / (F.col("_g") + F.lag("_g").over(w))), field, precision)


def _field(df: DataFrame, field: str, precision: float) -> DataFrame:
    n = F.count("_s")
    return df.groupBy(field).agg((log(precision) * n / 2 - F.coalesce(F.sum("_s"), F.lit(0.0)) * precision / 2 - n / 2 * LOG_2PI).alias("lp"))


def gamma_field(df: DataFrame, field: str, order: Sequence[str], value: str, shape: float) -> DataFrame:
    """Each value is gamma distributed with the previous one as its mean."""
    before = F.lag(value).over(Window.partitionBy(field).orderBy(*order))
    rate = shape / before
    lp = shape * F.log(rate) - lgamma(shape) + (shape - 1) * F.log(value) - rate * F.col(value)
    return df.withColumn("_l", lp).groupBy(field).agg(F.sum("_l").alias("lp"))


def compound(parts: DataFrame, by: Sequence[str], lp: str, weight: str | None = None) -> DataFrame:
    """Sum of log densities, or the log of their weighted mixture."""
    if weight is None:
        return parts.groupBy(*by).agg(F.sum(lp).alias("lp"))
    top = Window.partitionBy(*by)
    shifted = parts.withColumn("_m", F.max(lp).over(top))
    return shifted.groupBy(*by).agg((F.max("_m") + F.log(F.sum(F.col(weight) * F.exp(F.col(lp) - F.col("_m"))))).alias("lp"))


def multivariate_normal(x, mean, covariance=None, factor=None) -> float:
    """Log density from a covariance or its lower Cholesky factor."""
    import numpy as np

    lower = np.linalg.cholesky(np.asarray(covariance, dtype=float)) if factor is None else np.asarray(factor, dtype=float)
    z = np.linalg.solve(lower, np.asarray(x, dtype=float) - np.asarray(mean, dtype=float))
    return float(-0.5 * z @ z - np.log(np.diag(lower)).sum() - 0.5 * len(z) * LOG_2PI)


def multivariate_normal_of(xs: Sequence[Column], mean: Sequence[float], covariance) -> Column:
    """The log density of a vector of columns; the inverse covariance is worked out once."""
    import numpy as np

    precision = np.linalg.inv(np.asarray(covariance, dtype=float))
    away = [x - float(m) for x, m in zip(xs, mean, strict=True)]
    square = sum((float(precision[i, j]) * a * b for i, a in enumerate(away) for j, b in enumerate(away)), F.lit(0.0))
    return -0.5 * square - 0.5 * float(np.linalg.slogdet(np.asarray(covariance, dtype=float))[1]) - 0.5 * len(away) * LOG_2PI
