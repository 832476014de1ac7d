"""String, array and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(s: Column, prefix: str, ignore_case: bool = False, ignore_space: bool = False) -> Column:
    s = F.ltrim(s) if ignore_space else s
    return F.startswith(F.lower(s), F.lit(prefix.lower())) if ignore_case else F.startswith(s, F.lit(prefix))


def ends_with(s: Column, suffix: str) -> Column:
    return F.endswith(s, F.lit(suffix))


def count_of(s: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def index_of(s: Column, part: str) -> Column:
    """Place from 0, -1 if absent."""
    return F.instr(s, part) - 1


def split_numbers(s: Column, separator: str = ",") -> Column:
    return F.transform(F.split(s, separator), lambda x: F.trim(x).try_cast("double"))


def to_boolean(s: Column) -> Column:
    return F.lower(F.trim(s)) == "true"


def is_float(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def is_integer(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def annotation(info: Column, key: str) -> Column:
    """The value after ``key=`` in ``[&a=1,b=2]`` notes; empty if absent."""
    return F.regexp_extract(info, rf"[\[&,]{key}=([^,\]]+)", 1)


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(0.0), lambda s, k: s + F.log(k))


def log_double_factorial(n: Column) -> Column:
    low = F.when(n % 2 == 0, F.lit(2)).otherwise(F.lit(1))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(low, F.greatest(n.cast("int"), low), F.lit(2)), F.lit(0.0), lambda s, k: s + F.log(k)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def linear_grid(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * ((high - low) / (n - 1)))


def log_grid(low: float, high: float, n: int) -> Column:
    return F.transform(linear_grid(0.0, 1.0, n), lambda u: F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low)))))


def relabel(values: Column) -> Column:
    """Classes renumbered by first appearance."""
    seen = F.array_distinct(values)
    return F.transform(values, lambda v: F.array_position(seen, v) - 1)


def packed_index(i: Column, j: Column, n: int) -> Column:
    """Place of (i, j), i < j, in a packed upper triangle of size n."""
    return i * (2 * n - i - 1) / 2 + j - i - 1


def ln(x: Column) -> Column:
    """The natural logarithm in IEEE terms: minus infinity at zero, not a number below it, where Spark's gives null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def to_real(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """A bounded value on the real line: log or logit."""
    if low is None and high is None:
        return x
    if high is None:
        return ln(x - low)
    if low is None:
        return ln(high - x)
    return ln((x - low) / (high - x))


def from_real(z: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is None and high is None:
        return z
    if high is None:
        return low + F.exp(z)
    if low is None:
        return high - F.exp(z)
    return low + (high - low) / (1 + F.exp(-z))


def log_jacobian(z: Column, low: float | None = None, high: float | None = None) -> Column:
    """ln |d bounded / d real|."""
    if low is None and high is None:
        return F.lit(0.0)
    if high is None or low is None:
        return z
    return F.log(F.lit(high - low)) - z - 2 * F.log1p(F.exp(-z))


def logit(x: Column) -> Column:
    return ln(x / (1 - x))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def stick_breaking(p: Column) -> Column:
    """Simplex of K values to K - 1 reals; the uniform simplex goes to zero."""
    k = F.size(p)
    rest = lambda i: 1 - F.aggregate(F.slice(p, 1, i), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.slice(p, 1, k - 1), lambda x, i: F.log(x / (rest(i) - x)) + F.log((k - 1 - i).cast("double")))


def decimal_year(date: Column) -> Column:
    """Year plus the share of it that has passed at the start of the day; a year is leap if 4 divides it."""
    days = F.when(F.year(date) % 4 == 0, 366).otherwise(365)
    return F.year(date) + (F.dayofyear(date) - 1) / days


def jc69(t: Column, same: bool) -> Column:
    e = F.exp(-4 * t / 3)
    return 0.25 + 0.75 * e if same else 0.25 - 0.25 * e


def k80(t: Column, kappa: float, kind: str) -> Column:
    """Probability of the same state, of a transition or of one transversion after t expected changes."""
    b = 1 / (kappa + 2)
    e1, e2 = F.exp(-4 * b * t), F.exp(-2 * (kappa + 1) * b * t)
    return {"same": 0.25 + 0.25 * e1 + 0.5 * e2, "transition": 0.25 + 0.25 * e1 - 0.5 * e2, "transversion": 0.25 - 0.25 * e1}[kind]


def f81(t: Column, freqs: tuple[float, ...], i: int, j: int) -> Column:
    beta = 1 / (1 - sum(f * f for f in freqs))
    e = F.exp(-beta * t)
    return e + freqs[j] * (1 - e) if i == j else freqs[j] * (1 - e)
