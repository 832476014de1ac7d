"""Queries over substitution models, site rates and clocks, and their SQL.

Times are the distinct sizes of parts; the SQL adds up the exponential's power series in lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dendrolith.functions import models as M
from dendrolith.functions import special
from dendrolith.operators import markov as K
from dendrolith.operators import trees as T
from dendrolith.plans.standins import rounded, table
from dendrolith.plans.trees import GEO_SQL, geography

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FREQS = [0.1, 0.2, 0.3, 0.4]
TIMES_SQL = "times AS (SELECT DISTINCT p_size, p_size / 40.0::DOUBLE AS t FROM part)"


def times(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().withColumn("t", F.col("p_size") / 40)


def rate_rows(exchange: list[list[float]], freqs: list[float]) -> list[list[float]]:
    """A rate matrix with mean one, written out for the SQL."""
    n = len(freqs)
    q = [[exchange[i][j] * freqs[j] if i != j else 0.0 for j in range(n)] for i in range(n)]
    mean = sum(freqs[i] * sum(q[i]) for i in range(n))
    return [[(q[i][j] if i != j else -sum(q[i])) / mean for j in range(n)] for i in range(n)]


def series_sql(q: list[list[float]], slope: bool = False) -> str:
    """P(t) or its derivative, from 45 terms of the power series."""
    n = len(q)
    cells = ", ".join(repr(float(x)) for row in q for x in row)
    one = ", ".join("1.0" if i % (n + 1) == 0 else "0.0" for i in range(n * n))
    weight = "k / t" if slope else "1"
    return f"""WITH RECURSIVE {TIMES_SQL}, terms(p_size, t, k, q, m) AS (
  SELECT p_size, t, 0, [{cells}]::DOUBLE[], [{one}]::DOUBLE[] FROM times
  UNION ALL SELECT p_size, t, k + 1, q, list_transform(range(0, {n * n}), lambda x: list_sum(list_transform(range(0, {n}), lambda l: m[(x // {n}) * {n} + l + 1] * q[l * {n} + x % {n} + 1])) * t / (k + 1)) FROM terms WHERE k < 45)
SELECT p_size::BIGINT AS p_size, CAST(x // {n} AS INTEGER) AS i, CAST(x % {n} AS INTEGER) AS j, round(sum(m[x + 1] * {weight}), 6) AS p FROM terms, (SELECT unnest(range(0, {n * n})) AS x) GROUP BY 1, 2, 3"""


KAPPA = 3.0
_R, _Y = FREQS[0] + FREQS[2], FREQS[1] + FREQS[3]
_BETA = 1 / (2 * _R * _Y + 2 * KAPPA * (FREQS[0] * FREQS[2] + FREQS[1] * FREQS[3]))


@query(f"""WITH {TIMES_SQL}, f(i, pi, g) AS (VALUES (0, 0.1::DOUBLE, {_R}::DOUBLE), (1, 0.2, {_Y}), (2, 0.3, {_R}), (3, 0.4, {_Y}))
SELECT p_size::BIGINT AS p_size, a.i::INTEGER AS i, b.i::INTEGER AS j, round(CASE
  WHEN a.i % 2 <> b.i % 2 THEN b.pi * (1 - exp(-{_BETA} * t))
  ELSE b.pi + b.pi * (1 / b.g - 1) * exp(-{_BETA} * t) + (CASE WHEN a.i = b.i THEN b.g - b.pi ELSE -b.pi END) / b.g * exp(-{_BETA} * t * (1 + b.g * ({KAPPA} - 1))) END, 6) AS p FROM times, f a, f b""")
def hky_probabilities(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.hky(KAPPA, FREQS)))


RATES = [1.5, 4.0, 0.7, 1.2, 5.0]
GTR_EXCHANGE = [[0, 1.5, 4.0, 0.7], [1.5, 0, 1.2, 5.0], [4.0, 1.2, 0, 1.0], [0.7, 5.0, 1.0, 0]]


@query(series_sql(rate_rows(GTR_EXCHANGE, FREQS)))
def gtr_probabilities(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.gtr(RATES, FREQS)))


@query(series_sql(rate_rows(GTR_EXCHANGE, FREQS), slope=True))
def probability_slopes(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.gtr(RATES, FREQS), order=1))


#: AC and GT are one class, AG and CT another, AT and CG a third.
CODED_EXCHANGE = [[0, 1, 2.5, 0.4], [1, 0, 0.4, 2.5], [2.5, 0.4, 0, 1], [0.4, 2.5, 1, 0]]


@query(series_sql(rate_rows(CODED_EXCHANGE, FREQS)))
def coded_probabilities(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.nucleotide("012210", [2.5, 0.4], FREQS)))


UNREST = [[0, 0.9, 1.7, 0.3], [0.5, 0, 0.8, 2.1], [1.1, 0.6, 0, 1.4], [0.2, 1.9, 0.7, 0]]


def free_rows() -> list[list[float]]:
    """UNREST has no frequencies in it; its mean is taken under FREQS."""
    mean = sum(FREQS[i] * sum(UNREST[i]) for i in range(4))
    return [[(UNREST[i][j] if i != j else -sum(UNREST[i])) / mean for j in range(4)] for i in range(4)]


@query(series_sql(free_rows()))
def unrestricted_probabilities(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.unrestricted(np.array(UNREST), FREQS)))


@query(series_sql(free_rows()))
def series_probabilities(spark, sf):
    return rounded(K.exponentials(times(spark, sf), "p_size", "t", M.unrestricted(np.array(UNREST), FREQS).q))


FIVE = [0.3, 0.25, 0.2, 0.15, 0.1]
STRUCTURE = [0, 1, 2, 0, 1, 0, 2, 2, 1, 0]


def five_exchange() -> list[list[float]]:
    out, at = [[0.0] * 5 for _ in range(5)], 0
    for i in range(5):
        for j in range(i + 1, 5):
            out[i][j] = out[j][i] = (1.0, 2.0, 0.5)[STRUCTURE[at]]
            at += 1
    return out


@query(series_sql(rate_rows(five_exchange(), FIVE)))
def general_probabilities(spark, sf):
    return rounded(K.transitions(times(spark, sf), "p_size", "t", M.general(STRUCTURE, [1.0, 2.0, 0.5], FIVE)))


@query(f"""WITH {TIMES_SQL}, c AS (SELECT p_size, t, k, pow(-ln(1 - (2 * k + 1) / 8.0), 1 / (t + 0.5)) AS r FROM times, (SELECT unnest(range(0, 4)) AS k))
SELECT p_size::BIGINT AS p_size, k::INTEGER AS category, round(r / avg(r) OVER (PARTITION BY p_size), 6) AS rate, 0.25::DOUBLE AS weight FROM c""")
def weibull_rates(spark, sf):
    return rounded(K.categories(times(spark, sf), "p_size", "t", lambda t: M.rate_categories("weibull", 4, t + 0.5)))


@query(f"""WITH {TIMES_SQL}, c AS (SELECT p_size, k, -ln(1 - (2 * k + 1) / 10.0) AS r, 0.9 / 5 AS w, 0.0 AS z FROM times, (SELECT unnest(range(0, 5)) AS k)),
d AS (SELECT p_size, k, r, w FROM c UNION ALL SELECT p_size, 5, 0, 0.1 FROM times)
SELECT p_size::BIGINT AS p_size, ((k + 1) % 6)::INTEGER AS category, round(r / sum(r * w) OVER (PARTITION BY p_size), 6) AS rate, round(w, 6)::DOUBLE AS weight FROM d""")
def invariant_rates(spark, sf):
    """Gamma rates of shape one are exponential; a tenth of the sites does not change."""
    return rounded(K.categories(times(spark, sf), "p_size", "t", lambda t: M.rate_categories("gamma", 5, 1.0, invariant=0.1)))


@query(f"""WITH {TIMES_SQL}, c AS (SELECT p_size, k, CASE k WHEN 0 THEN t + 2 - sqrt(t + 2) ELSE t + 2 + sqrt(t + 2) END AS x, CASE k WHEN 0 THEN (1 + sqrt(t + 2)) / (2 * sqrt(t + 2)) ELSE (sqrt(t + 2) - 1) / (2 * sqrt(t + 2)) END AS w FROM times, (SELECT unnest(range(0, 2)) AS k))
SELECT p_size::BIGINT AS p_size, k::INTEGER AS category, round(x / sum(x * w) OVER (PARTITION BY p_size), 6) AS rate, round(w, 6) AS weight FROM c""")
def laguerre_rates(spark, sf):
    """Two nodes, whose places and weights are closed."""
    return rounded(K.categories(times(spark, sf), "p_size", "t", lambda t: M.rate_categories("laguerre", 2, t + 1)))


@query(f"""WITH {TIMES_SQL}, c AS (SELECT p_size, k, [t, 1.0, 3.0][k + 1] AS r, [0.5, 0.3, 0.2][k + 1]::DOUBLE AS w FROM times, (SELECT unnest(range(0, 3)) AS k))
SELECT p_size::BIGINT AS p_size, k::INTEGER AS category, round(r / sum(r * w) OVER (PARTITION BY p_size), 6) AS rate, w AS weight FROM c""")
def free_rates(spark, sf):
    return rounded(K.categories(times(spark, sf), "p_size", "t", lambda t: M.free_rates([t, 1.0, 3.0], [0.5, 0.3, 0.2])))


@query(f"WITH {GEO_SQL} SELECT child, round(length * CASE substr(child, 1, 1) WHEN 'r' THEN 1.0 WHEN 'n' THEN 0.5 WHEN 'c' THEN 2.0 ELSE 0.25 END, 10) AS length FROM geo")
def clock_lengths(spark, sf):
    """Discrete clock: a rate per class of branches, four rows that go to the branches."""
    geo = geography(spark, sf).select("child", F.col("length").alias("duration"), F.substring("child", 1, 1).alias("class"))
    rates = spark.createDataFrame([("r", 1.0), ("n", 0.5), ("c", 2.0), ("o", 0.25)], "class string, rate double")
    return rounded(K.branch_lengths(geo, F.broadcast(rates), ["class"]).select("child", "length"), 10)


@query(f"""WITH {GEO_SQL}, o AS (SELECT child, CASE WHEN child LIKE 'n%' AND length > 4 THEN length WHEN child LIKE 'r%' THEN 10 + length END AS own FROM geo),
n AS (SELECT g.child, coalesce(a.own, p.own) AS rate FROM geo g JOIN o a ON a.child = g.child LEFT JOIN o p ON p.child = g.parent WHERE g.child LIKE 'n%'),
c AS (SELECT 'c' || c_custkey AS child, rate FROM customer JOIN n ON n.child = 'n' || c_nationkey)
SELECT child AS node, own AS rate FROM o WHERE child LIKE 'r%' UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c UNION ALL SELECT 'o' || o_orderkey, rate FROM orders JOIN c ON c.child = 'c' || o_custkey UNION ALL SELECT 'root', 1.0""")
def local_clocks(spark, sf):
    """Regions and some nations have rates of their own, all below inherit them."""
    geo = geography(spark, sf)
    own = geo.select("tree", F.col("child").alias("node"), F.when(F.col("child").startswith("n") & (F.col("length") > 4), F.col("length")).when(F.col("child").startswith("r"), 10 + F.col("length")).alias("rate")).where("rate is not null")
    return T.inherited_rates(geo, own, 1.0).select("node", "rate")


@query("SELECT DISTINCT p_size, round(-ln(1 - p_size / 60.0::DOUBLE) / 2, 6) AS exponential, round(3 * pow(-ln(1 - p_size / 60.0::DOUBLE), 1 / 1.5), 6) AS weibull, round(2 * (p_size / 60.0::DOUBLE) - 1, 6) AS erf FROM part")
def quantiles(spark, sf):
    """Closed quantiles, and the error function undone by its inverse."""
    @F.pandas_udf("struct<exponential: double, weibull: double, erf: double>")
    def of(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"exponential": [special.qexp(x, 2.0) for x in p], "weibull": [special.qweibull(x, 1.5, 3.0) for x in p], "erf": [math.erf(special.inverse_erf(2 * x - 1)) for x in p]})

    sizes = table(spark, sf, "part").select("p_size").distinct()
    return rounded(sizes.select("p_size", of(F.col("p_size") / 60).alias("q")).select("p_size", "q.*"))


@query("""WITH RECURSIVE c(n, cells) AS (SELECT 1, [1]::DOUBLE[] UNION ALL SELECT n + 1, list_reduce(list_prepend([cells[n]]::DOUBLE[], list_transform(cells, lambda x: [x]::DOUBLE[])), lambda a, b: list_append(a, a[len(a)] + b[1])) FROM c WHERE n < 50)
SELECT DISTINCT p_size, CASE WHEN n <= 22 THEN cells[n]::BIGINT::VARCHAR ELSE '' END AS bell, round(ln(cells[n]), 8) AS log_bell FROM part JOIN c ON n = p_size""")
def bell_numbers(spark, sf):
    """Bell's triangle row by row, for every size; the numbers themselves as far as doubles hold them."""
    @F.pandas_udf("bell string, log_bell double")
    def bell(size: pd.Series) -> pd.DataFrame:
        found = [special.bell_number(int(n)) for n in size]
        return pd.DataFrame({"bell": [str(b) if n <= 22 else "" for n, b in zip(size, found, strict=True)], "log_bell": [math.log(b) for b in found]})

    sizes = table(spark, sf, "part").select("p_size").distinct().withColumn("x", bell("p_size"))
    return sizes.select("p_size", "x.bell", F.round("x.log_bell", 8).alias("log_bell"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey, c.n_nationkey) - 1 AS rank, a.n_nationkey || ',' || b.n_nationkey || ',' || c.n_nationkey AS chosen FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey)
SELECT p_partkey, rank, chosen FROM part JOIN r ON rank = p_partkey % (SELECT count(*) FROM r)""")
def combinations_by_rank(spark, sf):
    """Every part's choice of three nations, from the rank that its key gives among all choices."""
    n = table(spark, sf, "nation").count()

    @F.pandas_udf("string")
    def chosen(rank: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, special.combination_at(n, 3, int(r)))) for r in rank])

    rank = F.pmod("p_partkey", F.lit(math.comb(n, 3))).cast("long")
    return table(spark, sf, "part").select("p_partkey", rank.alias("rank")).withColumn("chosen", chosen("rank"))
