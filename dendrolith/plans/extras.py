"""Queries over further operators on trees, samples, coalescents and parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrolith.operators import coalescent as C
from dendrolith.operators import density as Y
from dendrolith.operators import parameters as A
from dendrolith.operators import patterns as P
from dendrolith.operators import resampling as R
from dendrolith.operators import samples as O
from dendrolith.operators import trees as T
from dendrolith.plans import quartets as Q
from dendrolith.plans import standins as S
from dendrolith.plans.standins import BASE_SQL, SAMPLES_SQL, rounded, table
from dendrolith.plans.trees import GEO_SQL, ROWS_SQL, WALK_SQL, geography, order_rows
from dendrolith.sources import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {GEO_SQL} SELECT count(*) AS n, round(corr(c.rate + length(c.child), p.rate + length(p.child)), 6) AS correlation FROM geo c JOIN geo p ON p.child = c.parent")
def rate_correlations(spark, sf):
    geo = geography(spark, sf).withColumn("rate", F.col("rate") + F.length("child"))
    return rounded(T.rate_correlation(geo).select("n", "correlation"))


@query(f"WITH {GEO_SQL} SELECT child, parent, round(length, 8) AS length FROM geo WHERE child = 'n7'")
def node_lookup(spark, sf):
    return rounded(T.node_by_name(geography(spark, sf), "n7").select("child", "parent", "length"), 8)


@query(f"{WALK_SQL} SELECT node, round(max(distance) OVER () - distance, 8) AS height FROM walk")
def node_heights(spark, sf):
    return rounded(T.heights(geography(spark, sf)).select("node", "height"), 8)


@query(f"WITH {GEO_SQL} SELECT child, round(length * 0.125, 12) AS length FROM geo")
def scaled_lengths(spark, sf):
    return rounded(T.scaled(geography(spark, sf), 0.125).select("child", "length"), 12)


@query(f"""{WALK_SQL}, d AS (SELECT distance AS y, epoch(o_orderdate) / 86400 / 365.25 AS x FROM walk JOIN orders ON node = 'o' || o_orderkey)
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(corr(x, y), 6) AS r FROM d""")
def root_to_tip(spark, sf):
    """Regression of the tips' distances from the root on their dates."""
    dates = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6 / 365.25).alias("x"))
    rows = T.root_paths(geography(spark, sf)).join(dates, "node").withColumnRenamed("distance", "y")
    return rounded(O.regression(rows, [], "x", "y").select("n", "slope", "r"))


@query("""WITH v AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1), a AS (SELECT *, least(greatest(0.9 * (n + 1), 1), n)::DOUBLE AS pos FROM v)
SELECT event_type, round(v[floor(pos)::INT] * (1 - (pos - floor(pos))) + coalesce(v[floor(pos)::INT + 1], 0) * (pos - floor(pos)), 6) AS q FROM a""")
def interpolated_percentile(spark, sf):
    return rounded(O.interpolated_percentile(table(spark, sf, "events"), ["event_type"], "value", 0.9))


FIELLER_SQL = """WITH s AS (SELECT l_linenumber, count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
f AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2, mx - my / b AS x0 FROM s), g AS (SELECT *, 2.25 * s2 / (b * b * sxx) AS g FROM f)"""


@query(f"""{FIELLER_SQL} SELECT l_linenumber, round(b - 1.5 * sqrt(s2 / sxx), 3) AS slope_low, round(b + 1.5 * sqrt(s2 / sxx), 3) AS slope_high, round(x0, 4) AS x0,
round(CASE WHEN g < 1 THEN mx + ((x0 - mx) - 1.5 * sqrt(s2) / abs(b) * sqrt((x0 - mx) * (x0 - mx) / sxx + (1 - g) / n)) / (1 - g) END, 4) AS x_low,
round(CASE WHEN g < 1 THEN mx + ((x0 - mx) + 1.5 * sqrt(s2) / abs(b) * sqrt((x0 - mx) * (x0 - mx) / sxx + (1 - g) / n)) / (1 - g) END, 4) AS x_high FROM g""")
def regression_intervals(spark, sf):
    """Intervals of the slope and, by Fieller's theorem, of the crossing of the x axis."""
    fits = O.regression(table(spark, sf, "lineitem"), ["l_linenumber"], "l_quantity", "l_extendedprice")
    found = O.x_intercept_interval(O.slope_interval(fits, 1.5), 1.5)
    digits = {"slope_low": 3, "slope_high": 3, "x0": 4, "x_low": 4, "x_high": 4}
    return found.select("l_linenumber", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"WITH {SAMPLES_SQL} SELECT round(max(ll) + ln(sum(exp(ll - m))) - ln(count(*)), 6) AS lml FROM (SELECT *, max(ll) OVER () AS m FROM samples WHERE beta = 0)")
def naive_monte_carlo(spark, sf):
    return rounded(O.naive_monte_carlo(S.samples(spark, sf)))


DENSITIES_SQL = "d AS (SELECT event_type, -value / 50 - ln(50) AS p, -value / 30 - ln(30) AS q1, -value / 90 - ln(90) AS q2 FROM events)"


def _densities(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_type", *[Y.exponential(v, 1 / m).alias(n) for n, m in (("p", 50.0), ("q1", 30.0), ("q2", 90.0))])


@query(f"WITH {DENSITIES_SQL} SELECT event_type, round(ln(avg(exp(p - ln(0.3 * exp(q1) + 0.7 * exp(q2))))), 6) AS lme FROM d GROUP BY 1")
def mixture_importance(spark, sf):
    return rounded(O.mixture_importance(_densities(spark, sf), "p", ["q1", "q2"], [0.3, 0.7], ["event_type"]))


@query(f"WITH {DENSITIES_SQL} SELECT event_type, round(sum(exp(p - q2) * p) / sum(exp(p - q2)), 6) AS mean FROM d GROUP BY 1")
def normalised_importance(spark, sf):
    return rounded(O.log_evidence_by_importance(_densities(spark, sf), "p", "q2", ["event_type"], normalised=False))


@query(f"{ROWS_SQL} SELECT tree, round(sum(pairs * dt / 9 - CASE WHEN kind = 'c' THEN 1 / 3.0 ELSE 0 END), 6) AS slope FROM iv2 GROUP BY tree")
def coalescent_gradient(spark, sf):
    return rounded(C.constant_gradient(order_rows(spark, sf), 3.0))


@query(f"{ROWS_SQL}, z AS (SELECT *, least(n_coal, 4)::INTEGER AS bin, [3.0, 10.0, 4.0, 2.0, 3.0][least(n_coal, 4) + 1]::DOUBLE AS size FROM iv2) SELECT tree, bin, round(sum(pairs * dt / (size * size) - CASE WHEN kind = 'c' THEN 1 / size ELSE 0 END), 6) AS slope FROM z GROUP BY tree, bin")
def skyride_gradient(spark, sf):
    return rounded(C.piecewise_gradient(order_rows(spark, sf), [3, 10, 4, 2, 3], F.col("n_coal")))


@query("""SELECT event_id, round(-0.5 * (x * x / 2 - 2 * 0.5 * x * y / 2 + y * y * 2 / 2) / (1 - 0.125) - 0.5 * ln(2 * 1 - 0.25) - ln(2 * pi()), 6) AS lp FROM (SELECT event_id, value / 100 - 1 AS x, (user_id % 10) / 10.0::DOUBLE - 0.5 AS y FROM events)""")
def density_multivariate_normal(spark, sf):
    xs = [F.col("value") / 100, (F.col("user_id") % 10) / 10]
    return rounded(table(spark, sf, "events").select("event_id", Y.multivariate_normal_of(xs, [1.0, 0.5], [[2.0, 0.5], [0.5, 1.0]]).alias("lp")))


@query("""WITH w AS (SELECT p_brand, p_partkey, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) / sum(p_retailprice) OVER (PARTITION BY p_brand) AS upto, substr(p_brand, -1, 1)::INTEGER / 10.0::DOUBLE AS u FROM part)
SELECT p_brand, arg_min(p_partkey, upto) AS p_partkey FROM w WHERE upto > u GROUP BY 1""")
def roulette(spark, sf):
    u = F.substring("p_brand", -1, 1).cast("int") / 10
    return R.roulette_draws(table(spark, sf, "part"), ["p_brand"], "p_partkey", "p_retailprice", u)


@query(f"""{BASE_SQL}, each AS (SELECT site, r, ('0x' || substr(md5('1|' || r || '|' || site), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM cols, (SELECT unnest(range(0, 10)) AS r))
SELECT r::INTEGER AS replicate, count(*) AS n, sum(site)::BIGINT AS sites FROM each WHERE u >= 0.3 GROUP BY 1""")
def jackknife_replicates(spark, sf):
    return R.jackknife_sites(S.columns(spark, sf), 0.3, 10).groupBy("replicate").agg(F.count("*").alias("n"), F.sum("site").alias("sites"))


@query("SELECT p_size % 4 || ',' || p_size % 3 AS partial, count(*) AS weight, min(p_partkey) AS first FROM part GROUP BY 1")
def partial_patterns(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("site"), F.array((F.col("p_size") % 4).cast("double"), (F.col("p_size") % 3).cast("double")).alias("partial"))
    return P.compress_partials(rows).withColumn("partial", F.array_join(F.transform("partial", lambda x: x.cast("int").cast("string")), ","))


@query("SELECT string_agg(CASE n_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, ',' ORDER BY n_nationkey) AS pattern, 1::BIGINT AS weight FROM nation")
def attribute_pattern(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("taxon"), F.col("n_regionkey").cast("string").alias("value"))
    taxa = sorted(r[0] for r in rows.select("taxon").collect())  # a dimension
    return P.attribute_pattern(rows, taxa, ["3", "1"]).withColumn("pattern", F.array_join(F.col("pattern").cast("array<string>"), ","))


@query("SELECT n_name AS name, n_nationkey::DOUBLE AS value, n_nationkey % 2 = 0 AS estimate FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 1 UNION ALL SELECT n_name, n_nationkey, true FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 2 = 0 AND n_regionkey <> 1")
def free_parameters(spark, sf):
    """The free ones of a second set are added, those of one region removed."""
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), k.cast("double").alias("value"), (k % 2 == 0).alias("estimate"), "n_regionkey")
    every = A.free_parameters(rows.where("value < 10"), rows.where("value >= 10"))
    return A.without(every, rows.where("n_regionkey = 1")).drop("n_regionkey")


@query("""WITH l AS (SELECT p_partkey AS pos, 1 + ((p_size % 2) <> ((p_partkey // 7) % 2))::INT AS n FROM part), m AS (SELECT *, (coalesce(lag(n) OVER (ORDER BY pos), -1) <> n)::INT AS new FROM l), b AS (SELECT *, sum(new) OVER (ORDER BY pos) AS block FROM m)
SELECT n AS n_classes, min(pos) AS first, max(pos) AS last FROM b GROUP BY block, n""")
def class_blocks(spark, sf):
    """Runs of trees of a log with the same number of rate classes."""
    part = table(spark, sf, "part")
    value = F.concat(F.lit("class="), (F.col("p_size") % 2).cast("string"), F.lit(",class="), (F.expr("p_partkey div 7") % 2).cast("string"))
    return logs.classes_in_logs(part.select(F.col("p_partkey").alias("at"), value.alias("value")), "class").drop("block")


@query(f"""{Q.WHOLE_SQL}, p AS (SELECT pattern, sum(w * v * rate) / sum(w * v) AS rate, arg_max(c, w * v) AS category FROM k GROUP BY 1)
SELECT c.site, round(rate, 6) AS rate, category::INTEGER AS category FROM cols c JOIN p ON p.pattern = substr(c.pattern, 1, 4) WHERE length(replace(p.pattern, '-', '')) >= 2""")
def site_rate_table(spark, sf):
    """Posterior rates by site, as they are written out; sites of a single state tell nothing of their rate."""
    from dendrolith.operators import likelihood

    found = likelihood.site_likelihoods(Q.patterns(spark, sf, known=2), Q.tree(spark, sf), Q.model(), Q.rates())
    sites = S.columns(spark, sf).withColumn("pattern", F.substring("pattern", 1, 4))
    return rounded(logs.site_rate_table(sites, found))
