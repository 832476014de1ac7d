"""Likelihoods, reconstruction, parsimony and distance trees on four taxa, where SQL can add up all inner states.

The taxa are the first four nations of the stand-in alignment, the patterns all of its sites; the tree is fixed:
((A,B),(C,D)), under F81 with two free rates. The SQL sums over the states of the three inner nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.functions import models as M
from dendrolith.operators import cluster, distances, likelihood, search
from dendrolith.operators import patterns as P
from dendrolith.operators import resampling as R
from dendrolith.operators import trees as T
from dendrolith.plans import standins as S
from dendrolith.plans.standins import BASE_SQL, PAIRS_SQL, rounded
from dendrolith.sources.trees import Tree

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
RATES, WEIGHTS = [0.5, 2.0], [0.6, 0.4]
LENGTHS = {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4, "x": 0.05, "y": 0.15}
#: The branches in the numbering of tips first, then inner nodes.
BRANCHES = "abcdxy"
GRID = [0.1, 0.4, 1.0, 2.5, 6.0]


def patterns(spark, sf, known: int = 0) -> DataFrame:
    """Patterns of the first four taxa, with at least ``known`` states."""
    four = S.columns(spark, sf).withColumn("pattern", F.substring("pattern", 1, 4))
    return P.compress(four.where(F.length(F.translate("pattern", "-", "")) >= known))


def tree(spark, sf) -> likelihood.TreeArrays:
    names = [str(t) for t in S.taxa(spark, sf)[:4]]
    n = LENGTHS
    return likelihood.TreeArrays.of(f"(({names[0]}:{n['a']},{names[1]}:{n['b']}):{n['x']},({names[2]}:{n['c']},{names[3]}:{n['d']}):{n['y']});", names)


def model() -> M.SubstitutionModel:
    return M.nucleotide("000000", (), FREQS)


def rates() -> M.SiteRates:
    return M.free_rates(RATES, WEIGHTS)


_MEAN = sum(r * w for r, w in zip(RATES, WEIGHTS, strict=True))
_BETA = 1 / (1 - sum(f * f for f in FREQS))
STATES_SQL = "st(s, pi) AS (VALUES ('A', 0.1::DOUBLE), ('C', 0.2), ('G', 0.3), ('T', 0.4))"
CATEGORIES_SQL = f"cats(c, rate, w) AS (VALUES (0, {RATES[0] / _MEAN!r}::DOUBLE, 0.6::DOUBLE), (1, {RATES[1] / _MEAN!r}, 0.4))"
GRID_SQL = f"cats(c, rate, w) AS (VALUES {', '.join(f'({k}, {r}::DOUBLE, 0.2::DOUBLE)' for k, r in enumerate(GRID))})"
FOUR_SQL = f"{BASE_SQL}, pats4 AS (SELECT substr(pattern, 1, 4) AS pattern, sum(weight)::BIGINT AS weight FROM pats GROUP BY 1), {STATES_SQL}"


def change(up: str, down: str, branch: str, slope: bool) -> str:
    """P(up -> down) along a branch, or its derivative by the length; ``down`` may be a gap of the pattern."""
    t, gap = f"{LENGTHS[branch]} * rate * {_BETA!r}", f"{down}.s"
    if branch in "abcd":
        gap = f"substr(pattern, {'abcd'.index(branch) + 1}, 1)"
        pi = f"(SELECT pi FROM st WHERE st.s = {gap})"
        pi = f"CASE {gap} WHEN 'A' THEN 0.1 WHEN 'C' THEN 0.2 WHEN 'G' THEN 0.3 ELSE 0.4 END"
    else:
        pi = f"{down}.pi"
    same = f"CASE WHEN {up}.s = {gap} THEN 1 ELSE 0 END"
    value = f"(({pi}) - ({same})) * {_BETA!r} * rate * exp(-{t})" if slope else f"(({pi}) * (1 - exp(-{t})) + ({same}) * exp(-{t}))"
    return f"(CASE WHEN {gap} = '-' THEN {0 if slope else 1} ELSE {value} END)" if branch in "abcd" else value


def sites_sql(name: str, slope: str = "", cats: str = CATEGORIES_SQL) -> str:
    """(pattern, weight, c, rate, w, r, x, y, v): the joint probability with the states r, x, y of the inner nodes."""
    p = lambda up, down, branch: change(up, down, branch, branch == slope)
    return f"""{name}l AS (SELECT pattern, c, r.s AS r, x.s AS x, {p('r', 'x', 'x')} * {p('x', '', 'a')} * {p('x', '', 'b')} AS v FROM pats4, cats, st r, st x),
{name}r AS (SELECT pattern, c, r.s AS r, y.s AS y, {p('r', 'y', 'y')} * {p('y', '', 'c')} * {p('y', '', 'd')} AS v FROM pats4, cats, st r, st y),
{name} AS (SELECT l.pattern, p.weight, l.c, cats.rate, cats.w, l.r, l.x, q.y, st.pi * l.v * q.v AS v FROM {name}l l JOIN {name}r q ON q.pattern = l.pattern AND q.c = l.c AND q.r = l.r JOIN st ON st.s = l.r JOIN cats ON cats.c = l.c JOIN pats4 p ON p.pattern = l.pattern)"""


WHOLE_SQL = f"{FOUR_SQL}, {CATEGORIES_SQL}, {sites_sql('j')}, k AS (SELECT pattern, any_value(weight) AS weight, c, any_value(rate) AS rate, any_value(w) AS w, sum(v) AS v FROM j GROUP BY pattern, c)"


@query(f"{WHOLE_SQL}, p AS (SELECT pattern, any_value(weight) AS weight, sum(w * v) AS v FROM k GROUP BY 1) SELECT round(sum(weight * ln(v)), 4) AS lnl FROM p")
def quartet_likelihood(spark, sf):
    return rounded(likelihood.log_likelihood(patterns(spark, sf), tree(spark, sf), model(), rates()), 4)


@query(f"{WHOLE_SQL} SELECT pattern, any_value(weight)::DOUBLE AS weight, round(ln(sum(w * v)), 6) AS lnl, round(sum(w * v * rate) / sum(w * v), 6) AS rate FROM k GROUP BY 1")
def quartet_sites(spark, sf):
    return rounded(likelihood.site_likelihoods(patterns(spark, sf), tree(spark, sf), model(), rates()).select("pattern", "weight", "lnl", "rate"))


@query(f"""{WHOLE_SQL}, n AS (SELECT pattern, weight, unnest([0, 1, 2]) AS node, unnest([x, y, r]) AS s, w * v AS v FROM j),
m AS (SELECT pattern, any_value(weight) AS weight, node, s, sum(v) AS v FROM n GROUP BY pattern, node, s),
b AS (SELECT pattern, any_value(weight) AS weight, node, arg_max(s, v) AS s FROM m GROUP BY pattern, node)
SELECT pattern, any_value(weight)::DOUBLE AS weight, string_agg(s, '' ORDER BY node) AS states FROM b GROUP BY 1""")
def quartet_ancestors(spark, sf):
    return likelihood.reconstruct(patterns(spark, sf), tree(spark, sf), model(), rates())


SLOPES_SQL = ", ".join(sites_sql("d" + b, b) for b in BRANCHES)


@query(
    f"{WHOLE_SQL}, {SLOPES_SQL}, whole AS (SELECT pattern, sum(w * v) AS v FROM k GROUP BY 1), "
    + ", ".join(f"g{b} AS (SELECT {n} AS node, sum(z.weight * z.w * z.v / whole.v) AS slope FROM d{b} z JOIN whole ON whole.pattern = z.pattern)" for n, b in enumerate(BRANCHES))
    + " SELECT node::INTEGER AS node, round(slope, 3) AS slope FROM ("
    + " UNION ALL ".join(f"SELECT * FROM g{b}" for b in BRANCHES)
    + " UNION ALL SELECT 6, 0.0)"
)
def quartet_gradient(spark, sf):
    return rounded(likelihood.gradient(patterns(spark, sf), tree(spark, sf), model(), rates()), 3)


_BITS = [f"CASE substr(pattern, {k}, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END" for k in range(1, 5)]


@query(f"""{FOUR_SQL}, b AS (SELECT pattern, weight, {', '.join(f'{x} AS {n}' for x, n in zip(_BITS, 'abcd', strict=True))} FROM pats4),
u AS (SELECT *, CASE WHEN a & b = 0 THEN a | b ELSE a & b END AS x, CASE WHEN c & d = 0 THEN c | d ELSE c & d END AS y FROM b)
SELECT pattern, weight::DOUBLE AS weight, ((a & b = 0)::INT + (c & d = 0)::INT + (x & y = 0)::INT)::BIGINT AS score FROM u""")
def quartet_parsimony(spark, sf):
    return likelihood.parsimony(patterns(spark, sf), tree(spark, sf)).drop("states")


@query(f"{FOUR_SQL}, {GRID_SQL}, {sites_sql('j')}, k AS (SELECT pattern, any_value(weight) AS weight, rate, sum(v) AS v FROM j WHERE length(replace(pattern, '-', '')) >= 2 GROUP BY pattern, rate) SELECT pattern, any_value(weight)::DOUBLE AS weight, arg_max(rate, v) AS rate FROM k GROUP BY pattern")
def quartet_best_rates(spark, sf):
    """CAT: each pattern's best rate of a grid; patterns of a single state have none."""
    return search.best_rates(patterns(spark, sf, known=2), tree(spark, sf), model(), GRID)


def _distance_tree(spark, sf, n: int, method) -> DataFrame:
    """(i, j, d): path lengths between the tips of a distance tree of the first taxa."""
    names = [str(t) for t in S.taxa(spark, sf)[:n]]
    d = distances.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "raw")
    found: Tree = method(names, cluster.matrix(d.where((F.col("i") < n) & (F.col("j") < n)), n))
    rows = found.rows()
    label = [r["name"] or f"#{r['node']}" for r in rows]
    edges = [(0, label[k], None if r["parent"] is None else label[r["parent"]], None if r["length"] is None else float(r["length"])) for k, r in enumerate(rows)]
    at = spark.createDataFrame([(t, k) for k, t in enumerate(names)], "name string, at int")
    paths = T.patristic(spark.createDataFrame(edges, "tree long, child string, parent string, length double"))
    left, right = at.select(F.col("name").alias("i"), F.col("at").alias("_i")), at.select(F.col("name").alias("j"), F.col("at").alias("_j"))
    both = paths.join(F.broadcast(left), "i").join(F.broadcast(right), "j")  # a row per taxon
    return both.select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "d")


NEAR_SQL = f"{PAIRS_SQL}, e AS (SELECT i, j, diff / n AS d FROM pairs WHERE j < 4), full_ AS (SELECT i, j, d FROM e UNION ALL SELECT j, i, d FROM e)"


@query(f"""{NEAR_SQL}, sums AS (SELECT x.i AS a, x.j AS b, x.d + y.d AS s, y.i AS c, y.j AS z FROM e x JOIN e y ON x.i = 0 AND y.i <> 0 AND y.i <> x.j AND y.j <> x.j),
best AS (SELECT * FROM sums ORDER BY s LIMIT 1), inner_ AS (SELECT greatest(0, ((SELECT sum(s) FROM sums) - (SELECT s FROM best)) / 4 - (SELECT s FROM best) / 2) AS l),
tip AS (SELECT f.i AS t, greatest(0, (f.d + (sum(o.d) - sum(m.d)) / 2) / 2) AS l FROM full_ f JOIN best ON (f.i IN (a, b) AND f.j IN (a, b)) OR (f.i IN (c, z) AND f.j IN (c, z))
  JOIN full_ o ON o.i = f.i AND o.j <> f.j JOIN full_ m ON m.i = f.j AND m.j = o.j GROUP BY f.i, f.d)
SELECT e.i, e.j, round(p.l + q.l + CASE WHEN (e.i IN (a, b)) = (e.j IN (a, b)) THEN 0 ELSE inner_.l END, 6) AS d FROM e JOIN tip p ON p.t = e.i JOIN tip q ON q.t = e.j, best, inner_""")
def quartet_nj(spark, sf):
    """Four taxa have three topologies; the lengths of the best one are closed."""
    return rounded(_distance_tree(spark, sf, 4, cluster.neighbour_joining))


@query(f"{NEAR_SQL}, three AS (SELECT * FROM e WHERE j < 3), best AS (SELECT i, j, d FROM three ORDER BY d LIMIT 1) SELECT t.i, t.j, round(CASE WHEN t.i = best.i AND t.j = best.j THEN t.d ELSE (SELECT avg(o.d) FROM three o WHERE (o.i, o.j) <> (best.i, best.j)) END, 6) AS d FROM three t, best")
def triplet_upgma(spark, sf):
    return rounded(_distance_tree(spark, sf, 3, cluster.upgma))


POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(13)]


def draw_sql(*keys: str) -> str:
    """Poisson(1) by inversion of the digest of the keys."""
    u = f"('0x' || substr(md5('1|' || {" || '|' || ".join(f'({k})::VARCHAR' for k in keys)}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(POISSON)) + " ELSE 13 END"


@query(f"""{BASE_SQL}, each AS (SELECT pattern, r, {draw_sql('r', 'pattern', 'k')} AS w FROM (SELECT pattern, unnest(range(1, weight + 1)) AS k FROM pats), (SELECT unnest(range(0, 20)) AS r))
SELECT r::INTEGER AS replicate, pattern, sum(w)::BIGINT AS weight FROM each WHERE w > 0 GROUP BY 1, 2""")
def bootstrap_patterns(spark, sf):
    return R.bootstrap_weights(S.patterns(spark, sf), 20)


@query(f"""WITH each AS (SELECT event_type, value, r, {draw_sql('r', 'event_id')} AS w FROM events, (SELECT unnest(range(0, 50)) AS r))
SELECT event_type, r::INTEGER AS replicate, round(sum(w * value) / sum(w), 4) AS mean FROM each WHERE w > 0 GROUP BY 1, 2""")
def bootstrap_means(spark, sf):
    return rounded(R.bootstrap_means(S.table(spark, sf, "events"), "event_type", "value", 50, row=F.col("event_id")), 4)


def below_sql(x: str) -> str:
    """P(Z <= x) by the series of the integral of the normal density."""
    terms = "[" + ", ".join(f"[{k}.0, 0.0]" for k in range(1, 91)) + "]"
    near = f"least(greatest({x}, -6.5::DOUBLE), 6.5::DOUBLE)"
    return f"(0.5 + list_reduce(list_concat([[{near}, {near}]], {terms}::DOUBLE[][]), lambda run_, at_: [run_[1] * {near} * {near} / (2 * at_[1] + 1), run_[2] + run_[1] * {near} * {near} / (2 * at_[1] + 1)])[2] * exp(-{near} * {near} / 2) / sqrt(2 * pi()))"


QUANTILE_SQL = """quantiles(p, low, high, k) AS (SELECT p, -6.5::DOUBLE, 6.5::DOUBLE, 0 FROM wanted UNION ALL SELECT p, CASE WHEN under THEN mid ELSE low END, CASE WHEN under THEN high ELSE mid END, k + 1
  FROM (SELECT *, """ + below_sql("mid") + """ < p AS under FROM (SELECT *, (low + high) / 2 AS mid FROM quantiles WHERE k < 50))), q AS (SELECT p, (low + high) / 2 AS z FROM quantiles WHERE k = 50)"""


@query(f"""WITH RECURSIVE each AS (SELECT event_type, value, r, {draw_sql('r', 'event_id')} AS w FROM events, (SELECT unnest(range(0, 50)) AS r)),
boot AS (SELECT event_type, r, sum(w * value) / sum(w) AS m FROM each WHERE w > 0 GROUP BY 1, 2), est AS (SELECT event_type, avg(value) AS e, sum(value) AS s, count(*) AS n FROM events GROUP BY 1),
jack AS (SELECT event_type, (s - value) / (n - 1) AS j FROM events JOIN est USING (event_type)), mean AS (SELECT event_type, avg(j) AS m FROM jack GROUP BY 1),
acc AS (SELECT event_type, sum((m - j) ** 3) / (6 * sum((m - j) ** 2) ** 1.5) AS a FROM jack JOIN mean USING (event_type) GROUP BY 1),
share AS (SELECT event_type, count(*) AS b, least(greatest(avg((m < e)::INTEGER), 1e-9), 1 - 1e-9) AS p FROM boot JOIN est USING (event_type) GROUP BY 1),
wanted AS (SELECT DISTINCT p FROM share UNION SELECT 0.025 UNION SELECT 0.975), {QUANTILE_SQL},
z AS (SELECT event_type, b, a, q.z AS z0, side, q.z + t.z AS z FROM share JOIN acc USING (event_type) JOIN q USING (p), (SELECT CASE WHEN p < 0.5 THEN 'low' ELSE 'high' END AS side, z FROM q WHERE p IN (0.025, 0.975)) t),
at_ AS (SELECT *, least(greatest(ceil({below_sql('(z0 + z / (1 - a * z))')} * b), 1), b) AS k FROM z),
ranked AS (SELECT event_type, m, row_number() OVER (PARTITION BY event_type ORDER BY m) AS k FROM boot)
SELECT event_type, round(any_value(z0), 6) AS z0, round(any_value(a) * 1000, 6) AS acceleration, round(max(m) FILTER (side = 'low'), 4) AS low, round(max(m) FILTER (side = 'high'), 4) AS high FROM at_ JOIN ranked USING (event_type, k) GROUP BY 1""")
def bca_intervals(spark, sf):
    """Bias-corrected and accelerated intervals of the mean value of every event type."""
    events = S.table(spark, sf, "events")
    boot = R.bootstrap_means(events, "event_type", "value", 50, row=F.col("event_id")).withColumnRenamed("mean", "value")
    found = R.bca_intervals(boot, R.leave_one_out_means(events, ["event_type"], "value"), events.groupBy("event_type").agg(F.avg("value").alias("value")), ["event_type"])
    return found.select("event_type", F.round("z0", 6).alias("z0"), F.round(F.col("acceleration") * 1000, 6).alias("acceleration"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
