"""Queries over trees and coalescent events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrolith.operators import coalescent as C
from dendrolith.operators import density as Y
from dendrolith.operators import trees as T
from dendrolith.plans import standins as S
from dendrolith.plans.standins import rounded, table
from dendrolith.sources import trees as newick

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The geography tree: regions, nations, customers and orders under one root; lengths from the tables' own figures.
GEO_SQL = """geo AS (
  SELECT 0::BIGINT AS tree, 'r' || r_regionkey AS child, 'root' AS parent, (r_regionkey + 1)::DOUBLE AS length, 1.0::DOUBLE AS rate FROM region
  UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 7 + 1)::DOUBLE, 0.5 FROM nation
  UNION ALL SELECT 0, 'c' || c_custkey, 'n' || c_nationkey, abs(c_acctbal) / 1000 + 1, 2.0 FROM customer
  UNION ALL SELECT 0, 'o' || o_orderkey, 'c' || o_custkey, o_totalprice / 100000, 0.25 FROM orders)"""
WALK_SQL = f"""WITH RECURSIVE {GEO_SQL}, walk AS (
  SELECT 0::BIGINT AS tree, 'root' AS node, 0::BIGINT AS depth, 0::DOUBLE AS distance
  UNION ALL SELECT w.tree, g.child, w.depth + 1, w.distance + g.length FROM walk w JOIN geo g ON g.parent = w.node)"""


def geography(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda t, child, parent, length, rate: table(spark, sf, t).select(F.lit(0).cast("long").alias("tree"), child.alias("child"), parent.alias("parent"), length.cast("double").alias("length"), F.lit(rate).alias("rate"))
    parts = [
        row("region", key("r", "r_regionkey"), F.lit("root"), F.col("r_regionkey") + 1, 1.0), row("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_nationkey") % 7 + 1, 0.5),
        row("customer", key("c", "c_custkey"), key("n", "c_nationkey"), F.abs("c_acctbal") / 1000 + 1, 2.0), row("orders", key("o", "o_orderkey"), key("c", "o_custkey"), F.col("o_totalprice") / 100000, 0.25),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{WALK_SQL} SELECT node, depth, round(distance, 8) AS distance FROM walk")
def root_distance(spark, sf):
    return rounded(T.root_paths(geography(spark, sf)).select("node", "depth", "distance"), 8)


@query(f"{WALK_SQL}, ends AS (SELECT c.c_nationkey, c.c_custkey, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY 1, 2), bare AS (SELECT 'c' || c_custkey AS node, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), up AS (SELECT 'c' || c_custkey AS node, n FROM ends UNION ALL SELECT 'n' || c_nationkey, n FROM ends UNION ALL SELECT 'n' || c_nationkey, 1 FROM bare), all_up AS (SELECT * FROM up UNION ALL SELECT 'r' || n_regionkey, n FROM up JOIN nation ON node = 'n' || n_nationkey), nothing AS (SELECT 'r' || n_regionkey AS node, 1 AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)), e AS (SELECT * FROM all_up UNION ALL SELECT * FROM nothing), f AS (SELECT * FROM e UNION ALL SELECT 'root', n FROM e WHERE node LIKE 'r%' UNION ALL SELECT 'root', 1 FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) SELECT node, sum(n)::BIGINT AS n_tips FROM f GROUP BY node")
def tip_counts(spark, sf):
    return T.tip_counts(geography(spark, sf)).select("node", "n_tips")


@query(f"WITH {GEO_SQL} SELECT count(*) AS n, round(sum(length), 4) AS total, round(avg(rate), 6) AS mean_rate, round(sum(rate * length) / sum(length), 6) AS scaled_rate FROM geo")
def mean_rates(spark, sf):
    found = T.lengths(geography(spark, sf))
    return found.select("n", F.round("total", 4).alias("total"), F.round("mean_rate", 6).alias("mean_rate"), F.round("scaled_rate", 6).alias("scaled_rate"))


@query(f"{WALK_SQL}, h AS (SELECT node, max(distance) OVER () - distance AS height FROM walk) SELECT g.parent AS node, round(max(height), 8) AS bound FROM geo g JOIN h ON h.node = g.child GROUP BY 1")
def height_bounds(spark, sf):
    geo = geography(spark, sf)
    return rounded(T.height_bounds(geo, T.heights(geo)).select("node", "bound"), 8)


@query(f"WITH {GEO_SQL} SELECT 1::BIGINT AS n_roots, 0::BIGINT AS n_many_parents, 0::BIGINT AS n_loops")
def topology_check(spark, sf):
    return T.check(geography(spark, sf)).select("n_roots", "n_many_parents", "n_loops")


#: A tree of five tips per nation: the letters in an order and the shape by its number, lengths by its number and the place.
SHAPES = ["((((0,1)5,2)6,3)7,4)", "(((0,1)5,(2,3)6)7,4)"]
#: Of each shape, the parent of node 0 to 7; 8 is the root.
ABOVE = [[5, 5, 6, 7, 8, 6, 7, 8], [5, 5, 6, 6, 8, 7, 7, 8]]


def forest_lines(spark, sf):
    """(tree, newick)."""
    k = F.col("n_nationkey")
    length = lambda at: F.concat(F.lit(":"), (1 + (k * (at + 1) + at) % 5).cast("string"))
    tip = lambda at: F.concat(F.substring(F.lit("abcdeabcde"), k % 5 + 1 + at, 1), length(at))

    def text(shape: str) -> F.Column:
        parts = []
        for at, c in enumerate(shape):
            parts.append((tip(int(c)) if int(c) < 5 else length(int(c))) if c.isdigit() else F.lit(c))
        return F.concat(*parts, F.lit(";"))

    return table(spark, sf, "nation").select(k.cast("long").alias("tree"), F.when(F.col("n_regionkey") % 2 == 0, text(SHAPES[0])).otherwise(text(SHAPES[1])).alias("newick"))


def forest(spark, sf):
    return newick.edges(forest_lines(spark, sf))


def forest_sql() -> str:
    name = lambda at: f"substr('abcdeabcde', n_nationkey % 5 + {at + 1}, 1)" if at < 5 else f"'#{at}'"
    rows = [f"SELECT n_nationkey, {name(at)}, '#{up}', (1 + (n_nationkey * {at + 1} + {at}) % 5)::DOUBLE FROM nation WHERE n_regionkey % 2 = {shape}" for shape in (0, 1) for at, up in enumerate(ABOVE[shape])]
    return f"edges(tree, child, parent, length) AS ({' UNION ALL '.join(rows)})"


TIPS_SQL = f"""WITH RECURSIVE {forest_sql()}, anc(tree, node, ancestor, steps, d) AS (
  SELECT DISTINCT tree, child, child, 0, 0::DOUBLE FROM edges UNION ALL SELECT a.tree, a.node, e.parent, a.steps + 1, a.d + e.length FROM anc a JOIN edges e ON e.tree = a.tree AND e.child = a.ancestor),
tips AS (SELECT tree, child AS node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges p WHERE p.tree = e.tree AND p.parent = e.child)),
up AS (SELECT a.* FROM anc a JOIN tips t ON t.tree = a.tree AND t.node = a.node),
sets AS (SELECT tree, ancestor, list(node ORDER BY node) AS s FROM up GROUP BY 1, 2),
named AS (SELECT tree, list(node ORDER BY node) AS allt FROM tips GROUP BY 1),
splits AS (SELECT tree, split, sum(length) AS length FROM (SELECT e.tree, e.length, array_to_string(CASE WHEN list_contains(s, allt[1]) THEN s ELSE list_filter(allt, lambda x: NOT list_contains(s, x)) END, ',') AS split
  FROM edges e JOIN sets k ON k.tree = e.tree AND k.ancestor = e.child JOIN named n ON n.tree = e.tree WHERE len(s) > 1 AND len(s) < len(allt) - 1) GROUP BY 1, 2)"""


@query(f"{TIPS_SQL} SELECT tree::BIGINT AS tree, array_to_string(s, ',') AS clade FROM sets WHERE len(s) > 1")
def clades(spark, sf):
    return T.clades(forest(spark, sf)).select("tree", "clade")


@query(f"{TIPS_SQL} SELECT tree::BIGINT AS tree, split, round(length, 6) AS length FROM splits")
def splits(spark, sf):
    return rounded(T.splits(forest(spark, sf)))


PAIRS_SQL = f"""{TIPS_SQL}, own AS (SELECT tree, count(*) AS n, sum(length * length) AS ss FROM splits GROUP BY 1),
m AS (SELECT x.tree AS a, y.tree AS b, any_value(x.n) AS na, any_value(y.n) AS nb, any_value(x.ss) AS sa, any_value(y.ss) AS sb, count(r.split) AS m, coalesce(sum(l.length * r.length) FILTER (WHERE r.split IS NOT NULL), 0) AS dot
  FROM own x JOIN own y ON x.tree < y.tree JOIN splits l ON l.tree = x.tree LEFT JOIN splits r ON r.tree = y.tree AND r.split = l.split GROUP BY 1, 2)"""


@query(f"{PAIRS_SQL} SELECT a::BIGINT AS a, b::BIGINT AS b, round((na + nb - 2 * m) / 2, 6) AS rf, round((na + nb - 2 * m) / (na + nb), 6) AS normalised, round(sqrt(greatest(sa + sb - 2 * dot, 0)), 6) AS branch_score FROM m")
def robinson_foulds(spark, sf):
    return rounded(T.robinson_foulds(T.splits(forest(spark, sf))))


@query(f"{PAIRS_SQL} SELECT a::BIGINT AS a, b::BIGINT AS b, round(dot / sb, 6) AS k, round(sqrt(greatest(sa - dot * dot / sb, 0)), 6) AS score FROM m")
def k_tree(spark, sf):
    return rounded(T.k_tree_scores(T.splits(forest(spark, sf))))


@query(f"""{TIPS_SQL}, meet AS (SELECT l.tree, l.node AS i, r.node AS j, l.d + r.d AS d, row_number() OVER (PARTITION BY l.tree, l.node, r.node ORDER BY l.steps + r.steps) AS k FROM up l JOIN up r ON l.tree = r.tree AND l.ancestor = r.ancestor AND l.node < r.node)
SELECT tree::BIGINT AS tree, i, j, round(d, 6) AS d FROM meet WHERE k = 1""")
def patristic(spark, sf):
    return rounded(T.patristic(forest(spark, sf)))


@query(f"""{TIPS_SQL}, kids AS (SELECT e.tree, e.parent, list(array_to_string(s, ',') ORDER BY array_to_string(s, ',')) AS sides FROM edges e JOIN sets k ON k.tree = e.tree AND k.ancestor = e.child GROUP BY 1, 2),
c AS (SELECT array_to_string(s, ',') AS clade, array_to_string(sides, '|') AS sides, count(*) AS n FROM kids JOIN sets ON sets.tree = kids.tree AND ancestor = parent GROUP BY 1, 2)
SELECT clade, sides, n, round(n / sum(n) OVER (PARTITION BY clade), 6) AS share FROM c""")
def sbn_conditionals(spark, sf):
    return rounded(T.subsplit_network(forest(spark, sf)))


@query(f"""{TIPS_SQL}, dist AS (SELECT tree, node, max(d) AS d FROM anc GROUP BY 1, 2 UNION ALL SELECT DISTINCT tree, parent, 0::DOUBLE FROM edges p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.tree = p.tree AND e.child = p.parent)),
h AS (SELECT tree, node, max(d) OVER (PARTITION BY tree) - d AS height FROM dist),
low AS (SELECT u.tree, ancestor AS node, max(height) AS lower FROM up u JOIN h ON h.tree = u.tree AND h.node = u.node WHERE steps > 0 GROUP BY 1, 2)
SELECT low.tree::BIGINT AS tree, round(sum(ln(h.height - lower)), 6) AS lj FROM low JOIN edges e ON e.tree = low.tree AND e.child = low.node JOIN h ON h.tree = e.tree AND h.node = e.parent GROUP BY 1""")
def log_jacobian(spark, sf):
    f = forest(spark, sf)
    return rounded(T.log_jacobian(f, T.heights(f)))


@query("SELECT CAST(o_orderkey AS BIGINT) AS node, round(max(epoch(o_orderdate) / 86400) OVER (PARTITION BY o_custkey) - epoch(o_orderdate) / 86400, 6) AS height FROM orders")
def dated_heights(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").cast("long").alias("node"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("date"))
    return rounded(T.dated_heights(days, "date").select("node", "height"))


#: Every customer's orders as events: open orders sample a lineage, others are coalescences, times in years before the last.
EVENTS_SQL = """ev AS (SELECT o_custkey AS tree, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 's' ELSE 'c' END AS kind,
  (max(epoch(o_orderdate)) OVER (PARTITION BY o_custkey) - epoch(o_orderdate)) / 86400 / 365 AS t FROM orders)"""
ROWS_SQL = f"""WITH {EVENTS_SQL}, iv AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS dt, coalesce(sum((kind = 's')::INT) OVER b, 0)::BIGINT AS ns, coalesce(sum((kind = 'c')::INT) OVER b, 0)::BIGINT AS n_coal
  FROM ev WINDOW w AS (PARTITION BY tree ORDER BY t, id), b AS (PARTITION BY tree ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
iv2 AS (SELECT *, ns - n_coal AS k, (ns - n_coal) * (ns - n_coal - 1) / 2 AS pairs FROM iv)"""


def order_events(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderstatus") == "O", "s").otherwise("c").alias("kind"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("e"))
    from pyspark.sql import Window

    return o.withColumn("t", (F.max("e").over(Window.partitionBy("tree")) - F.col("e")) / 86400 / 365).drop("e")


def order_rows(spark, sf):
    return C.intervals(order_events(spark, sf))


@query(f"{ROWS_SQL} SELECT tree, id::BIGINT AS id, kind, round(dt, 6) AS dt, k, n_coal FROM iv2")
def coalescent_intervals(spark, sf):
    return rounded(order_rows(spark, sf).select("tree", "id", "kind", "dt", "k", "n_coal"))


@query(f"{ROWS_SQL} SELECT tree, id::BIGINT AS id, (ns - n_coal + CASE kind WHEN 's' THEN 1 ELSE -1 END)::BIGINT AS k FROM iv")
def lineages_through_time(spark, sf):
    return C.lineages(order_events(spark, sf)).select("tree", "id", "k")


@query(f"{ROWS_SQL} SELECT tree, round(sum(-pairs * dt / 3 - CASE WHEN kind = 'c' THEN ln(3) ELSE 0 END), 6) AS lp FROM iv2 GROUP BY tree")
def coalescent_constant(spark, sf):
    return rounded(C.constant(order_rows(spark, sf), 3.0))


@query(f"{ROWS_SQL} SELECT tree, round(sum(-pairs * (exp(t * 0.1) - exp((t - dt) * 0.1)) / 0.3 - CASE WHEN kind = 'c' THEN ln(3) - t * 0.1 ELSE 0 END), 6) AS lp FROM iv2 GROUP BY tree")
def coalescent_exponential(spark, sf):
    return rounded(C.exponential(order_rows(spark, sf), 3.0, 0.1))


@query(f"{ROWS_SQL}, per AS (SELECT tree, n_coal, sum(pairs * dt) AS theta, bool_or(kind = 'c') AS ends FROM iv2 GROUP BY 1, 2) SELECT tree, n_coal, round(theta, 6) AS theta, round(-1 - ln(theta), 5) AS lp FROM per WHERE ends AND theta > 0")
def classical_skyline(spark, sf):
    found = C.classical_skyline(order_rows(spark, sf))
    return found.select("tree", "n_coal", F.round("theta", 6).alias("theta"), F.round("lp", 5).alias("lp"))


@query(f"{ROWS_SQL}, z AS (SELECT *, [3.0, 10.0, 4.0, 2.0, 3.0][least(n_coal, 4) + 1]::DOUBLE AS size FROM iv2) SELECT tree, round(sum(-pairs * dt / size - CASE WHEN kind = 'c' THEN ln(size) ELSE 0 END), 6) AS lp FROM z GROUP BY tree")
def skyride(spark, sf):
    return rounded(C.skyride(order_rows(spark, sf), [3, 10, 4, 2, 3]))


@query(f"{ROWS_SQL}, z AS (SELECT *, CASE WHEN n_coal >= 5 THEN 4.0 WHEN n_coal >= 2 THEN 10.0 ELSE 3.0 END::DOUBLE AS size FROM iv2) SELECT tree, round(sum(-pairs * dt / size - CASE WHEN kind = 'c' THEN ln(size) ELSE 0 END), 6) AS lp FROM z GROUP BY tree")
def skyline_groups(spark, sf):
    return rounded(C.skyline(order_rows(spark, sf), [3, 10, 4], [2, 3, 100]))


GRID_SQL = f"""WITH {EVENTS_SQL}, g AS (SELECT tree, t, kind, id FROM ev UNION ALL SELECT tree, p, 'g', 1::BIGINT << 40 FROM (SELECT DISTINCT tree FROM ev), (SELECT unnest([1.0, 2.0, 3.0, 4.0]::DOUBLE[]) AS p)),
iv AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS dt, coalesce(sum((kind = 's')::INT - (kind = 'c')::INT) OVER b, 0) AS k, coalesce(sum((kind = 'g')::INT) OVER b, 0)::INT AS n_grid
  FROM g WINDOW w AS (PARTITION BY tree ORDER BY t, id), b AS (PARTITION BY tree ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, k * (k - 1) / 2 AS pairs, [3.0, 10.0, 4.0, 2.0, 3.0] AS v, least(n_grid, 4) AS i FROM iv)"""


@query(f"{GRID_SQL} SELECT tree, round(sum(-pairs * dt / exp(v[i + 1] / 4) - CASE WHEN kind = 'c' THEN v[i + 1] / 4 ELSE 0 END), 6) AS lp FROM z GROUP BY tree")
def skygrid(spark, sf):
    return rounded(C.skygrid(order_events(spark, sf), [x / 4 for x in (3, 10, 4, 2, 3)], 4.0, log_space=True))


@query(f"""{GRID_SQL}, y AS (SELECT *, CASE WHEN i >= 4 THEN 3.0 ELSE v[i + 1] + (v[i + 2] - v[i + 1]) * (t - i) END::DOUBLE AS e, CASE WHEN i >= 4 THEN 3.0 ELSE v[i + 1] + (v[i + 2] - v[i + 1]) * (t - dt - i) END::DOUBLE AS s FROM z)
SELECT tree, round(sum(-pairs * CASE WHEN abs(e - s) < 1e-12 THEN dt / e ELSE dt * (ln(e) - ln(s)) / (e - s) END - CASE WHEN kind = 'c' THEN ln(e) ELSE 0 END), 6) AS lp FROM y GROUP BY tree""")
def piecewise_linear(spark, sf):
    return rounded(C.piecewise_linear(order_events(spark, sf), [3, 10, 4, 2, 3], 4.0))


@query(f"WITH {GEO_SQL}, t AS (SELECT sum(length) AS total FROM geo) SELECT event_type, round(avg(0.5 * ln(total) - 0.5723649429247001 - 0.5 * ln(value) - value * total), 2) AS lp FROM events, t GROUP BY 1")
def ctmc_scale(spark, sf):
    total = T.lengths(geography(spark, sf)).select(F.col("total").alias("_t"))
    rows = table(spark, sf, "events").crossJoin(F.broadcast(total))  # one tree, hence one row
    return rounded(rows.groupBy("event_type").agg(F.avg(Y.ctmc_scale(F.col("value"), F.col("_t"))).alias("lp")), 2)


@query("SELECT p_size, round(-sum(ln(k)), 6) AS lp FROM (SELECT DISTINCT p_size FROM part), LATERAL (SELECT unnest(range(1, greatest(1, 2 * p_size - 5) + 1, 2)) AS k) GROUP BY p_size")
def uniform_topology(spark, sf):
    return rounded(table(spark, sf, "part").select("p_size").distinct().select("p_size", Y.uniform_topology(F.col("p_size")).alias("lp")))
