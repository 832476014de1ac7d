"""Queries over collections of trees, and their SQL.

The calendar forest has a tree per customer: years under the root, months under years, orders under months; an order's date
dates its tip. The ballot forest has a tree of eight tips per order, of two shapes and several orders of the tips.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrolith.operators import consensus as K
from dendrolith.operators import subsplits as B
from dendrolith.operators import sweeps as W
from dendrolith.operators.scans import settled
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


@query(f"""WITH RECURSIVE {GEO_SQL}, walk AS (SELECT 'root' AS node, 'root' || chr(1) AS path UNION ALL SELECT g.child, w.path || g.child || chr(1) FROM walk w JOIN geo g ON g.parent = w.node)
SELECT node, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS preorder, (row_number() OVER (ORDER BY path || chr(127)) - 1)::BIGINT AS postorder FROM walk""")
def traversals(spark, sf):
    """Ranks of all nodes of the geography tree, orders included."""
    return W.ranks(geography(spark, sf)).select("node", "preorder", "postorder")


CAL_SQL = """o AS (SELECT o_custkey AS tree, 'o' || o_orderkey AS o, 'm' || strftime(o_orderdate, '%Y-%m') AS m, 'y' || strftime(o_orderdate, '%Y') AS y, 0.5::DOUBLE + (year(o_orderdate) - 1990)::DOUBLE / 10 AS ly,
  month(o_orderdate)::DOUBLE / 12 AS lm, o_totalprice / 100000 + 0.1::DOUBLE AS lo, epoch(o_orderdate) / 86400 / 365.25::DOUBLE - 25 AS date, o_orderstatus AS status FROM orders),
cal AS (SELECT DISTINCT tree, y AS node, 'root' AS parent, ly AS length, ly AS far, y, NULL AS m FROM o UNION ALL SELECT DISTINCT tree, m, y, lm, ly + lm, y, m FROM o UNION ALL SELECT tree, o, m, lo, ly + lm + lo, y, m FROM o),
every_ AS (SELECT tree, node, parent, length, far, y, m FROM cal UNION ALL SELECT DISTINCT tree, 'root', NULL, 0::DOUBLE, 0::DOUBLE, NULL, NULL FROM o)"""


def calendar_orders(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tree"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"), F.concat(F.lit("m"), F.date_format(day, "yyyy-MM")).alias("m"), F.concat(F.lit("y"), F.date_format(day, "yyyy")).alias("y"),
        (F.lit(0.5) + (F.year(day) - 1990).cast("double") / 10).alias("ly"), (F.month(day).cast("double") / 12).alias("lm"), (F.col("o_totalprice") / 100000 + F.lit(0.1)).alias("lo"),
        (F.unix_micros(day) / 1e6 / 86400 / 365.25 - 25).alias("date"), F.col("o_orderstatus").alias("status"),
    )


def calendar(spark, sf):
    """(tree, child, parent, length)."""
    o = calendar_orders(spark, sf)
    years = o.select("tree", F.col("y").alias("child"), F.lit("root").alias("parent"), F.col("ly").alias("length")).distinct()
    months = o.select("tree", F.col("m").alias("child"), F.col("y").alias("parent"), F.col("lm").alias("length")).distinct()
    return years.union(months).union(o.select("tree", "o", "m", "lo"))


ROOTS_SQL = f"""WITH {CAL_SQL}, x AS (SELECT tree, o, y, m, date, ly, ly + lm AS lym, ly + lm + lo AS far FROM o),
e AS (SELECT c.tree, c.node, c.length, c.far, c.far - c.length AS p_far, CASE WHEN c.node = c.y THEN NULL ELSE c.y END AS py, CASE WHEN c.node = c.y OR c.node = c.m THEN NULL ELSE c.m END AS pm FROM cal c),
d AS (SELECT e.tree, e.node, e.length, x.date AS t, CASE WHEN e.node IN (x.o, x.m, x.y) THEN 1.0 ELSE -1.0 END::DOUBLE AS s,
  CASE WHEN e.node IN (x.o, x.m, x.y) THEN x.far - e.far ELSE e.length + p_far + x.far - 2 * CASE WHEN x.m = pm THEN x.lym WHEN x.y = py THEN x.ly ELSE 0 END END AS v FROM e JOIN x USING (tree)),
c AS (SELECT tree, node, any_value(length) AS length, count(*) AS n, min(s) <> max(s) AS two, count(*) * var_pop(t) AS tt, count(*) * var_pop(v) AS vv, count(*) * covar_pop(v, s) AS vs, count(*) * var_pop(s) AS ss, count(*) * covar_pop(t, v) AS tv, count(*) * covar_pop(t, s) AS ts FROM d GROUP BY 1, 2),
f AS (SELECT *, vs - CASE WHEN tt > 1e-9 * n THEN tv * ts / tt ELSE 0 END AS r1, ss - CASE WHEN tt > 1e-9 * n THEN ts * ts / tt ELSE 0 END AS r2 FROM c),
g AS (SELECT *, least(greatest(CASE WHEN n >= 3 AND two AND r2 > 1e-9 * n THEN -r1 / r2 ELSE length / 2 END, 0), length) AS x FROM f)
SELECT tree, node, round(x / length, 3) AS share, round(greatest(vv + 2 * x * vs + x * x * ss - CASE WHEN tt > 1e-9 * n THEN (tv + x * ts) ** 2 / tt ELSE 0 END, 0), 6) AS sse FROM g"""


@query(ROOTS_SQL)
def root_positions(spark, sf):
    """The best root on every branch of every tree, by the regression of distances on dates."""
    dates = calendar_orders(spark, sf).select(F.col("o").alias("node"), "date")
    found = W.roots_on_branches(calendar(spark, sf), dates)
    return found.select("tree", "node", F.round("share", 3).alias("share"), F.round("sse", 6).alias("sse"))


RATIOS_SQL = f"""{CAL_SQL}, top AS (SELECT tree, max(ly + lm + lo) AS top FROM o GROUP BY 1),
low AS (SELECT tree, node, max(top - far) AS low FROM (SELECT tree, unnest(['root', y, m]) AS node, ly + lm + lo AS far FROM o) JOIN top USING (tree) GROUP BY 1, 2),
h AS (SELECT e.tree, e.node, e.parent, top - far AS height, low FROM every_ e JOIN top USING (tree) JOIN low ON low.tree = e.tree AND low.node = e.node),
r AS (SELECT h.*, p.height AS above, CASE WHEN h.parent IS NULL THEN h.height ELSE (h.height - h.low) / (p.height - h.low) END AS ratio FROM h LEFT JOIN h p ON p.tree = h.tree AND p.node = h.parent)"""


@query(f"WITH {RATIOS_SQL} SELECT tree, node, round(low, 8) AS low, round(ratio, 8) AS ratio, round(height, 8) AS height FROM r")
def height_ratios(spark, sf):
    """Ratios of all inner nodes of all trees, and the heights that they give back."""
    inner = W.to_ratios(W.heights_below(W.nodes_of(calendar(spark, sf))))
    return rounded(W.from_ratios(inner.select("tree", "node", "parent", "low", "ratio"), ["low", "ratio"]), 8)


def slopes_sql(by: str) -> str:
    return f"""b AS (SELECT *, {by} AS own FROM r), tm AS (SELECT tree, node, parent, above, low, ratio, own AS total FROM b WHERE node LIKE 'm%'),
ty AS (SELECT b.tree, b.node, b.parent, b.above, b.low, b.ratio, own + (SELECT sum(tm.ratio * tm.total) FROM tm WHERE tm.tree = b.tree AND tm.parent = b.node) AS total FROM b WHERE node LIKE 'y%'),
tr AS (SELECT b.tree, b.node, own + (SELECT sum(ty.ratio * ty.total) FROM ty WHERE ty.tree = b.tree) AS slope FROM b WHERE node = 'root')
SELECT tree, node, slope FROM tr UNION ALL SELECT tree, node, total * (above - low) FROM ty UNION ALL SELECT tree, node, total * (above - low) FROM tm"""


@query(f"WITH {RATIOS_SQL}, plain AS (WITH {slopes_sql('height')}), whole AS (WITH gaps AS (SELECT tree, parent, sum(1 / (above - low)) AS g FROM r WHERE parent IS NOT NULL GROUP BY 1, 2), {slopes_sql('height + coalesce((SELECT g FROM gaps WHERE gaps.tree = r.tree AND gaps.parent = r.node), 0)')}) SELECT tree, node, round(plain.slope, 6) AS slope, round(whole.slope, 6) AS with_jacobian FROM plain JOIN whole USING (tree, node)")
def ratio_slopes(spark, sf):
    """The gradient of half the sum of squared heights by ratios and root heights, without and with the transform's log-determinant."""
    inner = settled(W.to_ratios(W.heights_below(W.nodes_of(calendar(spark, sf)))))
    by = inner.select("tree", "node", F.col("height").alias("by_height"))
    return rounded(W.ratio_gradients(inner, by, jacobian=None))


@query(f"WITH {RATIOS_SQL} SELECT tree, round(sum(ln(above - low)), 8) AS lj FROM r WHERE parent IS NOT NULL GROUP BY 1")
def ratio_jacobians(spark, sf):
    return rounded(W.ratio_log_jacobian(W.to_ratios(W.heights_below(W.nodes_of(calendar(spark, sf))))), 8)


@query(f"""WITH {CAL_SQL}, k AS (SELECT * FROM o WHERE status = 'F'), alive AS (SELECT DISTINCT tree, unnest(['root', y, m, o]) AS node FROM k),
kids AS (SELECT e.tree, e.parent AS node, count(*) AS n FROM every_ e JOIN alive a ON a.tree = e.tree AND a.node = e.node GROUP BY 1, 2),
stays AS (SELECT tree, node FROM kids WHERE n >= 2 UNION SELECT tree, o FROM k),
up AS (SELECT DISTINCT tree, unnest([m, y, 'root']) AS above, o AS node FROM k UNION SELECT DISTINCT tree, unnest([y, 'root']), m FROM k UNION SELECT DISTINCT tree, 'root', y FROM k),
n AS (SELECT up.tree, up.node, arg_max(p.node, p.far) AS parent, max(p.far) AS p_far FROM up JOIN stays s ON s.tree = up.tree AND s.node = up.node JOIN stays t ON t.tree = up.tree AND t.node = up.above JOIN every_ p ON p.tree = up.tree AND p.node = up.above GROUP BY 1, 2)
SELECT n.tree, n.node AS child, n.parent, round(far - p_far, 8) AS length FROM n JOIN every_ e ON e.tree = n.tree AND e.node = n.node""")
def pruned_trees(spark, sf):
    """The calendar trees over their finished orders: lost branches go, single children are merged with their parents."""
    kept = calendar_orders(spark, sf).where("status = 'F'").select("tree", F.col("o").alias("node"))
    return rounded(K.pruned(calendar(spark, sf), kept), 8)


#: Tips in the order of a caterpillar and of a balanced tree: node 0 to 7 are tips, 14 is the root; of each node, its parent.
ABOVE = [[8, 8, 9, 10, 11, 12, 13, 14, 9, 10, 11, 12, 13, 14], [8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14]]
TAXA = "abcdefgh"
BASES = ["abcdefgh", "badcfehg", "acebdfhg"]
PERM_SQL = f"substr(CASE o_orderkey % 3 {' '.join(f'''WHEN {k} THEN '{b * 2}' ''' for k, b in enumerate(BASES))} END, (CASE WHEN o_orderkey % 10 < 6 THEN 0 ELSE o_orderkey % 8 END)::INTEGER + 1, 8)"


def ballot_sql() -> str:
    name = lambda at: f"substr(perm, {at + 1}, 1)" if at < 8 else f"'#{at}'"
    rows = [f"SELECT tree, {name(at)} AS child, '#{up}' AS parent FROM ballots WHERE shape = {shape}" for shape in (0, 1) for at, up in enumerate(ABOVE[shape])]
    return f"""ballots AS (SELECT o_orderkey AS tree, {PERM_SQL} AS perm, (o_orderkey % 7 < 3)::INTEGER AS shape, 1 + length(o_orderpriority)::DOUBLE AS weight FROM orders), edges AS ({' UNION ALL '.join(rows)}),
anc(tree, tip, node) AS (SELECT tree, child, child FROM edges WHERE child NOT LIKE '#%' UNION ALL SELECT a.tree, a.tip, e.parent FROM anc a JOIN edges e ON e.tree = a.tree AND e.child = a.node),
sets AS (SELECT tree, node, bit_or(1::BIGINT << (ascii(tip) - 97)) AS bits, count(*) AS n FROM anc WHERE node LIKE '#%' GROUP BY 1, 2)"""


def ballots(spark, sf):
    """(tree, child, parent, length) and (tree, weight)."""
    k = F.col("o_orderkey")
    base = F.when(k % 3 == 0, BASES[0] * 2).when(k % 3 == 1, BASES[1] * 2).otherwise(BASES[2] * 2)
    perm = F.substr(base, F.when(k % 10 < 6, 0).otherwise(k % 8).cast("int") + 1, F.lit(8))
    rows = table(spark, sf, "orders").select(k.alias("tree"), perm.alias("perm"), (k % 7 < 3).alias("balanced"), (1 + F.length("o_orderpriority")).cast("double").alias("weight"))
    name = lambda at: F.substring("perm", at + 1, 1) if at < 8 else F.lit(f"#{at}")
    edges = lambda above: F.array(*[F.struct(name(at).alias("child"), F.lit(f"#{up}").alias("parent")) for at, up in enumerate(above)])
    out = rows.select("tree", F.explode(F.when(F.col("balanced"), edges(ABOVE[1])).otherwise(edges(ABOVE[0]))).alias("e"))
    return out.select("tree", "e.child", "e.parent", F.lit(1.0).alias("length")), rows.select("tree", "weight")


def _clades(spark, sf):
    edges, weight = ballots(spark, sf)
    taxa = spark.createDataFrame([(t, k) for k, t in enumerate(TAXA)], "name string, at long")
    return K.clade_weights(edges, taxa, 1, weight, fewest=2), taxa


WEIGHTS_SQL = f"WITH RECURSIVE {ballot_sql()}, w AS (SELECT bits, n, sum(weight) / (SELECT sum(weight) FROM ballots) AS weight, count(*) AS trees FROM sets JOIN ballots USING (tree) GROUP BY 1, 2)"


@query(f"{WEIGHTS_SQL} SELECT bits, n, round(weight, 8) AS weight, trees FROM w")
def clade_weights(spark, sf):
    """The weight of every clade in a weighted collection of trees."""
    return rounded(_clades(spark, sf)[0].withColumn("bits", F.col("bits")[0]), 8)


@query(f"""{WEIGHTS_SQL}, k AS (SELECT bits, n, weight, row_number() OVER (ORDER BY weight DESC, bits) AS k FROM w),
g(k, taken) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT g.k + 1, CASE WHEN len(list_filter(taken, lambda t: (t & bits) <> 0 AND (t & bits) <> t AND (t & bits) <> bits)) = 0 THEN list_append(taken, bits) ELSE taken END FROM g JOIN k ON k.k = g.k + 1),
c AS (SELECT bits, n, weight FROM k WHERE list_contains((SELECT arg_max(taken, k) FROM g), bits) UNION ALL SELECT 1::BIGINT << i, 1, NULL FROM (SELECT unnest(range(0, 8)) AS i))
SELECT a.bits, a.n, any_value(round(a.weight, 8)) AS weight, coalesce(arg_min(b.bits, b.n), 0) AS parent FROM c a LEFT JOIN c b ON (a.bits & b.bits) = a.bits AND a.bits <> b.bits GROUP BY 1, 2""")
def consensus_tree(spark, sf):
    """The greedy consensus of the collection: clades and tips with their parents; the set of all taxa has parent 0."""
    weighted, taxa = _clades(spark, sf)
    taken = K.greedy(weighted)
    tree = K.tree_of(taken, taxa).join(taken.select("bits", "weight"), "bits", "left")
    return rounded(tree.select(F.col("bits")[0].alias("bits"), "n", "weight", F.coalesce(F.col("parent")[0], F.lit(0)).alias("parent")), 8)


@query(f"""WITH RECURSIVE {ballot_sql()}, tipsets AS (SELECT tree, child AS node, 1::BIGINT << (ascii(child) - 97) AS bits, 1::BIGINT AS n FROM edges WHERE child NOT LIKE '#%' UNION ALL SELECT tree, node, bits, n FROM sets),
kids AS (SELECT e.tree, e.parent AS node, s.bits, s.n, row_number() OVER (PARTITION BY e.tree, e.parent ORDER BY s.bits) AS k FROM edges e JOIN tipsets s ON s.tree = e.tree AND s.node = e.child),
p AS (SELECT x.tree, x.node, x.bits AS a, x.n AS na, y.bits AS b, y.n AS nb, 255 - x.bits - y.bits AS c, weight AS w FROM kids x JOIN kids y ON y.tree = x.tree AND y.node = x.node AND x.k = 1 AND y.k = 2 JOIN ballots ON ballots.tree = x.tree),
d AS (SELECT a | b AS parent, a AS x, b AS y, w * (2 * (8 - na - nb) - 1) / 13 AS weight FROM p WHERE node <> '#14' UNION ALL SELECT b | c, b, c, w * (2 * na - 1) / 13 FROM p WHERE node <> '#14' UNION ALL SELECT a | c, a, c, w * (2 * nb - 1) / 13 FROM p WHERE node <> '#14'
  UNION ALL SELECT 255, bits, 255 - bits, weight / 13 FROM kids JOIN ballots USING (tree) WHERE node <> '#14' OR k = 1),
s AS (SELECT parent, least(x, y) AS one, greatest(x, y) AS two, sum(weight) AS weight FROM d GROUP BY 1, 2, 3)
SELECT parent, one, two, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY parent), 8) AS share FROM s""")
def unrooted_subsplits(spark, sf):
    """Conditional probabilities of subsplits over all trees and all their rootings."""
    edges, weight = ballots(spark, sf)
    taxa = spark.createDataFrame([(t, k) for k, t in enumerate(TAXA)], "name string, at long")
    found = B.conditionals(B.network(edges, taxa, 1, weight))
    first = lambda c: F.col(c)[0].alias(c)
    return found.select(first("parent"), first("one"), first("two"), F.round("weight", 6).alias("weight"), F.round("share", 8).alias("share"))
