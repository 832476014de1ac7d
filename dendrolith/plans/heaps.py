"""Likelihoods, gradients, reconstruction and parsimony on all taxa of the stand-in alignment, with SQL that prunes level by level.

The tree is the binary heap over the taxa: node 1 is the root, node h has the children 2h and 2h + 1, and the taxa in order
are the nodes n to 2n - 1. The model is F81 with two free rates, under which a message along a branch of length t is
(1 - e) sum(pi low) + e low with e = exp(-beta r t), so that SQL can carry the four states in four columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrolith.operators import branches as B
from dendrolith.operators import likelihood
from dendrolith.plans import standins as S
from dendrolith.plans.quartets import _BETA, CATEGORIES_SQL, FREQS, model, rates
from dendrolith.plans.standins import BASE_SQL, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Levels under the root that 25 taxa, nations of the tables, can reach, and multiples of a branch's length.
LEVELS = 5
FACTORS = [0.5, 1.0, 2.0]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def length_of(h: int) -> float:
    return 0.05 + 0.02 * (h % 7)


def tree(spark, sf) -> tuple[likelihood.TreeArrays, list[int]]:
    """The heap as arrays, and the heap number of each of its nodes."""
    names = [str(t) for t in S.taxa(spark, sf)]
    n = len(names)
    text: dict[int, str] = {}
    for h in range(2 * n - 1, 0, -1):
        own = names[h - n] if h >= n else f"({text[2 * h]},{text[2 * h + 1]})#{h}"
        text[h] = f"{own}:{length_of(h)!r}" if h > 1 else own + ";"
    found = likelihood.TreeArrays.of(text[1], names)
    return found, [int(x[1:]) if x.startswith("#") else n + names.index(x) for x in found.names]


def numbered(df, spark, heap: list[int], column: str = "node"):
    """Nodes of the arrays under their heap numbers."""
    at = F.create_map(*[F.lit(x) for pair in enumerate(heap) for x in pair])  # a row per node of one tree
    return df.withColumn(column, F.element_at(at, F.col(column)))


STATES = "acgt"
PI = dict(zip(STATES, FREQS, strict=True))


def _each(text: str, join: str = ", ") -> str:
    """``text`` for the four states: $ is the state, % its frequency."""
    return join.join(text.replace("$", s).replace("%", repr(PI[s])) for s in STATES)


def likelihood_sql() -> str:
    """nd(h, depth, leaf, i, len), eb(h, c, e, b, w), low, msg and, per pattern and category, root(pattern, weight, c, v)."""
    tip = _each("CASE WHEN substr(p.pattern, (nd.i + 1)::INTEGER, 1) IN (upper('$'), '-') THEN 1.0 ELSE 0.0 END::DOUBLE AS l$")
    parts = [
        BASE_SQL,
        CATEGORIES_SQL,
        "nn AS (SELECT count(*) AS n FROM taxa)",
        "nd AS (SELECT h, floor(log2(h) + 1e-9)::INTEGER AS depth, h >= n AS leaf, h - n AS i, CASE WHEN h > 1 THEN 0.05::DOUBLE + 0.02::DOUBLE * (h % 7) END AS len FROM nn, LATERAL (SELECT unnest(range(1, 2 * n)) AS h))",
        f"eb AS (SELECT h, c, rate * {_BETA!r} AS b, w, exp(-rate * {_BETA!r} * len) AS e FROM nd, cats)",
        "pw AS (SELECT pattern, weight FROM pats)",
    ]
    for d in range(LEVELS, -1, -1):
        rows = f"SELECT p.pattern, nd.h, cats.c, {tip} FROM pw p, nd, cats WHERE nd.depth = {d} AND nd.leaf"
        if d < LEVELS:
            rows += f" UNION ALL SELECT x.pattern, nd.h, x.c, {_each('x.m$ * y.m$ AS l$')} FROM nd JOIN msg{d + 1} x ON x.h = 2 * nd.h JOIN msg{d + 1} y ON y.h = 2 * nd.h + 1 AND y.pattern = x.pattern AND y.c = x.c WHERE nd.depth = {d} AND NOT nd.leaf"
        parts.append(f"low{d} AS ({rows})")
        mean = "(" + _each("% * l$", " + ") + ")"
        if d:
            parts.append(f"msg{d} AS (SELECT l.pattern, l.h, l.c, {_each(f'(1 - e) * {mean} + e * l$ AS m$')} FROM low{d} l JOIN eb ON eb.h = l.h AND eb.c = l.c)")
    parts.append(f"root AS (SELECT l.pattern, l.c, w, rate, {_each('% * l$', ' + ')} AS v FROM low0 l JOIN cats ON cats.c = l.c)")
    return ", ".join(parts)


def branches_sql() -> str:
    """rest(pattern, h, c, r..) from the root down and branch(pattern, h, c, x, q): with e on the branch above h, the likelihood is x + e (q - x)."""
    parts = [likelihood_sql(), f"up0 AS (SELECT pattern, h, c, {_each('%::DOUBLE AS u$')} FROM low0)"]
    for d in range(1, LEVELS + 1):
        parts.append(f"rest{d} AS (SELECT m.pattern, nd.h, m.c, {_each('u.u$ * m.m$ AS r$')} FROM nd JOIN msg{d} m ON m.h = CASE WHEN nd.h % 2 = 0 THEN nd.h + 1 ELSE nd.h - 1 END JOIN up{d - 1} u ON u.h = nd.h // 2 AND u.pattern = m.pattern AND u.c = m.c WHERE nd.depth = {d})")
        parts.append(f"up{d} AS (SELECT r.pattern, r.h, r.c, {_each(f'% * (1 - e) * ({_each('r$', ' + ')}) + e * r$ AS u$'.replace('%', '%'))} FROM rest{d} r JOIN eb ON eb.h = r.h AND eb.c = r.c)")
    parts.append("branch AS (" + " UNION ALL ".join(f"SELECT r.pattern, r.h, r.c, ({_each('r$', ' + ')}) * ({_each('% * l$', ' + ')}) AS x, {_each('r$ * l$', ' + ')} AS q FROM rest{d} r JOIN low{d} l ON l.pattern = r.pattern AND l.h = r.h AND l.c = r.c" for d in range(1, LEVELS + 1)) + ")")
    return ", ".join(parts)


@query(f"{likelihood_sql()}, p AS (SELECT pattern, sum(w * v) AS v FROM root GROUP BY 1) SELECT round(sum(weight * ln(v)), 3) AS lnl FROM p JOIN pw USING (pattern)")
def heap_likelihood(spark, sf):
    return rounded(likelihood.log_likelihood(S.patterns(spark, sf), tree(spark, sf)[0], model(), rates()), 3)


@query(f"{likelihood_sql()} SELECT pattern, any_value(weight)::DOUBLE AS weight, round(ln(sum(w * v)), 6) AS lnl, round(sum(w * v * rate) / sum(w * v), 6) AS rate FROM root JOIN pw USING (pattern) GROUP BY pattern")
def heap_sites(spark, sf):
    return rounded(likelihood.site_likelihoods(S.patterns(spark, sf), tree(spark, sf)[0], model(), rates()).select("pattern", "weight", "lnl", "rate"))


PROFILE_SQL = f"""{branches_sql()}, f AS (SELECT unnest([0, 1, 2]) AS tried, unnest({FACTORS}::DOUBLE[]) AS f), grown AS (SELECT eb.h, c, b, w, tried, len * f AS length, exp(-b * len * f) AS e FROM eb JOIN nd USING (h), f WHERE h > 1),
site AS (SELECT k.pattern, k.h, tried, any_value(length) AS length, sum(w * (x + e * (q - x))) AS v, sum(w * b * e * (x - q)) AS v1, sum(w * b * b * e * (q - x)) AS v2 FROM branch k JOIN grown g ON g.h = k.h AND g.c = k.c GROUP BY 1, 2, 3),
prof AS (SELECT h, tried, any_value(length) AS length, sum(weight * ln(v)) AS lnl, sum(weight * v1 / v) AS slope, sum(weight * (v2 / v - (v1 / v) ** 2)) AS curvature FROM site JOIN pw USING (pattern) GROUP BY 1, 2)"""


def profile(spark, sf):
    found, heap = tree(spark, sf)
    lengths = [[t * f for f in FACTORS] for t in found.length]
    return numbered(B.profiles(S.patterns(spark, sf), found, model(), rates(), lengths), spark, heap)


@query(f"{PROFILE_SQL} SELECT h::INTEGER AS node, tried::INTEGER AS tried, round(length, 6) AS length, round(lnl, 3) AS lnl, round(slope, 3) AS slope, round(curvature, 2) AS curvature FROM prof")
def branch_profiles(spark, sf):
    """Log-likelihood, slope and curvature of every branch at half, once and twice its length."""
    return profile(spark, sf).select("node", F.col("at").alias("tried"), F.round("length", 6).alias("length"), F.round("lnl", 3).alias("lnl"), F.round("slope", 3).alias("slope"), F.round("curvature", 2).alias("curvature"))


@query(f"{PROFILE_SQL} SELECT h::INTEGER AS node, round(length, 6) AS length, round(least(greatest(CASE WHEN curvature < 0 THEN length - slope / curvature WHEN slope > 0 THEN 2 * length ELSE length / 2 END, 1e-8), 100), 6) AS step FROM prof WHERE tried = 1")
def branch_steps(spark, sf):
    """The first Newton step of every branch."""
    found, heap = tree(spark, sf)
    at = B.profiles(S.patterns(spark, sf), found, model(), rates(), [[t] for t in found.length])
    return rounded(numbered(B.newton_steps(at), spark, heap))


@query(f"""{branches_sql()}, whole AS (SELECT pattern, sum(w * v) AS v FROM root GROUP BY 1), low AS ({' UNION ALL '.join(f'SELECT * FROM low{d}' for d in range(1, LEVELS + 1))}), rest AS ({' UNION ALL '.join(f'SELECT * FROM rest{d}' for d in range(1, LEVELS + 1))}),
one AS (SELECT r.h, r.c, {', '.join(f'sum(weight * w * r{i} * l{j} / v) AS d{i}{j}' for i in STATES for j in STATES)} FROM rest r JOIN low l USING (pattern, h, c) JOIN whole USING (pattern) JOIN pw USING (pattern) JOIN cats USING (c) GROUP BY 1, 2)
SELECT h::INTEGER AS node, c::INTEGER AS category, unnest({[k for k in range(4) for _ in range(4)]})::INTEGER AS up, unnest({list(range(4)) * 4})::INTEGER AS down, round(unnest([{', '.join(f'd{i}{j}' for i in STATES for j in STATES)}]), 3) AS value FROM one""")
def transition_adjoints(spark, sf):
    """The derivative of the log-likelihood by every entry of every branch's transition matrix."""
    found, heap = tree(spark, sf)
    rows = B.adjoints(S.patterns(spark, sf), found, model(), rates()).where("kind = 'p'").drop("kind")
    return rounded(numbered(rows, spark, heap), 3)


@query(f"""{branches_sql()}, post AS ({' UNION ALL '.join(f'SELECT u.pattern, u.h, {_each("sum(w * u$ * l$) AS p$")} FROM up{d} u JOIN low{d} l USING (pattern, h, c) JOIN cats USING (c) JOIN nd USING (h) WHERE NOT leaf GROUP BY 1, 2' for d in range(LEVELS))}),
best AS (SELECT pattern, h, CASE greatest({_each('p$')}) {' '.join(f"WHEN p{s} THEN '{s.upper()}'" for s in STATES)} END AS s FROM post)
SELECT pattern, any_value(weight)::DOUBLE AS weight, string_agg(s, '' ORDER BY h) AS states FROM best JOIN pw USING (pattern) GROUP BY pattern""")
def heap_ancestors(spark, sf):
    """The most probable state of every inner node, in the order of the heap."""
    found, heap = tree(spark, sf)
    inner = [heap[k] for k in found.internal]
    rows = likelihood.reconstruct(S.patterns(spark, sf), found, model(), rates())
    order = [inner.index(h) + 1 for h in sorted(inner)]
    return rows.select("pattern", "weight", F.concat(*[F.substring("states", k, 1) for k in order]).alias("states"))


def parsimony_sql() -> str:
    bits = "CASE substr(p.pattern, (nd.i + 1)::INTEGER, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END"
    parts = [BASE_SQL, "nn AS (SELECT count(*) AS n FROM taxa)", "nd AS (SELECT h, floor(log2(h) + 1e-9)::INTEGER AS depth, h >= n AS leaf, h - n AS i FROM nn, LATERAL (SELECT unnest(range(1, 2 * n)) AS h))"]
    for d in range(LEVELS, -1, -1):
        rows = f"SELECT p.pattern, nd.h, {bits} AS s, 0 AS k FROM pats p, nd WHERE nd.depth = {d} AND nd.leaf"
        if d < LEVELS:
            rows += f" UNION ALL SELECT x.pattern, nd.h, CASE WHEN x.s & y.s = 0 THEN x.s | y.s ELSE x.s & y.s END, x.k + y.k + (x.s & y.s = 0)::INTEGER FROM nd JOIN f{d + 1} x ON x.h = 2 * nd.h JOIN f{d + 1} y ON y.h = 2 * nd.h + 1 AND y.pattern = x.pattern WHERE nd.depth = {d} AND NOT nd.leaf"
        parts.append(f"f{d} AS ({rows})")
    return ", ".join(parts) + " SELECT pattern, weight::DOUBLE AS weight, k::BIGINT AS score FROM f0 JOIN pats USING (pattern)"


@query(parsimony_sql())
def heap_parsimony(spark, sf):
    return likelihood.parsimony(S.patterns(spark, sf), tree(spark, sf)[0]).drop("states")
