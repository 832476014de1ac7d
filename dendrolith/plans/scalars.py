"""Queries over strings, scalars, densities and closed-form models, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from dendrolith.functions import text as X
from dendrolith.operators import density as Y
from dendrolith.plans.standins import rounded, scaled_round, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, length(trim(text)) AS trimmed, length(ltrim(text)) AS l, length(rtrim(text)) AS r, trim(text) = '' AS empty FROM conversations")
def string_trim(spark, sf):
    t = table(spark, sf, "conversations")
    n = lambda c: F.length(c).cast("long")
    return t.select("conv_id", "turn", n(F.trim("text")).alias("trimmed"), n(F.ltrim("text")).alias("l"), n(F.rtrim("text")).alias("r"), (F.trim("text") == "").alias("empty"))


@query("SELECT page_id, starts_with(url, 'https') AS secure, starts_with(lower(url), 'http://m') AS mobile, ends_with(url, '/') AS bare, lower(url) = url AS lowered FROM pages")
def string_prefix(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.starts_with(u, "https").alias("secure"), X.starts_with(u, "HTTP://M", ignore_case=True).alias("mobile"), X.ends_with(u, "/").alias("bare"), (F.lower(u) == u).alias("lowered"))


@query("SELECT doc_id, contains(text, 'th') AS has, (length(text) - length(replace(text, 'th', ''))) // 2 AS n, CAST(instr(text, 'th') - 1 AS INTEGER) AS at FROM documents")
def string_search(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.contains(t, F.lit("th")).alias("has"), X.count_of(t, "th").alias("n"), X.index_of(t, "th").alias("at"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n, array_to_string(list_reverse(string_split(text, chr(10))), '|') AS joined FROM documents")
def string_split_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ", -1)).alias("n"), F.array_join(F.reverse(F.split("text", "\n", -1)), "|").alias("joined"))


@query("SELECT o_orderkey, round(list_sum(v), 4) AS total, CAST(len(v) AS INTEGER) AS n FROM (SELECT o_orderkey, list_transform(string_split(o_orderkey || ', ' || o_totalprice || ',x', ','), lambda s: TRY_CAST(trim(s) AS DOUBLE)) AS v FROM orders)")
def parse_arrays(spark, sf):
    o = table(spark, sf, "orders")
    v = X.split_numbers(F.concat(F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_totalprice").cast("string"), F.lit(",x")))
    return o.withColumn("v", v).select("o_orderkey", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), 4).alias("total"), F.size("v").alias("n"))


@query("SELECT role, count(*) FILTER (WHERE turn % 3 <> 2) AS n_true, min(upper(role) || '-' || lower(role) || '-' || substr(role, 2, 3)) AS cased FROM conversations GROUP BY role")
def boolean_and_case(spark, sf):
    spelled = F.when(F.col("turn") % 3 == 0, " TRUE").when(F.col("turn") % 3 == 1, "true ").otherwise("untrue")
    c = table(spark, sf, "conversations").groupBy("role")
    return c.agg(F.count_if(X.to_boolean(spelled)).alias("n_true"), F.min(F.concat(F.upper("role"), F.lit("-"), F.lower("role"), F.lit("-"), F.substring("role", 2, 3))).alias("cased"))


@query(r"SELECT event_id, regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AS f, regexp_matches(v, '^[+-]?[0-9]+$') AS i FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) || CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '.5' ELSE 'x' END AS v FROM events)")
def numeric_predicates(spark, sf):
    end = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, ".5").otherwise("x")
    v = F.concat(F.regexp_extract("props", "([0-9]+)", 1), end)
    return table(spark, sf, "events").select("event_id", X.is_float(v).alias("f"), X.is_integer(v).alias("i"))


@query(r"SELECT event_id, CAST(regexp_extract('[&k=' || regexp_extract(props, '([0-9]+)', 1) || ',type=' || event_type || ']', '[\[&,]k=([^,\]]+)', 1) AS INTEGER) AS k, event_type AS type FROM events")
def annotation_lookup(spark, sf):
    info = F.concat(F.lit("[&k="), F.regexp_extract("props", "([0-9]+)", 1), F.lit(",type="), F.col("event_type"), F.lit("]"))
    return table(spark, sf, "events").withColumn("info", info).select("event_id", X.annotation(F.col("info"), "k").cast("int").alias("k"), X.annotation(F.col("info"), "type").alias("type"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(l_quantity, l_tax) + ln(1 + exp(-abs(l_quantity - l_tax))), 6) AS lae, greatest(10.0, least(20.0, l_quantity))::DOUBLE AS clamped, round(greatest(l_tax - l_discount, 0) + ln(1 + exp(-abs(l_tax - l_discount))), 6) AS softplus FROM lineitem")
def log_add_clamp(spark, sf):
    q, t = F.col("l_quantity"), F.col("l_tax")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.logaddexp(q, t).alias("lae"), X.clamp(q, 10.0, 20.0).alias("clamped"), X.softplus(t - F.col("l_discount")).alias("softplus")))


@query("SELECT p_size, round(coalesce((SELECT sum(ln(k)) FROM (SELECT unnest(range(1, p_size + 1)) AS k)), 0), 6) AS lf, round(coalesce((SELECT sum(ln(k)) FROM (SELECT unnest(range(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END, p_size + 1, 2)) AS k)), 0), 6) AS ldf FROM (SELECT DISTINCT p_size FROM part)")
def log_factorials(spark, sf):
    n = F.col("p_size")
    return rounded(table(spark, sf, "part").select("p_size").distinct().select("p_size", X.log_factorial(n).alias("lf"), X.log_double_factorial(n).alias("ldf")))


@query("SELECT r_regionkey, round(u, 6) AS linear, round(exp(ln(0.1) + (u - 1) / 3 * (ln(100) - ln(0.1))), 6) AS logarithmic FROM region, (SELECT unnest([1.0, 2.0, 3.0, 4.0]::DOUBLE[]) AS u)")
def spaced_vectors(spark, sf):
    both = F.explode(F.arrays_zip(X.linear_grid(1.0, 4.0, 4).alias("linear"), X.log_grid(0.1, 100.0, 4).alias("logarithmic"))).alias("v")
    return rounded(table(spark, sf, "region").select("r_regionkey", both).select("r_regionkey", "v.linear", "v.logarithmic"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f FROM orders)
SELECT o_custkey, string_agg((r - 1)::VARCHAR, ',' ORDER BY o_orderkey) AS classes FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY f) AS r FROM o) GROUP BY 1""")
def canonical_relabel(spark, sf):
    ordered = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(ordered.alias("l"))
    return rows.select("o_custkey", F.array_join(X.relabel(F.col("l.o_orderpriority")).cast("array<string>"), ",").alias("classes"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS sorted, min(o_totalprice) AS least, max(o_totalprice) AS greatest, arg_min(o_orderkey, o_totalprice) AS which FROM orders GROUP BY 1")
def sort_and_argmin(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey")
    return o.agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("sorted"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("greatest"), F.min_by("o_orderkey", "o_totalprice").alias("which"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(a.n_nationkey * (49 - a.n_nationkey) / 2 + b.n_nationkey - a.n_nationkey - 1 AS BIGINT) AS k FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def packed_triangle(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    a, b = n.withColumnRenamed("n_nationkey", "i"), n.withColumnRenamed("n_nationkey", "j")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", X.packed_index(F.col("i"), F.col("j"), 25).cast("long").alias("k"))


@query("SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END, 8) AS y FROM orders")
def decimal_year(spark, sf):
    return rounded(table(spark, sf, "orders").select("o_orderkey", X.decimal_year(F.col("o_orderdate")).alias("y")), 8)


@query("SELECT event_id, round(value * 0.01, 8) AS length, value BETWEEN 1 AND 100 AS inside FROM events")
def scale_and_bounds(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", (F.col("value") * 0.01).alias("length"), F.col("value").between(1, 100).alias("inside")), 8)


U = "((user_id % 97) + 1) / 99.0::DOUBLE"


@query(f"SELECT event_id, round(ln(value), 6) AS z, round(ln(u / (1 - u)), 6) AS lg, round(1 / (1 + exp(-u)), 6) AS il, round(ln((2 * u + 1 - 1) / (3 - 2 * u - 1)), 6) AS b, round(ln(2) - u - 2 * ln(1 + exp(-u)), 6) AS lj FROM (SELECT *, {U} AS u FROM events)")
def bounded_transforms(spark, sf):
    u = (F.col("user_id") % 97 + 1) / F.lit(99.0)
    e = table(spark, sf, "events").withColumn("u", u)
    u = F.col("u")
    found = {"z": X.to_real(F.col("value"), 0.0), "lg": X.logit(u), "il": X.inverse_logit(u), "b": X.to_real(2 * u + 1, 1.0, 3.0), "lj": X.log_jacobian(u, 1.0, 3.0)}
    return e.select("event_id", *[scaled_round(x, 6).alias(n) for n, x in found.items()])


@query("""WITH c AS (SELECT user_id, event_type, count(*) + 1.0 AS n FROM events GROUP BY 1, 2),
k2 AS (SELECT u.user_id, v.t, coalesce(c.n, 1.0)::DOUBLE AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t) v LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = v.t),
p AS (SELECT user_id, t, n / sum(n) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM k2),
s AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT user_id, CAST(i AS INTEGER) AS i, round(ln(p / (1 - b - p)) + ln(5 - i), 6) AS z FROM s WHERE i < 5""")
def simplex_stick(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    n = [(F.count_if(F.col("event_type") == k) + 1).cast("double").alias(k) for k in kinds]
    e = table(spark, sf, "events").groupBy("user_id").agg(*n)
    total = reduce(lambda a, b: a + b, map(F.col, kinds))
    z = X.stick_breaking(F.array(*[F.col(k) / total for k in kinds]))
    return rounded(e.select("user_id", F.posexplode(z).alias("i", "z")).select("user_id", (F.col("i") + 1).alias("i"), "z"))


DENSITIES = {
    "exponential": (lambda x: Y.exponential(x, 0.5), "ln(0.5) - 0.5 * value"),
    "normal": (lambda x: Y.normal(x, 50.0, 20.0), "-0.5 * ln(2 * pi()) - ln(20) - 0.5 * ((value - 50) / 20) ** 2"),
    "half_normal": (lambda x: Y.half_normal(x, 30.0), "-0.5 * ln(2 * pi()) - ln(30) - 0.5 * (value / 30) ** 2 + ln(2)"),
    "lognormal": (lambda x: Y.lognormal(x, 3.0, 1.5), "-0.5 * ln(2 * pi()) - ln(1.5) - 0.5 * ((ln(value) - 3) / 1.5) ** 2 - ln(value)"),
    "cauchy": (lambda x: Y.cauchy(x, 40.0, 10.0), "-ln(pi() * 10 * (1 + ((value - 40) / 10) ** 2))"),
    "kumaraswamy": (lambda x: Y.kumaraswamy(x / 1000, 2.0, 3.0), "ln(6) + ln(value / 1000) + 2 * ln(1 - (value / 1000) ** 2)"),
    "one_on_x": (Y.one_on_x, "-ln(value)"),
    "gamma": (lambda x: Y.gamma(x, 4.0, 0.1), "4 * ln(0.1) - ln(6) + 3 * ln(value) - 0.1 * value"),
    "beta": (lambda x: Y.beta(x / 1000, 2.0, 3.0), "ln(24) - ln(1) - ln(2) + ln(value / 1000) + 2 * ln(1 - value / 1000)"),
    "beta_prime": (lambda x: Y.beta_prime(x, 2.0, 3.0), "ln(24) - ln(2) + ln(value) - 5 * ln(1 + value)"),
    "weibull": (lambda x: Y.weibull(x, 2.0, 50.0), "ln(2.0 / 50) + ln(value / 50) - (value / 50) ** 2"),
}


def _density(name, f, sql):
    def run(spark, sf):
        rows = table(spark, sf, "events").groupBy("event_type").agg((F.sum(f(F.col("value"))) / 1000).alias("lp"))
        return rounded(rows, 6)

    run.__name__ = f"density_{name}"
    query(f"SELECT event_type, round(sum({sql}) / 1000, 6) AS lp FROM events GROUP BY 1")(run)


for _name, (_f, _sql) in DENSITIES.items():
    _density(_name, _f, _sql)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') + 1.0 AS a, count(*) FILTER (WHERE event_type = 'view') + 1.0 AS b, count(*) FILTER (WHERE event_type = 'error') + 1.0 AS c FROM events GROUP BY 1)
SELECT user_id, round(ln(24) + ln(b / (a + b + c)) + ln(c / (a + b + c)), 6) AS lp FROM c""")
def density_dirichlet(spark, sf):
    n = [(F.count_if(F.col("event_type") == k) + 1).cast("double").alias(c) for k, c in (("click", "a"), ("view", "b"), ("error", "c"))]
    e = table(spark, sf, "events").groupBy("user_id").agg(*n)
    total = F.col("a") + F.col("b") + F.col("c")
    return rounded(e.select("user_id", Y.dirichlet([F.col(c) / total for c in "abc"], [1.0, 2.0, 2.0]).alias("lp")))


@query("""WITH l AS (SELECT user_id, event_type, avg(-value) AS lp, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS w, max(lp) OVER (PARTITION BY user_id) AS m FROM l)
SELECT user_id, round(max(m) + ln(sum(w * exp(lp - m))), 6) AS lp FROM w GROUP BY 1""")
def compound_mixture(spark, sf):
    parts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg(-F.col("value")).alias("lp"), F.count("*").alias("n"))
    return rounded(Y.compound(parts.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))), ["user_id"], "lp", "w"))


@query("SELECT l_orderkey, l_linenumber, round(0.25 + 0.75 * exp(-4 * l_discount / 3), 8) AS same, round(0.25 - 0.25 * exp(-4 * l_discount / 3), 8) AS other FROM lineitem")
def jc69_probabilities(spark, sf):
    t = F.col("l_discount")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.jc69(t, True).alias("same"), X.jc69(t, False).alias("other")), 8)


@query("SELECT l_orderkey, l_linenumber, round(0.25 + 0.25 * exp(-4 * l_tax / 4.0) + 0.5 * exp(-6 * l_tax / 4.0), 8) AS same, round(0.25 + 0.25 * exp(-4 * l_tax / 4.0) - 0.5 * exp(-6 * l_tax / 4.0), 8) AS transition, round(0.25 - 0.25 * exp(-4 * l_tax / 4.0), 8) AS transversion, round(exp(-l_tax / 0.7) + 0.4 * (1 - exp(-l_tax / 0.7)), 8) AS f81 FROM lineitem")
def k80_f81_probabilities(spark, sf):
    t = F.col("l_tax")
    freqs = (0.4, 0.3, 0.2, 0.1)
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[X.k80(t, 2.0, k).alias(k) for k in ("same", "transition", "transversion")], X.f81(t, freqs, 0, 0).alias("f81")), 8)


@query("""WITH r AS (SELECT s_nationkey AS i, c_nationkey AS j, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
d AS (SELECT i, -sum(n) AS s FROM r GROUP BY 1), t AS (SELECT -sum(s) AS t FROM d)
SELECT i, j, round(n / t, 8) AS q FROM r, t UNION ALL SELECT i, i, round(s / t, 8) FROM d, t""")
def rate_matrix(spark, sf):
    l, s, o, c = (table(spark, sf, n) for n in ("lineitem", "supplier", "orders", "customer"))
    flows = l.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    r = flows.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("i"), F.col("c_nationkey").alias("j")).agg(F.count("*").alias("n"))
    d = r.groupBy("i").agg((-F.sum("n")).alias("n")).select("i", F.col("i").alias("j"), "n")
    total = d.agg((-F.sum("n")).alias("t"))
    return rounded(r.unionByName(d).crossJoin(F.broadcast(total)).select("i", "j", (F.col("n") / F.col("t")).alias("q")), 8)


@query("""WITH a AS (SELECT l_linenumber AS i, l_suppkey % 5 AS k, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey % 5 AS k, CAST(l_quantity AS INTEGER) % 3 AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2)
SELECT i, j, round(sum(a.v * b.v), 2) AS v FROM a JOIN b USING (k) GROUP BY 1, 2""")
def matrix_multiply(spark, sf):
    l = table(spark, sf, "lineitem")
    k = (F.col("l_suppkey") % 5).alias("k")
    a = l.groupBy(F.col("l_linenumber").alias("i"), k).agg(F.sum("l_tax").alias("a"))
    b = l.groupBy(k, (F.col("l_quantity").cast("int") % 3).alias("j")).agg(F.sum("l_discount").alias("b"))
    return rounded(a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")), 2)


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def string_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
