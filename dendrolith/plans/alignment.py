"""Alignment queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.functions import alphabet as A
from dendrolith.operators import distances as D
from dendrolith.operators import patterns as P
from dendrolith.plans import standins as S
from dendrolith.plans.standins import ALN_SQL, BASE_SQL, PAIRS_SQL, TAXA_SQL, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{BASE_SQL} SELECT pattern, weight FROM pats")
def site_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return S.patterns(spark, sf)


CODON_SQL = f"""WITH {TAXA_SQL}, {S.aln_sql()},
codons AS (SELECT taxon, site // 3 AS codon, string_agg(state, '') FILTER (WHERE site % 3 = 0) AS a, string_agg(state, '') FILTER (WHERE site % 3 = 1) AS b, string_agg(state, '') FILTER (WHERE site % 3 = 2) AS c FROM aln GROUP BY 1, 2),
triplets AS (SELECT taxon, codon, coalesce(a, '-') || coalesce(b, '-') || coalesce(c, '-') AS state FROM codons)"""


@query(f"""{CODON_SQL}, grid AS (SELECT t.i, s.codon, coalesce(k.state, '---') AS state FROM taxa t CROSS JOIN (SELECT DISTINCT codon FROM triplets) s LEFT JOIN triplets k ON k.taxon = t.taxon AND k.codon = s.codon),
cols AS (SELECT codon, string_agg(state, '' ORDER BY i) AS pattern FROM grid GROUP BY codon) SELECT pattern, count(*) AS weight FROM cols GROUP BY pattern""")
def codon_patterns(spark, sf):
    return P.compress(P.columns_of(P.codon_alignment(S.alignment(spark, sf)), S.taxa(spark, sf), 3))


SENSE_LIST = ", ".join(f"('{c}', {i})" for i, c in enumerate(A.sense_codons()))


@query(f"{CODON_SQL}, sense(codon_text, code) AS (VALUES {SENSE_LIST}) SELECT CAST(coalesce(code, {len(A.sense_codons())}) AS INTEGER) AS code, count(*) AS n FROM triplets LEFT JOIN sense ON codon_text = state GROUP BY 1")
def codon_encoding(spark, sf):
    return P.codon_alignment(S.alignment(spark, sf)).groupBy(A.encode_codon(F.col("state")).alias("code")).agg(F.count("*").alias("n"))


@query(f"{ALN_SQL} SELECT CAST(CASE state WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END AS INTEGER) AS code, state, count(*) AS n FROM aln GROUP BY 1, 2")
def nucleotide_encoding(spark, sf):
    code = A.encode_nucleotide(F.col("state"))
    return S.alignment(spark, sf).select(code.alias("code")).withColumn("state", A.decode_nucleotide(F.col("code"))).groupBy("code", "state").agg(F.count("*").alias("n"))


@query("SELECT p_brand, sum(CASE WHEN c IN ('b', 'j', 'o', 'u', 'x', 'z', ' ') THEN 1 ELSE 0 END)::BIGINT AS n_other, count(*) AS n_symbols FROM (SELECT p_brand, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_brand")
def amino_acid_encoding(spark, sf):
    letters = S.table(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", "")).alias("c")).where("c <> ''")
    code = A.encode_amino_acid(F.col("c"))
    return letters.groupBy("p_brand").agg(F.sum(F.when(code >= 20, 1).otherwise(0)).cast("long").alias("n_other"), F.count("*").alias("n_symbols"))


@query("SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS INTEGER) AS code, count(*) AS n FROM events GROUP BY 1")
def generic_encoding(spark, sf):
    code = A.encode_generic(F.col("event_type"), ["click", "view", "purchase"], {"error": ["click", "view"]})
    return S.table(spark, sf, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(f"{ALN_SQL} SELECT site, round(avg(CASE WHEN state = 'A' THEN 1.0 ELSE 0.0 END), 6) AS a, round(avg(CASE WHEN state = 'C' THEN 1.0 ELSE 0.0 END), 6) AS c, round(avg(CASE WHEN state = 'G' THEN 1.0 ELSE 0.0 END), 6) AS g, round(avg(CASE WHEN state = 'T' THEN 1.0 ELSE 0.0 END), 6) AS t FROM aln GROUP BY site")
def site_partials(spark, sf):
    v = S.alignment(spark, sf).withColumn("v", A.nucleotide_partial(A.encode_nucleotide(F.col("state"))))
    return rounded(v.groupBy("site").agg(*[F.avg(F.element_at("v", k + 1)).alias(n) for k, n in enumerate("acgt")]))


@query(f"{BASE_SQL} SELECT sum(weight)::BIGINT AS n_sites FROM pats WHERE (pattern LIKE '%A%')::INT + (pattern LIKE '%C%')::INT + (pattern LIKE '%G%')::INT + (pattern LIKE '%T%')::INT > 1")
def polymorphic_sites(spark, sf):
    return P.polymorphic(S.patterns(spark, sf))


@query(f"{BASE_SQL} SELECT state, count(*) AS n FROM (SELECT unnest(string_split(pattern, '')) AS state FROM pats) GROUP BY state")
def pattern_states(spark, sf):
    return P.pattern_states(S.patterns(spark, sf))


@query(f"{ALN_SQL} SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM aln), 6) AS freq FROM aln GROUP BY state")
def empirical_freqs(spark, sf):
    return rounded(P.frequencies(S.alignment(spark, sf)))


@query(f"{ALN_SQL} SELECT CAST(site % 3 + 1 AS INTEGER) AS position, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY site % 3), 6) AS freq FROM aln GROUP BY site % 3, state")
def codon_pos_freqs(spark, sf):
    return rounded(P.frequencies(P.codon_position(S.alignment(spark, sf)), ["position"]))


SENSE_ROWS = ", ".join(f"('{c}')" for c in A.sense_codons())


@query(f"""{ALN_SQL}, f AS (SELECT site % 3 AS p, state, count(*) / sum(count(*)) OVER (PARTITION BY site % 3) AS f FROM aln GROUP BY 1, 2), sense(codon) AS (VALUES {SENSE_ROWS}),
prod AS (SELECT codon, a.f * b.f * c.f AS p FROM sense JOIN f a ON a.p = 0 AND a.state = codon[1] JOIN f b ON b.p = 1 AND b.state = codon[2] JOIN f c ON c.p = 2 AND c.state = codon[3])
SELECT codon, round(p / sum(p) OVER (), 6) AS freq FROM prod""")
def f3x4(spark, sf):
    return rounded(P.f3x4(S.alignment(spark, sf), A.sense_codons()))


@query(f"""{ALN_SQL}, f AS (SELECT state, count(*) / sum(count(*)) OVER () AS f FROM aln GROUP BY 1), sense(codon) AS (VALUES {SENSE_ROWS}),
prod AS (SELECT codon, a.f * b.f * c.f AS p FROM sense JOIN f a ON a.state = codon[1] JOIN f b ON b.state = codon[2] JOIN f c ON c.state = codon[3])
SELECT codon, round(p / sum(p) OVER (), 6) AS freq FROM prod""")
def f1x4(spark, sf):
    return rounded(P.f3x4(S.alignment(spark, sf), A.sense_codons(), shared=True))


def pairs(spark, sf):
    return D.pair_counts(S.patterns(spark, sf), len(S.taxa(spark, sf)))


@query(f"""{PAIRS_SQL}, r AS (SELECT sum(ts)::BIGINT AS ts, sum(tv)::BIGINT AS tv FROM pairs),
f AS (SELECT avg((state = 'A')::INT) AS a, avg((state = 'C')::INT) AS c, avg((state = 'G')::INT) AS g, avg((state = 'T')::INT) AS t FROM aln)
SELECT ts, tv, round(ts / tv, 6) AS ratio, round(ts / tv * (a + g) * (c + t) / (a * g + c * t), 6) AS kappa FROM r, f""")
def tstv_kappa(spark, sf):
    return rounded(D.kappa(pairs(spark, sf), P.frequencies(S.alignment(spark, sf))))


@query(f"""{PAIRS_SQL}, c AS (SELECT least(a.state, b.state) || greatest(a.state, b.state) AS pair, count(*) AS n FROM known a JOIN known b ON a.site = b.site AND a.i < b.i AND a.state <> b.state GROUP BY 1)
SELECT pair, n, round(n / (SELECT n FROM c WHERE pair = 'GT'), 6) AS rate FROM c""")
def rel_rates(spark, sf):
    return rounded(D.relative_rates(D.unordered_pairs(S.patterns(spark, sf), len(S.taxa(spark, sf)))))


@query(f"{BASE_SQL} SELECT round(sum(weight * ln(weight)) - sum(weight) * ln(sum(weight)), 6) AS lnl FROM pats")
def unconstrained_lnl(spark, sf):
    return rounded(P.unconstrained(S.patterns(spark, sf)))


@query(f"WITH {TAXA_SQL}, {S.patterns_sql('WHERE l_partkey >= 5 AND (l_partkey - 5) % 4 = 0')} SELECT pattern, weight FROM pats")
def slice_every(spark, sf):
    return P.compress(P.columns_of(P.slice_sites(S.alignment(spark, sf), 5, None, 4), S.taxa(spark, sf)))


@query(f"{ALN_SQL} SELECT CAST(site % 3 + 1 AS INTEGER) AS position, taxon, string_agg(state, '' ORDER BY site) AS seq FROM aln GROUP BY 1, 2")
def split_codon(spark, sf):
    ordered = F.sort_array(F.collect_list(F.struct("site", "state")))
    rows = P.codon_position(S.alignment(spark, sf)).groupBy("position", "taxon").agg(ordered.alias("l"))
    return rows.select("position", "taxon", F.concat_ws("", F.col("l.state")).alias("seq"))


@query(f"{ALN_SQL} SELECT CASE WHEN site % 3 < 2 THEN '12' ELSE '3' END AS part, state, count(*) AS n FROM aln GROUP BY 1, 2")
def split_12_3(spark, sf):
    part = F.when(F.col("site") % 3 < 2, "12").otherwise("3").alias("part")
    return S.alignment(spark, sf).groupBy(part, "state").agg(F.count("*").alias("n"))


@query(f"{ALN_SQL}, masked AS (SELECT taxon, site, CASE WHEN state = 'A' THEN '-' ELSE state END AS state FROM aln) SELECT site, count(*) AS n FROM masked GROUP BY site HAVING bool_or(state <> '-')")
def drop_empty_columns(spark, sf):
    masked = S.alignment(spark, sf).withColumn("state", F.when(F.col("state") == "A", "-").otherwise(F.col("state")))
    return P.drop_empty_sites(masked).groupBy("site").agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT length(text)) = 1 AS aligned, count(*) AS n FROM documents GROUP BY lang")
def is_aligned(spark, sf):
    return S.table(spark, sf, "documents").groupBy("lang").agg((F.count_distinct(F.length("text")) == 1).alias("aligned"), F.count("*").alias("n"))


MERGE_SQL = f"WITH {TAXA_SQL}, {S.patterns_sql('WHERE l_linestatus = ' + repr('O'), '_o')}, {S.patterns_sql('WHERE l_linestatus = ' + repr('F'), '_f')}"


@query(f"{MERGE_SQL} SELECT pattern, sum(weight)::BIGINT AS weight FROM (SELECT * FROM pats_o UNION ALL SELECT * FROM pats_f) GROUP BY pattern")
def merge_patterns(spark, sf):
    return P.merge(S.patterns(spark, sf, "O"), S.patterns(spark, sf, "F"))


@query(f"{MERGE_SQL} SELECT count(*) FILTER (WHERE o.pattern IS NOT NULL AND f.pattern IS NOT NULL) AS shared, count(*) FILTER (WHERE f.pattern IS NULL) AS only_o, count(*) FILTER (WHERE o.pattern IS NULL) AS only_f FROM pats_o o FULL JOIN pats_f f USING (pattern)")
def pattern_set_operations(spark, sf):
    one, other = S.patterns(spark, sf, "O").select("pattern"), S.patterns(spark, sf, "F").select("pattern")
    marked = one.withColumn("o", F.lit(1)).unionByName(other.withColumn("f", F.lit(1)), allowMissingColumns=True).groupBy("pattern").agg(F.max("o").alias("o"), F.max("f").alias("f"))
    n = lambda c: F.count_if(c)
    return marked.agg(n(F.col("o").isNotNull() & F.col("f").isNotNull()).alias("shared"), n(F.col("f").isNull()).alias("only_o"), n(F.col("o").isNull()).alias("only_f"))


@query(f"{BASE_SQL} SELECT pattern, weight - 1 AS weight, weight AS n_replicates FROM pats")
def jackknife_site(spark, sf):
    return P.jackknife(S.patterns(spark, sf))


@query(f"{BASE_SQL} SELECT pattern, CAST(length(pattern) - length(replace(pattern, 'A', '')) AS BIGINT) AS weight FROM pats WHERE pattern LIKE '%A%'")
def reweight(spark, sf):
    pats = S.patterns(spark, sf)
    weights = pats.select("pattern", (F.length("pattern") - F.length(F.regexp_replace("pattern", "A", ""))).cast("long").alias("new_weight"))
    return P.reweight(pats, weights)


@query(f"{BASE_SQL} SELECT pattern, count(*) AS n FROM cols GROUP BY pattern")
def expand_patterns(spark, sf):
    return P.expand(S.patterns(spark, sf)).groupBy("pattern").agg(F.count("*").alias("n"))


N_SITES = "(SELECT max(l_partkey) + 1 FROM lineitem)"


@query(f"""WITH {TAXA_SQL}, {S.aln_sql()}, sites AS (SELECT unnest(range(0, {N_SITES})) AS site)
SELECT t.taxon, string_agg(coalesce(a.state, '-'), '' ORDER BY s.site) AS seq FROM taxa t CROSS JOIN sites s LEFT JOIN aln a ON a.taxon = t.taxon AND a.site = s.site GROUP BY 1""")
def whole_sequences(spark, sf):
    n = S.table(spark, sf, "lineitem").agg(F.max("l_partkey")).first()[0] + 1
    return P.sequences(S.alignment(spark, sf), n)


@query(f"""WITH {S.aln_sql(name='one')}, {S.aln_sql("WHERE l_linestatus = 'O'", 'two')},
a AS (SELECT taxon, string_agg(state, '' ORDER BY site) AS s FROM one GROUP BY 1), b AS (SELECT taxon, string_agg(state, '' ORDER BY site) AS s FROM two GROUP BY 1)
SELECT taxon, a.s || b.s AS seq FROM a JOIN b USING (taxon)""")
def concatenate_alignments(spark, sf):
    def joined(status):
        ordered = F.sort_array(F.collect_list(F.struct("site", "state")))
        return S.alignment(spark, sf, status).groupBy("taxon").agg(ordered.alias("l")).select("taxon", F.concat_ws("", "l.state").alias("seq"))

    return P.concatenate(joined(None), joined("O"))


@query(f"{PAIRS_SQL} SELECT i, j, n, diff, round(diff / n, 6) AS d FROM pairs")
def p_distance(spark, sf):
    return rounded(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "raw"))


@query(f"{PAIRS_SQL} SELECT i, j, n, diff, round(CASE WHEN diff / n < 0.75 THEN -0.75 * ln(1 - 4 * (diff / n) / 3) ELSE 1000.0 END, 6) AS d FROM pairs")
def jc69(spark, sf):
    return rounded(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "jc69"))


@query(f"""{PAIRS_SQL}, r AS (SELECT i, j, n, diff, 1 - 2 * ts / n - tv / n AS a, 1 - 2 * tv / n AS b FROM pairs)
SELECT i, j, n, diff, round(CASE WHEN a > 0 AND b > 0 THEN -0.5 * ln(greatest(a, 1e-300)) - 0.25 * ln(greatest(b, 1e-300)) ELSE 1000.0 END, 6) AS d FROM r""")
def k2p(spark, sf):
    return rounded(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "k2p"))


@query(f"{PAIRS_SQL}, r AS (SELECT *, diff / n AS p FROM pairs) SELECT i, j, n, diff, round(CASE WHEN 1 - p - 0.2 * p * p > 0 THEN -ln(greatest(1 - p - 0.2 * p * p, 1e-300)) ELSE 1000.0 END, 6) AS d FROM r")
def kimura_aa(spark, sf):
    return rounded(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "kimura"))


@query(f"""{BASE_SQL} SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg((a.state <> b.state)::INT), 6) AS d FROM grid a JOIN grid b ON a.site = b.site AND a.i < b.i GROUP BY 1, 2""")
def hamming(spark, sf):
    return rounded(D.hamming(S.patterns(spark, sf), len(S.taxa(spark, sf))))


@query(f"{PAIRS_SQL} SELECT i, j, CAST(round(CAST(CAST(diff / n AS FLOAT) AS DOUBLE), 5) AS DOUBLE) AS d FROM pairs")
def distance_float(spark, sf):
    found = D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "raw")
    return found.select("i", "j", F.round(F.col("d").cast("float").cast("double"), 5).alias("d"))


@query(f"{PAIRS_SQL} SELECT i, j, round(diff / n, 6) AS d FROM pairs ORDER BY diff / n, i, j LIMIT 1")
def nearest_pair(spark, sf):
    return rounded(D.nearest_pair(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "raw")))


@query(f"""{PAIRS_SQL}, two AS (SELECT i, j, diff / n AS d FROM pairs UNION ALL SELECT j, i, diff / n FROM pairs)
SELECT i, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM two) WHERE r = 1""")
def nearest_taxon(spark, sf):
    return rounded(D.rank_nearest(D.distances(S.patterns(spark, sf), len(S.taxa(spark, sf)), "raw")))


@query(f"{PAIRS_SQL} SELECT round(avg(diff), 6) AS pi FROM pairs")
def nucleotide_diversity(spark, sf):
    return rounded(D.diversity(pairs(spark, sf)))


SEG_SQL = f"""{PAIRS_SQL}, c AS (SELECT site, state, count(*) AS n FROM aln GROUP BY 1, 2), k AS (SELECT site, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, state) AS r FROM c),
seg AS (SELECT count(*) AS s, count(*) FILTER (WHERE n = 1) AS singletons FROM k WHERE r = 2),
size AS (SELECT count(*) AS n FROM taxa), h AS (SELECT sum(1.0 / i) AS a1, sum(1.0 / (i * i)) AS a2 FROM (SELECT unnest(range(1, (SELECT n FROM size))) AS i)),
z AS (SELECT n::DOUBLE AS n, a1, a2, s::DOUBLE AS s, singletons::DOUBLE AS one, (SELECT avg(diff) FROM pairs) AS pi FROM size, h, seg)"""


@query(f"{SEG_SQL} SELECT s, singletons FROM seg")
def segregating_sites(spark, sf):
    return D.segregating(S.patterns(spark, sf))


@query(f"""{SEG_SQL}, e AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM z)
SELECT round(pi, 6) AS pi, CAST(s AS BIGINT) AS s, round(s / a1, 6) AS theta, round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) AS d FROM e""")
def tajima_d(spark, sf):
    pats, n = S.patterns(spark, sf), len(S.taxa(spark, sf))
    return rounded(D.tajima(D.pair_counts(pats, n), pats, n))


@query(f"""{SEG_SQL}, b AS (SELECT *, a1 + 1 / n AS an1, 2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2)) AS cn FROM z),
dd AS (SELECT *, cn + (n - 2) / ((n - 1) * (n - 1)) + 2 / (n - 1) * (1.5 - (2 * an1 - 3) / (n - 2) - 1 / n) AS dn FROM b),
v AS (SELECT *, (n * n / ((n - 1) * (n - 1)) * a2 + a1 * a1 * dn - 2 * n * a1 * (a1 + 1) / ((n - 1) * (n - 1))) / (a1 * a1 + a2) AS v,
  (dn + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1) * (4 * a2 - 6 + 8 / n)) / (a1 * a1 + a2) AS vf FROM dd),
u AS (SELECT *, n / (n - 1) * (a1 - n / (n - 1)) - v AS u, (n / (n - 1) + (n + 1) / 3 / (n - 1) - 4 / n / (n - 1) + 2 * (n + 1) / (n - 1) / (n - 1) * (an1 - 2 * n / (n + 1))) / a1 - vf AS uf FROM v)
SELECT CAST(s AS BIGINT) AS s, CAST(one AS BIGINT) AS singletons, round((n / (n - 1) * s - a1 * one) / sqrt(u * s + v * s * s), 6) AS d_star, round((pi - (n - 1) / n * one) / sqrt(uf * s + vf * s * s), 6) AS f_star FROM u""")
def fu_li(spark, sf):
    pats, n = S.patterns(spark, sf), len(S.taxa(spark, sf))
    return rounded(D.fu_li(D.pair_counts(pats, n), pats, n))
