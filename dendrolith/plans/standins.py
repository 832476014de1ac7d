"""Stand-in inputs over the relational tables: they exercise the operators, not biology.

The alignment has a taxon per supplier nation and a site per part; the state is the summed quantity modulo four, and a
part that a nation never supplied is a gap. It covers every line item. ``events`` stands in for posterior samples, the
geography tree (root, regions, nations, customers, orders) for a phylogeny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.operators import patterns as P

#: Inverse temperatures of the event types, as rungs of a tempered run.
RUNGS = {"click": 0.0, "error": 0.25, "purchase": 0.5, "signup": 0.75, "view": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignment(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """(taxon, site, state); ``status`` keeps line items of one status, which gives a second alignment."""
    lines = table(spark, sf_dir, "lineitem")
    if status:
        lines = lines.where(F.col("l_linestatus") == status)
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("taxon"))
    cells = lines.join(nations, lines["l_suppkey"] == nations["s_suppkey"]).groupBy("taxon", F.col("l_partkey").alias("site")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return cells.select("taxon", "site", F.substring(F.lit("ACGT"), (F.col("q") % 4 + 1).cast("int"), F.lit(1)).alias("state"))


_TAXA: dict[tuple[str, str], list[int]] = {}


def taxa(spark: SparkSession, sf_dir: str) -> list[int]:
    """Nations whose suppliers have line items: a dimension, read once per application and folder."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _TAXA:
        _TAXA[at] = _read_taxa(spark, sf_dir)
    return _TAXA[at]


def _read_taxa(spark: SparkSession, sf_dir: str) -> list[int]:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem").select("l_suppkey").distinct(), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return sorted(r[0] for r in rows.select(F.col("s_nationkey").cast("long")).distinct().collect())


def columns(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    return P.columns_of(alignment(spark, sf_dir, status), taxa(spark, sf_dir))


def patterns(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    return P.compress(columns(spark, sf_dir, status))


def aln_sql(where: str = "", name: str = "aln") -> str:
    """The alignment as a table expression."""
    return f"""{name} AS (
  SELECT CAST(s_nationkey AS BIGINT) AS taxon, l_partkey AS site, substr('ACGT', CAST(sum(CAST(l_quantity AS BIGINT)) % 4 AS INTEGER) + 1, 1) AS state
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY 1, 2)"""


TAXA_SQL = "taxa AS (SELECT taxon, row_number() OVER (ORDER BY taxon) - 1 AS i FROM (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS taxon FROM supplier JOIN lineitem ON l_suppkey = s_suppkey))"


def patterns_sql(where: str = "", suffix: str = "") -> str:
    """aln, grid, columns and patterns as table expressions."""
    return f"""{aln_sql(where, "aln" + suffix)},
grid{suffix} AS (SELECT t.i, s.site, coalesce(a.state, '-') AS state FROM taxa t CROSS JOIN (SELECT DISTINCT site FROM aln{suffix}) s LEFT JOIN aln{suffix} a ON a.taxon = t.taxon AND a.site = s.site),
cols{suffix} AS (SELECT site, string_agg(state, '' ORDER BY i) AS pattern FROM grid{suffix} GROUP BY site),
pats{suffix} AS (SELECT pattern, count(*) AS weight FROM cols{suffix} GROUP BY pattern)"""


BASE_SQL = f"WITH {TAXA_SQL}, {patterns_sql()}"
ALN_SQL = f"WITH {aln_sql()}"
#: Counts for each pair of taxa from the grid, without compression.
PAIRS_SQL = f"""WITH {TAXA_SQL}, {aln_sql()},
known AS (SELECT t.i, a.site, a.state FROM aln a JOIN taxa t ON t.taxon = a.taxon),
pairs AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, count(*) FILTER (WHERE a.state <> b.state) AS diff,
  count(*) FILTER (WHERE a.state <> b.state AND (a.state || b.state) IN ('AG', 'GA', 'CT', 'TC')) AS ts,
  count(*) FILTER (WHERE a.state <> b.state AND (a.state || b.state) NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv
  FROM known a JOIN known b ON a.site = b.site AND a.i < b.i GROUP BY 1, 2)"""

SAMPLES_SQL = """samples AS (SELECT event_type AS chain, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS iter, -value AS ll,
  CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 0.25 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.75 ELSE 1.0 END::DOUBLE AS beta FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, user_id, event_id, ts, ll, beta): every event as a posterior sample."""
    beta = F.element_at(F.create_map(*[F.lit(x) for kv in RUNGS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), "user_id", "event_id", "ts", (-F.col("value")).alias("ll"), beta.alias("beta"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scaled_round(x: Column, digits: int) -> Column:
    """Doubles rounded as the checking SQL rounds them: scaled up, to a whole number, and back. Spark rounds the shortest
    decimal instead, so that a value just off a tie, which scaling brings onto it, goes the other way."""
    whole = F.round(x * 10.0**digits)
    return F.when(F.abs(whole) == float("inf"), x).otherwise(whole / 10.0**digits)
