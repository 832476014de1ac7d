"""Queries through files: tables are written in a format of the field and read back, and SQL says what must come back."""

from __future__ import annotations

import json
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.operators import patterns as P
from dendrolith.operators import samples as O
from dendrolith.plans import standins as S
from dendrolith.plans.standins import BASE_SQL, SAMPLES_SQL, rounded, table
from dendrolith.plans.trees import forest_lines, forest_sql
from dendrolith.sources import config, logs, sequences
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


def place(spark: SparkSession, name: str) -> str:
    """A folder for a query's files, in the shared folder that the cluster names; only a single process may use its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/files-{spark.sparkContext.applicationId}/{name}"


def written(lines: DataFrame, spark: SparkSession, name: str) -> str:
    """One text file from the rows in their order."""
    path = place(spark, name)
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def whole_sequences(spark, sf) -> DataFrame:
    aln = S.alignment(spark, sf)
    last = aln.agg(F.max("site")).first()[0]
    return P.sequences(aln.withColumn("taxon", F.col("taxon").cast("string")), int(last) + 1)


SEQUENCES_SQL = f"""{BASE_SQL}, s AS (SELECT unnest(range(0, (SELECT max(site) FROM aln) + 1)) AS site)
SELECT t.taxon::VARCHAR AS taxon, md5(string_agg(coalesce(a.state, '-'), '' ORDER BY s.site)) AS digest FROM (SELECT DISTINCT taxon FROM aln) t CROSS JOIN s LEFT JOIN aln a ON a.taxon = t.taxon AND a.site = s.site GROUP BY t.taxon"""


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("taxon", F.md5("seq").alias("digest"))


@query(SEQUENCES_SQL)
def fasta_files(spark, sf):
    return digests(sequences.read_sequences(spark, written(sequences.to_fasta(whole_sequences(spark, sf)), spark, "fasta")))


@query(SEQUENCES_SQL)
def nexus_files(spark, sf):
    return digests(sequences.read_sequences(spark, written(sequences.to_nexus(whole_sequences(spark, sf)), spark, "nexus")))


@query(SEQUENCES_SQL)
def phylip_files(spark, sf):
    return digests(sequences.read_sequences(spark, written(sequences.to_phylip(whole_sequences(spark, sf)), spark, "phylip")))


@query("SELECT p_partkey || '>' || p_name AS taxon, upper(p_brand) AS seq FROM part")
def fasta_headers(spark, sf):
    """Headers that hold the record mark."""
    rows = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(">"), "p_name").alias("taxon"), F.col("p_brand").alias("seq"))
    path = place(spark, "headers")
    sequences.to_fasta(rows).write.mode("overwrite").text(path)
    return sequences.read_fasta(spark, path)


@query(f"{SEQUENCES_SQL} HAVING t.taxon::VARCHAR = (SELECT min(taxon)::VARCHAR FROM aln)")
def sequence_lookup(spark, sf):
    return digests(sequences.sequence_by_name(whole_sequences(spark, sf), str(S.taxa(spark, sf)[0])))


def tree_file(spark, sf, name: str) -> DataFrame:
    return newick.read_trees(spark, written(forest_lines(spark, sf).orderBy("tree").select("newick"), spark, name))


def edge_rows(lines: DataFrame, translate: dict[str, str] | None = None) -> DataFrame:
    return newick.edges(lines, translate).where("parent is not null").select("tree", "child", "parent", "length")


@query(f"WITH {forest_sql()} SELECT tree::BIGINT AS tree, child, parent, length FROM edges")
def newick_files(spark, sf):
    return edge_rows(tree_file(spark, sf, "newick"))


@query(f"WITH {forest_sql()} SELECT tree::BIGINT AS tree, child, parent, length FROM edges WHERE tree BETWEEN 3 AND 7")
def tree_slices(spark, sf):
    return edge_rows(newick.tree_range(tree_file(spark, sf, "slices"), 3, 7))


@query(f"WITH {forest_sql()} SELECT tree::BIGINT AS tree, child, parent, length FROM edges")
def nexus_tree_files(spark, sf):
    """Tips are numbers in the file, named by its translation block."""
    path = written(newick.to_nexus(forest_lines(spark, sf), list("abcde")), spark, "nexus_trees")
    lines = newick.read_trees(spark, path).withColumn("tree", F.regexp_extract("name", "STATE_([0-9]+)", 1).cast("long"))
    return edge_rows(lines, newick.read_translation(spark, path))


@query("SELECT n_nationkey::BIGINT AS tree, 'a' AS child, n_regionkey::DOUBLE AS lower, (n_nationkey + 7)::DOUBLE AS upper FROM nation UNION ALL SELECT n_nationkey, '#2', 4.5, 4.5 FROM nation")
def calibration_notes(spark, sf):
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("(a[&cal_height={"), F.col("n_regionkey").cast("string"), F.lit(","), (F.col("n_nationkey") + 7).cast("string"), F.lit("}]:1,b[&rate="), k, F.lit("]:2)[&cal_height=4.5];"))
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tree"), text.alias("newick"))
    return newick.calibrations(newick.edges(lines))


@query(f"WITH {SAMPLES_SQL} SELECT chain, iter, round(ll, 6) AS ll, beta FROM samples WHERE iter > 50")
def sample_logs(spark, sf):
    """A log per chain, written and read again."""
    rows = O.drop_burnin(S.samples(spark, sf), "chain", ["ts", "event_id"], 0)
    path = place(spark, "samples")
    logs.write_logs(rows.select("chain", "iter", "ll", "beta"), path, "chain", "iter")
    read = logs.read_log(spark, path, ["ll", "beta"], burnin=50)
    return rounded(read.select(F.regexp_extract("file", "chain=([a-z]+)/", 1).alias("chain"), "iter", "ll", "beta"))


@query("SELECT l_linenumber, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1")
def number_tables(spark, sf):
    path = place(spark, "numbers")
    table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_tax").write.mode("overwrite").csv(path)
    row = logs.read_matrix(spark, path, 3)
    return row.groupBy(F.col("row")[0].cast("int").alias("l_linenumber")).agg(F.round(F.sum(F.col("row")[1]), 2).alias("quantity"), F.round(F.sum(F.col("row")[2]), 4).alias("tax"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1.5 ELSE -1.0 END::DOUBLE AS value FROM nation")
def checkpoints(spark, sf):
    nations = table(spark, sf, "nation")
    path = place(spark, "checkpoint")
    kept = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("value"))
    logs.write_checkpoint(kept.union(spark.createDataFrame([("unknown", 3.0)], "name string, value double")), path)
    return logs.apply_checkpoint(nations.select(F.col("n_name").alias("name"), F.lit(-1.0).alias("value")), logs.read_checkpoint(spark, path))


@query("SELECT o_orderkey::VARCHAR AS taxon, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END, 8) AS date FROM orders")
def date_tables(spark, sf):
    path = place(spark, "dates")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("strain"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"))
    rows.write.mode("overwrite").option("quoteAll", True).csv(path, header=True)
    return rounded(logs.read_dates(spark, path, "dd/MM/yyyy"), 8)


@query("""WITH s AS (SELECT l_orderkey % 20 AS iter, l_linenumber - 1 AS p, -sum(l_extendedprice) / 1e6 AS lnl FROM lineitem GROUP BY 1, 2),
h AS (SELECT p, ln(count(*)) - ln(sum(exp(-lnl))) AS h FROM s WHERE iter >= 5 GROUP BY p) SELECT round(sum(h * (p + 1)), 4) AS lpml FROM h""")
def pattern_logs(spark, sf):
    """Conditional predictive ordinates from a per-pattern log, five iterations dropped."""
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 20).alias("iter"), (F.col("l_linenumber") - 1).alias("pattern_id")).agg((-F.sum("l_extendedprice") / 1e6).alias("lnl"))
    weights = rows.select("pattern_id").distinct().withColumn("weight", (F.col("pattern_id") + 1).cast("double"))
    samples, read = logs.read_pattern_log(spark, written(logs.pattern_log(rows, weights), spark, "patterns"), burnin=5)
    return rounded(O.cpo(samples.join(read, "pattern_id"), "pattern_id", "lnl", "weight"), 4)


@query("SELECT r_name AS key, 'a = ' || r_regionkey AS value FROM region")
def settings_files(spark, sf):
    lines = table(spark, sf, "region").select(F.explode(F.array(F.concat(F.lit("# "), "r_name", F.lit(" = 0")), F.lit(""), F.concat(F.lit("  "), "r_name", F.lit("=  a = "), F.col("r_regionkey").cast("string"), F.lit(" ")))).alias("value"))
    return logs.read_settings(spark, written(lines, spark, "settings"))


@query("""SELECT n_nationkey, '{"v": [' || n_nationkey || ', 2], "o": {"k": "a,]"}}' AS pruned, n_nationkey + 2.0::DOUBLE AS total FROM nation""")
def documents_read(spark, sf):
    """Trailing commas, ignored objects, commented keys and references by id."""

    @F.pandas_udf("struct<pruned: string, total: double>")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [config.prune(config.read(t)) for t in texts]
        return pd.DataFrame({"pruned": [json.dumps(f) for f in found], "total": [float(sum(config.Registry({"id": "x", "values": f["v"]}).resolve("%x"))) for f in found]})

    text = F.concat(F.lit('{"gone": {"ignore": true, "x": 1}, "_note": 1, "v": ['), F.col("n_nationkey").cast("string"), F.lit(', 2,], "o": {"k": "a,]", "_y": [],},}'))
    return table(spark, sf, "nation").select("n_nationkey", read(text).alias("r")).select("n_nationkey", "r.*")
