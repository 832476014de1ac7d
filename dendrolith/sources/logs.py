"""Sample logs, checkpoints, date tables and matrices as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.operators.scans import ranked, running


def read_log(spark: SparkSession, path: str, columns: Sequence[str], burnin: int = 0) -> DataFrame:
    """(iter, columns...) of tab-separated logs; the first ``burnin`` rows of each file are dropped. Unknown names raise."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#")
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise KeyError(f"no column {missing}")
    first = raw.columns[0]
    rows = raw.select(F.input_file_name().alias("file"), F.col(first).cast("long").alias("iter"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns if c != first])
    if not burnin:
        return rows
    return ranked(rows, ["file"], ["iter"], "_r").where(F.col("_r") > burnin).drop("_r")


def read_rungs(spark: SparkSession, path: str, column: str, betas: Sequence[float], burnin: int = 0) -> DataFrame:
    """(rung, beta, iter, ll) of tempered logs whose file names start with the rung's number."""
    rows = read_log(spark, path, [column], burnin)
    rung = F.regexp_extract("file", r"/([0-9]+)[^/]*$", 1).cast("int")
    beta = F.element_at(F.lit([float(b) for b in betas]).cast("array<double>"), F.col("rung") + 1)
    return rows.withColumn("rung", rung).select("rung", beta.alias("beta"), "iter", F.col(column).alias("ll"))


def read_pattern_log(spark: SparkSession, path: str, burnin: int = 0) -> tuple[DataFrame, DataFrame]:
    """Long samples (iter, pattern_id, lnl) and weights (pattern_id, weight) of a per-pattern log."""
    lines = spark.read.text(path)
    weights = lines.where(F.col("value").startswith("#")).select(F.posexplode(F.split(F.expr("substr(value, 2)"), "\t")).alias("pattern_id", "w"))
    numbers = lines.where(F.col("value").rlike(r"^[0-9]"))
    cells = F.split("value", "\t")
    rows = numbers.select(cells[0].cast("long").alias("iter"), F.expr("slice(split(value, '\t'), 2, 100000000)").alias("c"))
    if burnin:
        rows = ranked(rows, [], ["iter"], "_r").where(F.col("_r") > burnin).drop("_r")
    samples = rows.select("iter", F.posexplode("c").alias("pattern_id", "lnl")).withColumn("lnl", F.col("lnl").cast("double"))
    return samples, weights.select("pattern_id", F.col("w").cast("double").alias("weight"))


def pattern_log(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Text rows of a per-pattern log: the weights behind a mark, then an iteration's log-likelihoods a line, by pattern_id."""
    cells = lambda df, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pattern_id", c))), lambda s: s[c].cast("string")), "\t")
    head = weights.agg(F.lit(-1).cast("long").alias("iter"), F.concat(F.lit("#"), cells(weights, "weight")).alias("value"))
    rows = samples.groupBy("iter").agg(cells(samples, "lnl").alias("v")).select(F.col("iter").cast("long"), F.concat_ws("\t", F.col("iter").cast("string"), "v").alias("value"))
    return head.union(rows).orderBy("iter").select("value")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key = value`` lines; blank lines and lines behind a # are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[^#\s][^=]*="))
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substr(value, length(substring_index(value, '=', 1)) + 2)")).alias("value"))


def site_rate_table(sites: DataFrame, posteriors: DataFrame) -> DataFrame:
    """(site, rate, category) in site order, to be written as a table: each site takes its pattern's posterior."""
    return sites.join(posteriors.select("pattern", "rate", "category"), "pattern").select("site", "rate", "category").orderBy("site")


def write_log(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, sep="\t", header=True)


def write_logs(rows: DataFrame, path: str, chain: str, order: str) -> None:
    """A folder of one log per chain, each in its order: a chain's log is one file, as its readers take the header from its start."""
    rows.repartition(chain).sortWithinPartitions(chain, order).write.mode("overwrite").partitionBy(chain).csv(path, sep="\t", header=True)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="name string, value double")


def apply_checkpoint(parameters: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved values replace those of the same name; unknown names are ignored."""
    return parameters.join(saved.withColumnRenamed("value", "_v"), "name", "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")


def write_checkpoint(parameters: DataFrame, path: str) -> None:
    parameters.select("name", "value").write.mode("overwrite").csv(path)


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(row array<double>) of a headerless table of numbers."""
    schema = ", ".join(f"c{i} double" for i in range(columns))
    return spark.read.csv(path, schema=schema).select(F.array(*[f"c{i}" for i in range(columns)]).alias("row"))


def read_dates(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(taxon, date) of a quoted table with columns strain and date; ``pattern`` turns calendar dates into decimal years."""
    from dendrolith.functions.text import decimal_year

    raw = spark.read.csv(path, header=True, quote='"')
    date = decimal_year(F.to_date("date", pattern)) if pattern else F.col("date").cast("double")
    return raw.select(F.col("strain").alias("taxon"), date.alias("date"))


def classes_in_logs(lines: DataFrame, token: str) -> DataFrame:
    """(block, n_classes, first, last): runs of consecutive trees with the same number of ``token`` classes."""
    n = F.size(F.array_distinct(F.expr(f"regexp_extract_all(value, '{token}=([0-9]+)', 1)")))
    placed = ranked(lines.withColumn("n_classes", n), [], ["at"], "_r")
    before = placed.select((F.col("_r") + 1).alias("_r"), F.col("n_classes").alias("_n"))
    marked = placed.join(before, "_r", "left").withColumn("_new", (F.coalesce("_n", F.lit(-1)) != F.col("n_classes")).cast("long"))
    blocks = running(marked, [], ["at"], {"block": F.col("_new")})
    return blocks.groupBy("block", "n_classes").agg(F.min("at").alias("first"), F.max("at").alias("last"))
