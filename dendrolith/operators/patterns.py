"""Alignments in long form (taxon, site, state) and their site patterns.

An alignment has one row per taxon and site; a missing row reads as a gap. A pattern is the string of all taxa's states
at a site, in taxon order; compression counts equal patterns, which is the one shuffle that later operators share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED = ("A", "C", "G", "T")
#: Taxa up to which a site's states are gathered in a column each.
WIDE = 256


def taxa_of(aln: DataFrame) -> list:
    """Taxa in order; their number is a dimension of the alignment and small."""
    return [r[0] for r in aln.select("taxon").distinct().orderBy("taxon").collect()]


def columns_of(aln: DataFrame, taxa: Sequence, width: int = 1) -> DataFrame:
    """(site, pattern): each site's states in taxon order, gaps where a taxon has none.

    One-letter states of up to WIDE taxa are summed up as numbers, a buffer per taxon, which stays in generated code.
    """
    if width == 1 and len(taxa) <= WIDE:
        codes = aln.groupBy("site").agg(*[F.max(F.when(F.col("taxon") == t, F.ascii("state"))).alias(f"_{n}") for n, t in enumerate(taxa)])
        return codes.select("site", F.concat(*[F.coalesce(F.char(F.col(f"_{n}")), F.lit("-")) for n in range(len(taxa))]).alias("pattern"))
    at = F.map_from_entries(F.collect_list(F.struct("taxon", "state")))
    states = F.transform(F.lit(list(taxa)), lambda t: F.coalesce(F.element_at(F.col("at"), t), F.lit("-" * width)))
    return aln.groupBy("site").agg(at.alias("at")).select("site", F.concat_ws("", states).alias("pattern"))


def compress(columns: DataFrame) -> DataFrame:
    """(pattern, weight)."""
    return columns.groupBy("pattern").agg(F.count("*").alias("weight"))


def compress_partials(columns: DataFrame) -> DataFrame:
    """Equal real-valued columns (site, partial array<double>) with their number and first site."""
    return columns.groupBy("partial").agg(F.count("*").alias("weight"), F.min("site").alias("first"))


def attribute_pattern(attributes: DataFrame, taxa: Sequence, states: Sequence[str]) -> DataFrame:
    """One pattern from a table (taxon, value): each taxon's place among the states, unknown values last."""
    place = F.array_position(F.lit(list(states)), F.col("value"))
    code = F.when(place > 0, place - 1).otherwise(len(states)).cast("int")
    at = F.map_from_entries(F.collect_list(F.struct("taxon", code.alias("code"))))
    return attributes.agg(at.alias("at")).select(F.transform(F.lit(list(taxa)), lambda t: F.coalesce(F.element_at("at", t), F.lit(len(states)))).alias("pattern"), F.lit(1).cast("long").alias("weight"))


def in_tree_order(sequences_: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows sorted by the place of their taxon among a tree's tips."""
    return sequences_.withColumn("_at", F.array_position(F.lit(list(order)), F.col("taxon"))).orderBy("_at").drop("_at")


def codon_alignment(aln: DataFrame) -> DataFrame:
    """Sites in threes: (taxon, site, state) with three-letter states; incomplete codons are gaps."""
    letters = F.map_from_entries(F.collect_list(F.struct((F.col("site") % 3).alias("p"), "state")))
    state = F.concat_ws("", *[F.coalesce(F.element_at(F.col("l"), F.lit(p).cast("bigint")), F.lit("-")) for p in range(3)])
    whole = aln.withColumn("site", F.col("site").cast("bigint")).groupBy("taxon", F.expr("site div 3").alias("codon")).agg(letters.alias("l"))
    return whole.select("taxon", F.col("codon").alias("site"), state.alias("state"))


def slice_sites(aln: DataFrame, start: int = 0, length: int | None = None, every: int = 1) -> DataFrame:
    keep = (F.col("site") >= start) & ((F.col("site") - start) % every == 0)
    return aln.where(keep if length is None else keep & (F.col("site") < length))


def codon_position(aln: DataFrame) -> DataFrame:
    return aln.withColumn("position", (F.col("site") % 3 + 1).cast("int"))


def drop_empty_sites(aln: DataFrame) -> DataFrame:
    """Rows of sites where some taxon has a resolved or ambiguous state."""
    alive = aln.where(~F.col("state").isin("-", "?", "N")).select("site").distinct()
    return aln.join(alive, "site", "left_semi")


def state_array() -> Column:
    return F.array_distinct(F.filter(F.split("pattern", ""), lambda s: s.isin(*RESOLVED)))


def polymorphic(patterns: DataFrame) -> DataFrame:
    """Sites with two resolved states at least."""
    return patterns.agg(F.sum(F.when(F.size(state_array()) > 1, F.col("weight")).otherwise(0)).cast("long").alias("n_sites"))


def pattern_states(patterns: DataFrame) -> DataFrame:
    """(state, n) over distinct patterns, not weighted."""
    return patterns.select(F.explode(F.split("pattern", "")).alias("state")).where("state <> ''").groupBy("state").agg(F.count("*").alias("n"))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Patterns of two alignments with weights added."""
    return one.unionByName(other).groupBy("pattern").agg(F.sum("weight").alias("weight"))


def reweight(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """Replace weights by (pattern, new_weight); weight 0 removes a pattern."""
    return patterns.join(weights, "pattern").where("new_weight > 0").select("pattern", F.col("new_weight").alias("weight"))


def jackknife(patterns: DataFrame) -> DataFrame:
    """The weights left in each delete-one-site replicate: (pattern, weight, n_replicates)."""
    return patterns.select("pattern", (F.col("weight") - 1).alias("weight"), F.col("weight").alias("n_replicates"))


def expand(patterns: DataFrame) -> DataFrame:
    """One row per site."""
    return patterns.select(F.explode(F.array_repeat("pattern", F.col("weight").cast("int"))).alias("pattern"))


def split_evenly(patterns: DataFrame, parts: int) -> DataFrame:
    """Patterns dealt to chunks by a hash of the pattern, so that no global order is needed."""
    return patterns.withColumn("chunk", F.pmod(F.xxhash64("pattern"), F.lit(parts)).cast("int"))


def unconstrained(patterns: DataFrame) -> DataFrame:
    """Log-likelihood of the multinomial over patterns."""
    w = F.col("weight").cast("double")
    return patterns.agg(F.sum(w * F.log(w)).alias("s"), F.sum(w).alias("n")).select((F.col("s") - F.col("n") * F.log("n")).alias("lnl"))


#: Sites that are put together at a time.
BLOCK = 1 << 12


def sequences(aln: DataFrame, n_sites: int) -> DataFrame:
    """(taxon, seq): whole sequences, gaps filled.

    A taxon's sites are put together in blocks, then the blocks, each in one pass over sorted places; two states of a taxon at
    a site are an error. Sites outside 0 to n_sites - 1 are left out."""
    at = F.col("site").cast("long")
    block = F.when(at.between(0, n_sites - 1), F.floor(at / BLOCK))
    own = F.when(block.isNotNull(), F.struct(at.alias("start"), (at + 1).alias("stop"), "state"))
    first = F.col("_block") * BLOCK
    stop = F.least(first + BLOCK, F.lit(n_sites))
    blocks = aln.groupBy("taxon", block.alias("_block")).agg(F.sort_array(F.collect_list(own)).alias("_s"))
    parts = F.when(F.col("_block").isNotNull(), F.struct(first.alias("start"), stop.alias("stop"), _filled("_s", first, stop).alias("state")))
    whole = blocks.select("taxon", parts.alias("_p")).groupBy("taxon").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return whole.select("taxon", _filled("_p", F.lit(0), F.lit(n_sites)).alias("seq"))


def _filled(pieces: str, start: Column, stop: Column) -> Column:
    """The states of sorted pieces (start, stop, state) in one string, with gaps before, between and behind them."""
    p = F.col(pieces)
    gaps = lambda since, until: F.repeat(F.lit("-"), (until - since).cast("int"))

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(p, i - 1)["stop"], start)
        return F.when(x["start"] < before, F.raise_error(F.lit("a taxon has two states at a site")).cast("string")).otherwise(F.concat(gaps(before, x["start"]), x["state"]))

    return F.concat(F.array_join(F.transform(p, piece), ""), gaps(F.coalesce(F.get(p, F.size(p) - 1)["stop"], start), stop))


def concatenate(one: DataFrame, other: DataFrame) -> DataFrame:
    """Taxon-wise concatenation of two tables (taxon, seq)."""
    return one.join(other.withColumnRenamed("seq", "_seq"), "taxon").select("taxon", F.concat("seq", "_seq").alias("seq"))


def long_form(sequences_: DataFrame) -> DataFrame:
    return sequences_.select("taxon", F.posexplode(F.split("seq", "")).alias("site", "state")).where("state <> ''")


def frequencies(aln: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of the resolved states, within ``by``."""
    counts = aln.where(F.col("state").isin(*RESOLVED)).groupBy(*by, "state").agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total")) if by else counts.agg(F.sum("n").alias("total"))
    joined = counts.join(total, list(by)) if by else counts.join(total)
    return joined.select(*by, "state", "n", (F.col("n") / F.col("total")).alias("freq"))


def f3x4(aln: DataFrame, sense: Sequence[str], shared: bool = False) -> DataFrame:
    """Codon frequencies as products of nucleotide frequencies at the three positions (or of all sites), over sense codons."""
    spark = aln.sparkSession
    codons = spark.createDataFrame([(c, *c) for c in sense], "codon string, a string, b string, c string")
    freq = frequencies(aln) if shared else frequencies(codon_position(aln), ["position"])
    for n, name in enumerate("abc", 1):
        own = freq if shared else freq.where(F.col("position") == n)
        codons = codons.join(F.broadcast(own.select(F.col("state").alias(name), F.col("freq").alias(f"f{name}"))), name)  # four rows
    product = codons.select("codon", (F.col("fa") * F.col("fb") * F.col("fc")).alias("p"))
    return product.join(product.agg(F.sum("p").alias("total"))).select("codon", (F.col("p") / F.col("total")).alias("freq"))
