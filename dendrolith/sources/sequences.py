"""Sequence files (FASTA, NEXUS, PHYLIP) to (taxon, seq) rows, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(text: str) -> str:
    """Format by the first meaningful line."""
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    if first.startswith(">"):
        return "fasta"
    if first.upper().startswith("#NEXUS"):
        return "nexus"
    if re.match(r"\d+\s+\d+", first):
        return "phylip"
    raise ValueError("neither FASTA, NEXUS nor PHYLIP")


def parse_nexus(text: str) -> list[tuple[str, str]]:
    """The MATRIX of a DATA or CHARACTERS block, interleaved or not."""
    clean = re.sub(r"\[[^\]]*\]", "", text)
    found = re.search(r"(?is)begin\s+(?:data|characters)\s*;.*?\bmatrix\b(.*?);", clean)
    if not found:
        raise ValueError("no character matrix")
    out: dict[str, list[str]] = {}
    for line in found[1].splitlines():
        named = re.match(r"\s*(?:'([^']*)'|(\S+))\s+(\S.*)$", line)
        if named:
            out.setdefault(named[1] or named[2], []).append(re.sub(r"\s", "", named[3]))
    return [(k, "".join(v).upper()) for k, v in out.items()]


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Relaxed PHYLIP, sequential or interleaved: later blocks go to the taxa in order."""
    lines = [x for x in text.splitlines() if x.strip()]
    n, length = map(int, lines[0].split()[:2])
    names, parts, at = [], [], 0
    body = lines[1:]
    for line in body:
        if len(names) < n and (not names or len(parts[-1]) >= length or at < n and len(body) % n == 0 and len(names) == at):
            name, *rest = line.split()
            names.append(name)
            parts.append("".join(rest))
            at += 1
        elif len(names) < n:
            parts[-1] += re.sub(r"\s", "", line)
        else:
            short = min(range(n), key=lambda k: (len(parts[k]), k))
            parts[short] += re.sub(r"\s", "", line)
    return [(k, v.upper()) for k, v in zip(names, parts, strict=True)]


def read_fasta(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """Records are split by Spark's reader at line starts, so that a file of any size is read in parallel and a header may
    hold the mark; empty records are dropped."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"^\s+|\s+$", "")
    body = F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    rows = records.select(head.alias("taxon"), (body if keep_case else F.upper(body)).alias("seq"))
    return rows.where("seq <> ''")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, seq) of a file in any of the formats; NEXUS and PHYLIP files are read whole, one file per task."""
    if sniff("\n".join(r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(1).collect())) == "fasta":
        return read_fasta(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("value").to_pylist():
                rows = parse_nexus(text) if sniff(text) == "nexus" else parse_phylip(text)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["taxon", "seq"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "taxon string, seq string")


def sequence_by_name(sequences: DataFrame, taxon: str) -> DataFrame:
    """The rows of one taxon."""
    return sequences.where(F.col("taxon") == taxon)


def to_fasta(sequences: DataFrame) -> DataFrame:
    """One text row per record; write with ``.write.text``."""
    return sequences.select(F.concat(F.lit(">"), "taxon", F.lit("\n"), "seq").alias("value"))


def to_phylip(sequences: DataFrame) -> DataFrame:
    size = sequences.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("l"))
    head = size.select(F.lit(0).alias("k"), F.concat_ws(" ", F.col("n").cast("string"), F.col("l").cast("string")).alias("value"))
    rows = sequences.select(F.lit(1).alias("k"), F.concat_ws("  ", "taxon", "seq").alias("value"))
    return head.union(rows).orderBy("k").select("value")


def to_nexus(sequences: DataFrame, datatype: str = "DNA") -> DataFrame:
    size = sequences.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("l"))
    head = size.select(F.lit(0).alias("k"), F.format_string(f"#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX=%d NCHAR=%d;\nFORMAT DATATYPE={datatype} GAP=- MISSING=?;\nMATRIX", "n", "l").alias("value"))
    rows = sequences.select(F.lit(1).alias("k"), F.concat_ws(" ", "taxon", "seq").alias("value"))
    tail = size.select(F.lit(2).alias("k"), F.lit(";\nEND;").alias("value"))
    return head.union(rows).union(tail).orderBy("k").select("value")
