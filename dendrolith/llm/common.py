"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
MASK64 = (1 << 64) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; only a session in a single process gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has several processes
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def modest_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of a batch that goes to Python: ten thousand long texts are too many at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def tidy() -> None:
    """Give freed memory back at the end of a task, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on an unsigned 64-bit array."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Smaller batches of the same rows: what a task derives from a batch can be many times its size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    tidy()


def number_rows(df: DataFrame, order: list, to: str = "row_number") -> tuple[DataFrame, int]:
    """Add gapless global row numbers 0..n-1 in the order of ``order``; also returns n.

    The range partitioning spreads rows evenly whatever the keys are, as the physical row id breaks ties
    between wholly equal keys. Only one count per partition comes to the driver.
    """
    tie = F.monotonically_increasing_id().alias("_tie")
    narrow = cut(df.select("*", tie))
    ranged = narrow.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = cut(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), part + 1)
    number = start + F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(to, number.cast("long")).drop("_place"), total
