"""Sharding by a keyed permutation of global row numbers.

A generalised Feistel network permutes Z_a x Z_b, the smallest near-square grid that holds all n rows, and cycle walking
brings the result back below n. The permutation has an inverse, so that the shard and slot of a row, and the row at a
shard and slot, are computed without looking at any other row.

Edge cases: an empty table gives an empty result. A null text has no bytes (checksum 0). Rows with null or equal doc_id
are ordered by their other columns; wholly equal rows take neighbouring row numbers, which of them comes first does not
show in the result. Extra columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import U64, mix64, number_rows, table

N_SHARDS = 40
SEED = 20240607


class FeistelPermutation:
    """A reproducible bijection of 0..n-1, evaluated on arrays."""

    def __init__(self, n: int, seed: int, rounds: int = 6):
        self.n, self.rounds = n, rounds
        self.a = isqrt(max(n - 1, 0)) + 1
        self.b = -(-max(n, 1) // self.a)
        self.keys = [int(k) for k in mix64(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ U64(seed))]

    def _f(self, r: int, half: np.ndarray, modulus: int) -> np.ndarray:
        return (mix64(half.astype(U64) ^ U64(self.keys[r])) % U64(modulus)).astype(np.int64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r in range(self.rounds):
            if r % 2 == 0:
                left = (left + self._f(r, right, self.a)) % self.a
            else:
                right = (right + self._f(r, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, y: np.ndarray) -> np.ndarray:
        left, right = y // self.b, y % self.b
        for r in reversed(range(self.rounds)):
            if r % 2 == 0:
                left = (left - self._f(r, right, self.a)) % self.a
            else:
                right = (right - self._f(r, left, self.b)) % self.b
        return left * self.b + right

    def _walk(self, step, x: np.ndarray) -> np.ndarray:
        out = step(np.asarray(x, dtype=np.int64))
        while (beyond := np.flatnonzero(out >= self.n)).size:
            out[beyond] = step(out[beyond])
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(self._once, x)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(self._back, y)

    def place(self, row: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.forward(row)
        return at % n_shards, at // n_shards

    def row_at(self, shard: np.ndarray, slot: np.ndarray, n_shards: int) -> np.ndarray:
        return self.inverse(np.asarray(slot, dtype=np.int64) * n_shards + np.asarray(shard, dtype=np.int64))


def shard_rows(df: DataFrame, order: list, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``: shard sizes differ by one row at most, slots are gapless from 0."""
    numbered, n = number_rows(df, order)
    permutation = FeistelPermutation(n, seed)

    @F.arrow_udf("long")
    def permuted(row: pa.Array) -> pa.Array:
        return pa.array(permutation.forward(row.to_numpy(zero_copy_only=False)))

    at = numbered.withColumn("_at", permuted("row_number"))
    return at.withColumn("shard", (F.col("_at") % n_shards).cast("int")).withColumn("slot", F.expr(f"_at div {n_shards}")).drop("_at")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents to 40 shards; law ``rows``. Equal texts are not kept together under this law."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_tail")
    )
    placed = shard_rows(docs, ["doc_id", "text_crc32", "size", "_tail"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
