"""Running sums and ranks over ordered groups of any size, and tables that end a lineage.

A window per group holds the group in one task. Here rows are dealt out by range of (group, order), so that a large group
covers many partitions; sums inside a partition are windows, and what the partitions before it add to a group is carried
over from one row per partition and group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, its lineage cut; only a session in a single process gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column per entry of ``sums``: the sum over the rows of the same group up to this one, in the order given.

    Nulls add nothing. Rows that are equal in ``by`` and ``order`` come one after the other, in no fixed order. Columns
    keep their names; ``by`` may be empty for one running sum over the whole table."""
    by, order = list(by), list(order)
    values = {f"_{n}": v for n, v in sums.items()}
    dealt = df.withColumns(values).repartitionByRange(*[F.col(c) for c in by + order])
    placed = settled(dealt.sortWithinPartitions(*by, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before{k}") for k, n in enumerate(sums)])
    here = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({n: F.coalesce(F.sum(f"_{n}").over(here), F.lit(0)) for n in sums})
    group = F.to_json(F.struct(F.lit(0).alias("_"), *by)).alias("_group")  # nulls are groups too
    joined = inside.select("*", group).join(carried.select(group, "_part", *[f"_before{k}" for k in range(len(sums))]), ["_group", "_part"])
    whole = joined.withColumns({n: F.col(n) + F.col(f"_before{k}") for k, n in enumerate(sums)})
    return whole.drop("_group", "_part", "_at", *[f"_{n}" for n in sums], *[f"_before{k}" for k in range(len(sums))])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("long")})
