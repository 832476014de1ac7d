"""Parameter tables (name, value, estimate)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_parameters(own: DataFrame, more: DataFrame) -> DataFrame:
    """``own`` with the free parameters of ``more`` appended."""
    return own.unionByName(more.where("estimate"))


def without(own: DataFrame, gone: DataFrame) -> DataFrame:
    """``own`` without the parameters that ``gone`` names."""
    return own.join(gone.select("name").distinct(), "name", "left_anti")
