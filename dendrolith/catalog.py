"""Registry of the queries of the library and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dendrolith.plans import alignment, extras, files, forests, heaps, markov, numeric, quartets, samples, scalars, trees

MODULES = (alignment, samples, trees, scalars, markov, quartets, files, extras, forests, heaps, numeric)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
