"""Running summaries of sample logs that chains are still writing. An addition: batch results do not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "rung int, beta double, iter long, ll double"


def watch(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of a directory of tab-separated logs, as files arrive."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).csv(path)


def running_rungs(rows: DataFrame) -> DataFrame:
    """Per inverse temperature: samples so far, mean, variance and the greatest log-likelihood; state is a row per rung."""
    return rows.groupBy("beta").agg(F.count("ll").alias("n"), F.avg("ll").alias("mean"), F.var_samp("ll").alias("var"), F.max("ll").alias("top"))


def windowed(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` are dropped and closed windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
