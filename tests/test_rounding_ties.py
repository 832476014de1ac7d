"""Doubles beside a tie are rounded as the SQL rounds them."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from dendrolith import catalog
from dendrolith.plans.standins import scaled_round

# logarithms at ties of the sixth digit, alike in both engines
VALUES = [0.6016836320306155, 62.08252199690887, 2.83413138369047, 66.25165859836703, 59.685702344564575, 0.7699339862134088, 55.55961008761406, 0.13532601308721726, 0.0, None, 1e300]


def test_bounded_transforms_at_ties(spark, tmp_path):
    path, con = str(tmp_path), duckdb.connect()
    rows = [(k, 7 * k, v) for k, v in enumerate(VALUES)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    got, want = catalog.queries()["bounded_transforms"](spark, path).toPandas(), con.execute(catalog.oracle_sql()["bounded_transforms"]).df()
    cols = sorted(want.columns)
    pd.testing.assert_frame_equal(got[cols].sort_values("event_id", ignore_index=True), want[cols].sort_values("event_id", ignore_index=True), check_exact=True)


def test_scaled_round_keeps_what_overflows(spark):
    frame = spark.createDataFrame([(1e305,), (float("-inf"),), (None,), (-2.5,), (0.125,)], "x double")
    assert [r[0] for r in frame.select(scaled_round(F.col("x"), 4)).collect()] == [1e305, float("-inf"), None, -2.5, 0.125]
    assert [r[0] for r in frame.where("x < 1").select(scaled_round(F.col("x"), 0)).collect()] == [float("-inf"), -3.0, 0.0]
