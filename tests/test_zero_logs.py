"""Logarithms of zero and of negative numbers are what SQL gives, not nulls that sums pass over."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dendrolith import catalog
from dendrolith.operators import density

NAMES = ["bounded_transforms", "ctmc_scale", "moment_fits", *[f"density_{n}" for n in ("beta", "beta_prime", "gamma", "kumaraswamy", "lognormal", "one_on_x", "weibull")]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, con = str(tmp_path_factory.mktemp("zeros")), duckdb.connect()
    rows = [(k, k, "abc"[k % 3], v) for k, v in enumerate([0.0, 3.5, 12.0, 2.0, 7.25, None, 9.0, 1.5, 40.0])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    for t in ("region", "nation", "customer", "orders"):
        source = f"/root/testdata/sf0.001/{t}.parquet"
        spark.read.parquet(source).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{source}'")
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_zero_values(spark, tables, name):
    path, con = tables
    got, want = catalog.queries()[name](spark, path).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    pd.testing.assert_frame_equal(got[cols].sort_values(cols, ignore_index=True), want[cols].sort_values(cols, ignore_index=True), check_exact=True)


def test_flat_densities_at_zero(spark):
    x = F.lit(0.0)
    row = spark.range(1).select(density.beta(x, 1.0, 1.0).alias("b"), density.gamma(x, 1.0, 1.0).alias("g"), density.weibull(x, 1.0, 1.0).alias("w"), density.kumaraswamy(x, 1.0, 1.0).alias("k")).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)
