"""Poisson draws by digest: worked out once a row, and the same as from uniform numbers."""

from pyspark.sql import functions as F

from dendrolith.operators import resampling


def digests(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")


def test_digest_is_worked_out_once(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), F.col("id").alias("row"))
    means = resampling.bootstrap_means(rows, "k", "v", 7, row=F.col("row"))
    assert digests(means) == 1
    weights = resampling.bootstrap_weights(spark.range(9).select(F.col("id").alias("pattern"), F.lit(3).alias("weight")), 5)
    assert digests(weights) == 1
    boot = means.withColumnRenamed("mean", "value")
    estimates = rows.groupBy("k").agg(F.avg("v").alias("value"))
    found = resampling.bca_intervals(boot, resampling.leave_one_out_means(rows, ["k"], "v"), estimates, ["k"])
    assert digests(found) == 0 and found.count() == 3  # the replicates are settled before they are read


def test_draws_equal_those_of_uniform_numbers(spark):
    rows = spark.range(30_000)
    drawn = {r.id: r._w for r in resampling.drawn(rows, 3, F.col("id")).collect()}
    plain = rows.select("id", resampling.poisson_draw(resampling.uniform(3, F.col("id"))).alias("w")).where("w > 0").collect()
    assert drawn == {r.id: r.w for r in plain}
    edges = [format(int(b, 16) + d, "012x") for b in resampling.BOUNDS for d in (-1, 0)]
    frame = spark.createDataFrame([(e,) for e in edges], "d string")
    u = F.conv("d", 16, 10).cast("long") / float(1 << 48)
    assert frame.where(resampling.poisson_draw(F.col("d"), resampling.BOUNDS) != resampling.poisson_draw(u)).count() == 0
