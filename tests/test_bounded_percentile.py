"""Percentiles of all pairs: exact, and without a map of all values in one group."""

from pyspark.sql import functions as F

from frontrank.operators import expression as E


def test_equals_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("front_id"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6).alias("m"))
    df = df.unionByName(spark.range(9).select(F.lit(8).cast("long").alias("front_id"), F.lit(1.0).alias("m"))).unionByName(spark.createDataFrame([(9, 0.1), (9, 0.9)], "front_id long, m double"))
    want = {r[0]: round(r[1], 12) for r in df.groupBy("front_id").agg(F.percentile("m", F.lit(0.9))).collect()}
    assert {r[0]: round(r[1], 12) for r in E.bounded_percentile(df, "m", 0.9, "p").collect()} == want


def test_features_hold_no_percentile_of_all_pairs(spark):
    cells = spark.range(40).select(F.lit(1).cast("long").alias("front_id"), (F.col("id") % 8).alias("gene"), F.floor(F.col("id") / 8).alias("cond"), F.rand(1).alias("value"))
    assert "percentile(" not in E.correlation_features(cells)._jdf.queryExecution().optimizedPlan().toString()
