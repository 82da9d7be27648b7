"""The best item's value under each rule: what joining the winners with all scores gives, without that join."""

from pyspark.sql import functions as F

from frontrank.operators import decision as D
from frontrank.plans import fixtures as X
from frontrank.plans import ranking


def test_best_values_are_those_of_the_join(spark):
    rows = spark.range(400).select((F.col("id") % 9).alias("front_id"), F.col("id").alias("item_id"), *[(F.col("id") * i % m / 7.0).alias(c) for c, i, m in (("price", 3, 5), ("discount", 5, 4), ("tax", 7, 3), ("quantity", 11, 2))], (F.col("id") * 13 % 101 / 101.0).alias("target"))
    scores = D.rule_scores(rows, X.OBJECTIVES).withColumn("score", F.round("score", 9))
    want = D.best_candidates(scores).join(scores.select("front_id", "rule", "item_id", "target"), ["front_id", "rule", "item_id"]).select("front_id", "rule", "target")
    got = D.best_values(rows, X.OBJECTIVES, "target", 9)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 9 * 11


def test_line_items_are_shuffled_once(spark):
    text = ranking.d14(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("FileScan parquet") == 1
