"""Reports of many fronts: no row holds a whole model's fronts, and nothing is lost or counted twice."""

from pyspark.sql import functions as F

from frontrank.sources import tables as T


def test_reports_come_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PART", 100)
    v = spark.range(600).select(F.lit("a").alias("model"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").alias("front_id"), F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("metric"))
    v = v.withColumn("value", F.when(F.col("front_id") != 7, F.col("front_id") / 8.0))
    made = T.reports(v)
    assert made.agg(F.max(F.size("groups"))).first()[0] < 120
    T.write_reports(v, str(tmp_path / "r"))
    found = T.read_reports(spark, str(tmp_path / "r"))
    want = {tuple(r) for r in v.filter("value IS NOT NULL").select("model", "fold", "front_id", "metric", "value").collect()}
    got = [tuple(r) for r in T.group_metrics(found).collect()]
    assert len(got) == len(want) == 1198 and set(got) == want
    means = {(r["fold"], r["metric"]): r["value"] for r in v.groupBy("fold", "metric").agg(F.avg("value").alias("value")).collect()}
    folds = T.fold_metrics(found).collect()
    assert len(folds) == 4 and {(r["fold"], r["metric"]): r["value"] for r in folds} == means


def test_no_task_holds_a_models_fronts(spark):
    """Beyond the broadcast threshold too, fronts are dealt out by part, never by model and fold alone."""
    v = spark.range(600).select(F.concat(F.lit("a"), F.col("id") % 3).alias("model"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").alias("front_id"), F.lit("m").alias("metric"), F.lit(1.0).alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = T.reports(v)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in text
