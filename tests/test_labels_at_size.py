"""Labels of all modes: what they shuffle."""

from pyspark.sql import functions as F

from frontrank.operators import boosting as B
from frontrank.operators import labels as L


def test_labels_of_all_modes_share_one_exchange(spark):
    """Also beyond the broadcast threshold: fronts are dealt out once."""
    df = spark.range(60).select((F.col("id") % 6).alias("front_id"), (F.col("id") * 7 % 60).alias("item_id"), (F.col("id") % 5 / 5.0).alias("target"))
    known = {(r["front_id"], r["item_id"]): r["label"] for r in L.build_labels(df, "shuffled").collect()}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for i, mode in enumerate((*L.MODES, "quantiles5")):
            df = L.build_labels(df, mode).withColumn(f"l{i}", F.col("label")).drop("label")
        text = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert text.count("Exchange") == 1 and "Join" not in text
    assert {(r["front_id"], r["item_id"]): r["l5"] for r in rows} == known
    for front in range(6):
        own = [r for r in rows if r["front_id"] == front]
        assert sorted(r["l3"] for r in own) == sorted(r["l5"] for r in own) and len(own) == 10


def test_packing_deals_fronts_out_once(spark):
    """Labels of all modes are worked in the parts of the packed table, which are bounded in items."""
    df = spark.range(60).select((F.col("id") % 6).alias("front_id"), F.lit(0).alias("fold"), F.col("id").alias("item_id"), (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 5 / 5.0).alias("target"))
    runs = [B.Run(mode, "listwise", mode) for mode in L.MODES]
    packed = B.packed(df, ["a"], list(L.MODES), B.Job(runs, L.MODES, 1), B.bin_edges(df, ["a"]), 42)
    text = packed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert packed.count() == 6
