"""Metrics of fronts whose scores are arrays, as screening and tuning have them: those of the windows, without a sort."""

import numpy as np
from pyspark.sql import functions as F

from frontrank.operators import metrics as M


def test_packed_fronts_have_the_metrics_of_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for front in range(120):
        n = front % 9 + 1
        score, target = np.round(rng.normal(size=n), front % 3), np.round(rng.normal(size=n), front % 2)
        if front % 10 == 0:
            score[:] = -0.0 if front % 20 else 1.5
            target = target * 0.0 if front % 40 else target
        rows += [(front % 2, front, float(s) if s else (0.0, -0.0)[i % 2], float(t)) for i, (s, t) in enumerate(zip(score, target, strict=True))]
    df = spark.createDataFrame(rows, "run int, front_id long, score double, target double")
    packed = df.groupBy("run", "front_id").agg(F.collect_list("score").alias("score"), F.collect_list("target").alias("target"))
    found = M.long_metrics(packed, (1, 3, 5), over=["run"])
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got, want = ({(r["run"], r["front_id"], r["metric"]): r["value"] for r in x.collect()} for x in (found, M.long_metrics(df, (1, 3, 5), over=["run"])))
    assert got.keys() == want.keys() and len(want) > 1200
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_an_unknown_target_counts_as_in_rows(spark):
    """A target that isn't a number is the largest."""
    df = spark.createDataFrame([(1, 0.1 * i, t) for i, t in enumerate((0.3, float("nan"), 0.1, float("nan"), 0.2, 0.5))], "front_id long, score double, target double")
    packed = df.groupBy("front_id").agg(F.collect_list("score").alias("score"), F.collect_list("target").alias("target"))
    got, want = ({r["metric"]: str(round(r["value"], 9)) for r in M.long_metrics(x, (1, 5)).collect()} for x in (packed, df))
    assert got == want
