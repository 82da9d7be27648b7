"""Correlations of many vectors: tiles meet in groups, and no pair is shuffled on its own."""

import numpy as np
import pytest

from frontrank.operators import expression as E


def _cells(spark, genes, conds, seed):
    rng = np.random.default_rng(seed)
    rows = [(f, g, c, float(rng.normal() + g % 3 * c)) for f in (0, 1) for g in range(genes - 7 * f) for c in range(conds) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "front_id long, gene long, cond long, value double")


@pytest.mark.parametrize("span", [512, 5])
def test_groups_of_tiles_give_the_same_pairs(spark, monkeypatch, span):
    cells = _cells(spark, 90, 12, 5)
    want = {(r["front_id"], r["a"], r["b"]): r["r"] for r in E.correlations(cells).collect()}
    for name, value in (("TILE", 4), ("SPAN", span), ("SIDE", 3), ("WAITING", 2), ("GROUPS", 2)):
        monkeypatch.setattr(E, name, value)
    got = {(r["front_id"], r["a"], r["b"]): r["r"] for r in E.correlations(cells).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 7000


def test_percentile_moves_no_pairs(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(500).selectExpr("id % 3 AS front_id", "id / 500.0D AS m")
        text = E.bounded_percentile(df, "m", 0.9, "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
