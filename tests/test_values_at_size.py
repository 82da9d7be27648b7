"""The long table of rule values: what it shuffles and sorts, and that its work is cut by rows."""

from frontrank.operators import metrics as M
from frontrank.operators import stats as S
from frontrank.plans import fixtures as X
from frontrank.plans.comparing import values

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tie_blocks_sort_twice_at_most(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5)], "front_id long, score double, target double")
    assert plan(M.tie_blocks(df)).count("Sort [") <= 2


def test_tie_blocks_order_odd_scores(spark):
    """NaN before all numbers, both zeros in one block, no score last; the floor is the best target before the block."""
    rows = [(float("nan"), 0.1), (float("inf"), 0.9), (0.0, 0.2), (-0.0, 0.3), (float("-inf"), 0.4), (None, 0.5)]
    df = spark.createDataFrame([(1, s, t) for s, t in rows], "front_id long, score double, target double")
    got = {r["target"]: (r["start"], r["b"], r["j"], r["floor"]) for r in M.tie_blocks(df, (6,)).collect()}
    assert got == {0.1: (0, 1, 1, None), 0.9: (1, 1, 1, 0.1), 0.2: (2, 2, 1, 0.9), 0.3: (2, 2, 2, 0.9), 0.4: (4, 1, 1, 0.9), 0.5: (5, 1, 1, 0.9)}


def test_values_lie_by_front(spark, monkeypatch):
    """Windows over a front's values need no exchange, and the parts grow with line items."""
    monkeypatch.setattr(X, "TASK", 2000)
    parts = X.tasks(spark, SMALL)
    v = values(spark, SMALL)
    assert parts == 3 and len(v.select("front_id").inputFiles()) == parts
    text = plan(S.method_ranks(v))
    assert "Exchange" not in text and "Bucketed: true" in text


def test_pairing_deals_no_values_out_by_metric(spark):
    """Beyond the broadcast threshold too, values stay where their front is."""
    v = values(spark, SMALL)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(S.paired(v))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
