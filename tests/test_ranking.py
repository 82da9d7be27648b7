"""Hand-made fronts with expected labels, ranks, metrics and rule scores."""

from itertools import permutations

import pytest

from frontrank.operators import decision as D
from frontrank.operators import labels as L
from frontrank.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame([(f, i, float(t), float(s)) for i, (f, t, s) in enumerate(rows)], "front_id long, item_id long, target double, score double")


def top(spark, rows, ks=(1, 2, 3, 5)):
    return {(r["front_id"], r["k"]): r for r in M.top_k(frame(spark, rows), ks).collect()}


def test_two_tied_scores(spark):
    got = top(spark, [(1, 1.0, 0.9), (1, 0.2, 0.9), (1, 0.1, 0.1)])
    assert got[1, 1]["best_target"] == pytest.approx(0.6) and got[1, 1]["regret"] == pytest.approx(0.4) and got[1, 1]["hit"] == pytest.approx(0.5)
    assert got[1, 2]["best_target"] == pytest.approx(1.0) and got[1, 2]["regret"] == 0 and got[1, 2]["hit"] == pytest.approx(1)
    assert (1, 5) not in got


def test_all_scores_tied_equals_all_orders(spark):
    targets = [1.0, 0.8, 0.2]
    got = top(spark, [(1, t, 0.5) for t in targets])
    for k in (1, 2, 3):
        orders = list(permutations(targets))
        assert got[1, k]["best_target"] == pytest.approx(sum(max(o[:k]) for o in orders) / len(orders))
        assert got[1, k]["hit"] == pytest.approx(sum(1.0 in o[:k] for o in orders) / len(orders))


def test_mean_is_over_fronts(spark):
    rows = [(1, 1.0 if i == 0 else 0.0, -i) for i in range(10)] + [(2, 0.0, 1.0), (2, 1.0, 0.0)]
    mean = {r["metric"]: r["value"] for r in M.front_mean(M.long_metrics(frame(spark, rows), (1,))).collect()}
    assert mean["Regret@1"] == pytest.approx(0.5) and mean["Hit@1"] == pytest.approx(0.5)


def test_rank_in_front_ignores_row_order(spark):
    rows = [(1, 0.1, 0.5), (1, 0.2, 0.5), (1, 0.3, 0.9), (2, 0.1, 0.1), (2, 0.4, 0.1)]
    df = frame(spark, rows)
    one = {(r["front_id"], r["item_id"]): r["rank_in_front"] for r in L.rank_in_front(df).collect()}
    two = {(r["front_id"], r["item_id"]): r["rank_in_front"] for r in L.rank_in_front(df.orderBy("item_id", ascending=False).repartition(2)).collect()}
    assert one == two and one[1, 2] == 1 and sorted(v for (f, _), v in one.items() if f == 1) == [1, 2, 3]


def test_label_modes(spark):
    df = frame(spark, [(1, t, 0) for t in (0.1, 0.5, 0.5, 0.9)] + [(2, 0.3, 0), (2, 0.3, 0)])
    of = lambda mode: [r["label"] for r in L.build_labels(df, mode, quantiles=2).orderBy("item_id").collect()]
    assert of("rank_dense") == [1, 2, 2, 3, 1, 1]
    assert of("rank_avg") == [0, 2, 2, 3, 0, 0]
    assert of("continuous") == pytest.approx([0, 0.5, 0.5, 1, 0, 0])
    assert of("reversed") == pytest.approx([1, 0.5, 0.5, 0, 1, 1])
    assert of("quantiles") == [0, 0, 0, 1, 0, 0]
    assert sorted(of("shuffled")[:4]) == pytest.approx([0, 0.5, 0.5, 1])
    with pytest.raises(ValueError):
        L.build_labels(df, "other")


def test_constant_sides_give_zero_correlation(spark):
    df = frame(spark, [(1, 0.1, 0.5), (1, 0.2, 0.5), (2, 0.1, 0.1), (2, 0.2, 0.3)])
    assert {r["front_id"]: r["kendall"] for r in M.kendall(df).collect()} == {1: 0.0, 2: 1.0}
    assert {r["front_id"]: round(r["spearman"], 9) for r in M.spearman(df).collect()} == {1: 0.0, 2: 1.0}


def test_badness_and_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 2.0, 2.0), (1, 3, 3.0, 3.0)], "front_id long, item_id long, loss double, gain double")
    rows = D.with_badness(df, {"loss": "minimize", "gain": "maximize"}).orderBy("item_id").collect()
    assert [r["bad_loss"] for r in rows] == [0, 0.5, 1] and [r["bad_gain"] for r in rows] == [1, 0.5, 0]


def test_vikor_per_front(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 0.0), (1, 3, 0.4, 0.4), (2, 1, 0.0, 5.0), (2, 2, 1.0, 5.0), (2, 3, 0.75, 5.0)], "front_id long, item_id long, a double, b double")
    bad = D.with_badness(df, {"a": "minimize", "b": "minimize"})
    got = [r["vikor"] for r in D.with_vikor(bad, ["a", "b"]).orderBy("front_id", "item_id").collect()]
    assert got == pytest.approx([-1, -1, 0, 0, -1, -0.75])


def test_weights_are_checked():
    assert D.checked_weights(["a", "b"], {"a": 3, "b": 1}) == {"a": 0.75, "b": 0.25}
    for wrong in ({"a": 1}, {"a": -1, "b": 2}, {"a": 0, "b": 0}):
        with pytest.raises(ValueError):
            D.checked_weights(["a", "b"], wrong)
