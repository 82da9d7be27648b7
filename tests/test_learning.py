"""Learned rankings: better than chance on a front where one feature decides."""

import numpy as np
import pytest

from frontrank.operators import boosting as B
from frontrank.operators import labels as L
from frontrank.operators import ltr as R
from frontrank.operators import metrics as M
from frontrank.plans import learning


@pytest.fixture(scope="module")
def fronts(spark):
    rows = [(f, i, ((i * 7 + f * 3) % 10) / 10.0, ((i * 3 + f) % 5) / 5.0) for f in range(6) for i in range(8)]
    return spark.createDataFrame(rows, "front_id long, item_id long, signal double, noise double").selectExpr("*", "signal AS target")


def regret(ranked):
    return next(r["value"] for r in M.front_mean(M.long_metrics(ranked, (1,))).collect() if r["metric"] == "Regret@1")


@pytest.mark.parametrize("kind,params", [("pairwise", {}), ("pointwise", {"rounds": 3}), ("listwise", {"rounds": 2})])
def test_fit_finds_the_signal(spark, fronts, kind, params):
    ranker = R.fit(L.build_labels(fronts, "continuous"), kind, ["signal", "noise"], params)
    assert regret(R.rank_fronts(fronts, ranker)) < 0.1


def test_cross_validation_covers_all_rows(spark, fronts):
    ranked = R.cross_validate(fronts, "pairwise", ["signal", "noise"], k=2)
    assert ranked.count() == fronts.count() and {r["fold"] for r in ranked.select("fold").distinct().collect()} == {0, 1}


def test_unknown_kind(spark, fronts):
    with pytest.raises(ValueError):
        R.fit(fronts, "other", ["signal"])


def test_screening_and_tuning_are_whole(spark, fronts, monkeypatch):
    runs, tuned = [], []

    def screening(df, order, kinds=B.FAMILIES, modes=L.MODES, k=3, params=None):
        runs.append((kinds, modes, k, params))
        made = [(f"{kind}__{mode}", f, metric, float((i + len(kind)) % 8)) for kind in kinds for i, mode in enumerate(modes) for f in range(3) for metric in ("Regret@5", "Regret@1", "Hit@5", "BestTarget@5")]
        return spark.createDataFrame(made, "method string, front_id long, metric string, value double")

    def tuning(df, order, shortlist, grid=R.GRID, k=3):
        tuned.append((shortlist, grid, k))
        return screening(df, order)

    monkeypatch.setattr(learning, "rows", lambda spark, d: fronts)
    monkeypatch.setattr(R, "screening", screening)
    monkeypatch.setattr(R, "tuning", tuning)
    assert learning.l8(spark, "").select("method").distinct().count() == 24
    learning.l9(spark, "")
    kinds, modes, k, params = runs[0]
    assert kinds == B.FAMILIES and set(modes) == {*L.MODES, "quantiles5", "quantiles15"} and k == 3 and params is None
    # Regret@5 is 0 at the mode whose place and the length of the family's name make 8
    assert tuned == [([(kind, modes[-len(kind) % 8]) for kind in B.FAMILIES], R.GRID, 3)]


@pytest.mark.parametrize("bins", [5, 15])
def test_quantile_modes(spark, fronts, bins):
    assert L.build_labels(fronts, f"quantiles{bins}").exceptAll(L.with_quantiles(fronts, bins)).count() == 0


def test_pairs_of_a_front_have_one_side_in_its_head(spark):
    rows = [(1, i, float((i * 7) % 11), float((i * 5) % 9)) for i in range(40)] + [(2, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "front_id long, item_id long, label double, score double")
    got = {(r["a"], r["b"]): r["delta"] for r in R._pairs(df, head=3).collect()}
    own = [r for r in rows if r[0] == 1]
    at = {r[1]: i + 1 for i, r in enumerate(sorted(own, key=lambda r: (-r[3], r[1])))}
    ideal = {r[1]: i + 1 for i, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])))}
    label, best = {r[1]: r[2] for r in own}, sum(r[2] / np.log2(ideal[r[1]] + 1) for r in own)
    head = {i for i in at if at[i] <= 3 or ideal[i] <= 3}
    want = {(i, j): (label[i] - label[j]) * abs(1 / np.log2(at[i] + 1) - 1 / np.log2(at[j] + 1)) / best for i in at for j in at if label[i] > label[j] and (i in head or j in head)}
    assert got == pytest.approx(want) and len(got) <= 2 * 3 * 40
    every = R._pairs(df, ["score"], head=100).collect()
    assert len(every) == sum(label[i] > label[j] for i in at for j in at) and all(r["score_a"] == r["sa"] and r["score_b"] == r["sb"] for r in every)
