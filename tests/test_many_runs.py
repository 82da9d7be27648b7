"""Many boosted runs in one job, against plain loops and MLlib."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from frontrank.operators import boosting as B
from frontrank.operators import labels as L
from frontrank.operators import ltr as R
from frontrank.operators import metrics as M
from frontrank.plans import learning
from frontrank.sources.tables import Scratch

ORDER = ["a", "b"]


@pytest.fixture(scope="module")
def fronts(spark):
    rows = [(f, f % 3, i, ((i * 7 + f * 3) % 10) / 10.0, ((i * 3 + f) % 5) / 5.0) for f in range(9) for i in range(8)]
    return spark.createDataFrame(rows, "front_id long, fold int, item_id long, a double, b double").selectExpr("*", "a * 0.8 + b * b * 0.2 AS target").cache()


def test_pushes_of_all_pairs():
    rng = np.random.default_rng(1)
    labels, scores = rng.integers(0, 4, (3, 9)).astype(np.float32), rng.normal(size=(3, 9)).astype(np.float32)
    for top in (2, 8):
        g, h = B._swaps(labels, scores, top)
        for r in range(3):
            order = np.argsort(-scores[r], kind="stable")
            place = np.argsort(order)
            best = sum(x / np.log2(i + 2) for i, x in enumerate(sorted(labels[r], reverse=True)))
            wg, wh = np.zeros(9), np.zeros(9)
            for i in range(9):
                for j in range(9):
                    if labels[r, i] > labels[r, j] and min(place[i], place[j]) < top:
                        w = (labels[r, i] - labels[r, j]) * abs(1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2)) / best
                        miss = 1 / (1 + np.exp(scores[r, i] - scores[r, j]))
                        wg[i] += w * miss
                        wg[j] -= w * miss
                        wh[[i, j]] += w * miss * (1 - miss)
            assert np.allclose(g[r], wg, atol=1e-5) and np.allclose(h[r], wh, atol=1e-5)


def test_noise_pushes_the_better_neighbour():
    rng = np.random.default_rng(3)
    labels = np.array([[0.0, 1.0, 2.0, 3.0]], np.float32)
    g = sum(B._neighbours(labels, np.zeros((1, 4), np.float32), rng)[0] for _ in range(200))
    assert (np.diff(g[0]) > 0).all() and abs(g.sum()) < 1e-2
    assert not B._neighbours(np.zeros((1, 4), np.float32), np.zeros((1, 4), np.float32), rng)[0].any()


def _sums(bins, node, first, nodes, push, bend):
    out = np.zeros((nodes, bins.shape[1], B.BINS, 3))
    for k in np.flatnonzero((node >= first) & (bend != 0)):
        for f in range(bins.shape[1]):
            out[node[k] - first, f, bins[k, f]] += [push[k], bend[k], 1]
    return out


def _tree(bins, push, bend, run, depth):
    feature, cut, value = np.full((1, 2 ** (depth + 1) - 1), -1, np.int16), np.zeros((1, 2 ** (depth + 1) - 1), np.uint8), np.zeros((1, 2 ** (depth + 1) - 1))
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        node = B.leaves(bins, feature, cut, level)[0]
        f, c, own, left, right = B.split(_sums(bins, node, first, nodes, push, bend), run, np.ones(bins.shape[1], bool))
        if not level:
            value[0, 0] = own[0]
        for k in range(nodes):
            at = first + k
            if (not level or feature[0, (at - 1) // 2] >= 0) and f[k] >= 0:
                feature[0, at], cut[0, at] = f[k], c[k]
                value[0, 2 * at + 1], value[0, 2 * at + 2] = left[k], right[k]
    return feature, cut, value


def test_trees_equal_mllib(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 3))
    y = np.where(x[:, 0] > 6, 3.0, 0.0) + np.where(x[:, 1] > 3, 1.0, 0.0) * (x[:, 0] <= 6) + 0.01 * rng.normal(size=300)
    run = B.Run("r", "listwise", "continuous", setting=(("l2", 0.0), ("rate", 1.0), ("least_rows", 1), ("least_weight", 0.0)))
    feature, cut, value = _tree(x.astype(np.uint8), y, np.ones(300), run, 3)
    own = np.take_along_axis(value, B.leaves(x.astype(np.uint8), feature, cut, 3), 1)[0]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x0 double, x1 double, x2 double, label double")
    ready = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df)
    model = DecisionTreeRegressor(maxDepth=3, maxBins=32, minInstancesPerNode=1).fit(ready)
    known = [r["prediction"] for r in model.transform(ready).orderBy("id").collect()]
    assert np.allclose(own, known)


def test_a_round_equals_the_loop(spark, fronts):
    runs = [B.Run(f"{kind}{f}", kind, "continuous", (f,), setting=(("rounds", 1), ("depth", 2), ("least_rows", 2))) for kind in B.FAMILIES for f in (0, 1)]
    with Scratch(spark) as scratch:
        forest, state = B.boosted(fronts, ORDER, runs, scratch)
        scores = {(r["run"], r["front_id"], r["item_id"]): r["score"] for r in B.scores_of(state, runs, {f: range(len(runs)) for f in range(3)}).collect()}
        job = B.Job(runs, ["continuous"], 2)
    rows = L.build_labels(fronts, "continuous").orderBy("front_id", "item_id").toPandas()
    bins = B.binned(rows[ORDER].to_numpy(), forest.edges)
    push, bend = np.zeros((len(runs), len(rows)), np.float32), np.zeros((len(runs), len(rows)), np.float32)
    for f, own in rows.groupby("front_id").indices.items():
        push[:, own], bend[:, own] = job.gradients(int(f), int(rows.fold[own[0]]), rows.label.to_numpy(np.float32)[own][None, :], np.zeros((len(runs), len(own)), np.float32), 0)
    for i, r in enumerate(runs):
        feature, cut, value = _tree(bins, push[i], bend[i], r, 2)
        want = np.take_along_axis(value, B.leaves(bins, feature, cut, 2), 1)[0]
        got = [scores[i, f, k] for f, k in zip(rows.front_id, rows.item_id, strict=True)]
        assert np.allclose(got, want, atol=1e-4), r.name
    again = {(r["name"], r["front_id"], r["item_id"]): r["score"] for r in B.predicted(fronts, forest).collect()}
    assert all(abs(again[runs[i].name, f, k] - s) < 1e-6 for (i, f, k), s in scores.items())


def test_held_out_fronts_teach_nothing(spark, fronts):
    other = fronts.withColumn("target", F.when(F.col("fold") == 0, 1 - F.col("target")).otherwise(F.col("target")))
    runs = [B.Run("in", "listwise", "continuous", (1,), setting=(("rounds", 2),)), B.Run("out", "listwise", "continuous", (0,), setting=(("rounds", 2),))]
    with Scratch(spark) as scratch:
        a, b = (B.boosted(df, ORDER, runs, scratch)[0] for df in (fronts, other))
    for x, y in zip(a.rounds, b.rounds, strict=True):
        assert all(np.array_equal(p[1], q[1]) for p, q in zip(x, y, strict=True))
    assert any(not np.array_equal(p[0], q[0]) for x, y in zip(a.rounds, b.rounds, strict=True) for p, q in zip(x, y, strict=True))


def test_runs_are_named_once(spark, fronts):
    with pytest.raises(ValueError, match="twice"), Scratch(spark) as scratch:
        B.boosted(fronts, ORDER, [B.Run("x", "listwise", "continuous")] * 2, scratch)
    with pytest.raises(ValueError, match="unknown"), Scratch(spark) as scratch:
        B.boosted(fronts, ORDER, [B.Run("x", "other", "continuous")], scratch)
    with pytest.raises(ValueError, match="twice"):
        R.tuning_runs([("listwise", "continuous")] * 2)
    with pytest.raises(ValueError, match="empty"):
        R.tuning_runs([])


def test_the_grids_are_whole():
    assert [len(R.GRID[f]) for f in B.FAMILIES] == [27, 36, 36]
    runs = R.tuning_runs([(f, "continuous") for f in B.FAMILIES])
    assert len({r.name for r in runs}) == 99 and "listwise__continuous__d6_mcs50_lr005" in {r.name for r in runs}
    assert len(R.screening_runs(modes=learning.SCREENED)) == 24


def test_screening_tuning_and_ablation(spark, fronts):
    df = fronts.drop("fold")
    found = R.screening(df, ORDER, modes=("continuous", "reversed"), k=3, params={f: {"rounds": 2} for f in B.FAMILIES})
    mean = {r["method"]: r["v"] for r in found.filter("metric = 'Spearman'").groupBy("method").agg(F.avg("value").alias("v")).collect()}
    assert len(mean) == 6 and all(mean[f"{f}__continuous"] > 0.5 > 0 > mean[f"{f}__reversed"] for f in B.FAMILIES)
    assert {r["n"] for r in found.groupBy("method", "metric").agg(F.count_distinct("front_id").alias("n")).collect()} == {9}
    tuned = R.tuning(df, ORDER, [("sampled", "continuous")], {"sampled": [{"rounds": 1, "depth": 2}, {"rounds": 3, "depth": 1}]})
    assert {r[0] for r in tuned.select("method").distinct().collect()} == {"sampled__continuous__rounds1_d2", "sampled__continuous__rounds3_d1"}
    splits = df.select("front_id").distinct().withColumn("split", F.when(F.col("front_id") < 3, "test").otherwise("development"))
    gone = R.ablation(df, splits, {"both": ORDER, "a": ["a"], "b": ["b"]}, params={"rounds": 2})
    count = {(r["method"], r["split"]): r["n"] for r in gone.groupBy("method", "split").agg(F.count_distinct("front_id").alias("n")).collect()}
    assert count == {(m, s): n for m in ("both", "a", "b") for s, n in (("development", 6), ("test", 3))}
    best = {r["method"]: r["v"] for r in gone.filter("metric = 'Spearman'").groupBy("method").agg(F.avg("value").alias("v")).collect()}
    assert best["a"] > best["b"]


def test_sampled_pairs_beat_pointwise_on_unseen_fronts(spark):
    df = learning.rows(spark, "/root/testdata/sf0.001").withColumn("fold", (F.col("front_id") % 3 == 0).cast("int"))
    run = B.Run("sampled", "sampled", "continuous", (1,))
    with Scratch(spark) as scratch:
        _, state = B.boosted(df, learning.ORDER, [run], scratch)
        mine = M.ndcg(B.scores_of(state, [run], {1: [0]}), (5,)).agg(F.avg("ndcg")).first()[0]
    ranker = R.fit(L.build_labels(df.filter("fold = 0"), "continuous"), "pointwise", learning.ORDER)
    assert mine > M.ndcg(R.rank_fronts(df.filter("fold = 1"), ranker), (5,)).agg(F.avg("ndcg")).first()[0]
