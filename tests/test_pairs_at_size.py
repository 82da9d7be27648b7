"""The pairwise ranker without a table of pairs: MLlib's logistic regression on the same pairs, and what it shuffles."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from frontrank.operators import ltr as R
from frontrank.operators import pairs as W
from frontrank.sources.tables import bucketed


@pytest.fixture(scope="module")
def fronts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f in range(60):
        n = int(rng.integers(1, 40))
        x = rng.normal(size=(n, 2)) * (1000.0, 0.1)
        label = np.round(np.clip(x[:, 0] / 2000 + 3 * x[:, 1] + rng.normal(size=n), 0, None), 1)
        rows += [(f, i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "front_id long, item_id long, a double, b double, label double")


def test_weights_are_those_of_mllib(fronts):
    both = R._pairs(fronts.withColumns({"score": F.lit(0.0), "x": F.array("a", "b")}), ["x"]).filter("delta > 0")
    side = F.when(F.xxhash64("front_id", "a", "b") % 2 == 0, 1.0).otherwise(-1.0)
    made = both.withColumn("side", side).select(((F.col("side") + 1) / 2).alias("label"), "delta", *[((F.col("x_a")[i] - F.col("x_b")[i]) * F.col("side")).alias(f"d{i}") for i in range(2)])
    sums = made.agg(F.sum("delta"), F.sum(F.col("delta") * F.col("delta"))).first()
    ready = VectorAssembler(inputCols=["d0", "d1"], outputCol="features").transform(made)
    want = LogisticRegression(weightCol="delta", regParam=0.01, fitIntercept=False, maxIter=200, tol=1e-12).fit(ready).coefficients
    got = R.fit(fronts, "pairwise", ["a", "b"]).weights
    assert got == pytest.approx(list(want), rel=1e-2) and got[0] / got[1] == pytest.approx(want[0] / want[1], rel=1e-3)
    assert W._summed(W.packed(fronts, ["a", "b"]), np.zeros(2), R.HEAD)[:2] == pytest.approx(list(sums))


def test_pairs_are_neither_shuffled_nor_cached(spark, fronts):
    table = bucketed(fronts, "pairs_test", "front_id", 3)
    text = W.packed(table, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Bucketed: true" in text and "Join" not in text
    R.fit(table, "pairwise", ["a", "b"])
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_no_pair_gives_no_weight(spark):
    flat = spark.createDataFrame([(1, 0, 1.0, 0.5), (1, 1, 2.0, 0.5), (2, 0, 1.0, 0.1)], "front_id long, item_id long, a double, label double")
    assert R.fit(flat, "pairwise", ["a"]).weights == [0.0]
