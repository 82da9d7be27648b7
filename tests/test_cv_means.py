"""Means of a cross-validation report are rounded before they are placed."""

from frontrank.operators import stats as S


def test_means_are_rounded_first(spark):
    rows = [("Hit@5", f, m, v) for m, v in (("b", 0.10517496), ("a", 0.10517504)) for f in (1, 2)]
    rows += [("Hit@5", f, "c", 0.105175) for f in (1, 2)]
    v = spark.createDataFrame(rows, "metric string, front_id long, method string, value double")
    got = {r["method"]: (r["mean"], r["place"]) for r in S.cv_summary(v, digits=7).collect()}
    assert got == {"a": (0.105175, 1), "b": (0.105175, 2), "c": (0.105175, 3)}
