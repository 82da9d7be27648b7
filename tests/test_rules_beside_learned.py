"""The rules beside a learned ranking rank as the rules alone do: scores that differ by noise tie."""

from pyspark.sql import functions as F

from frontrank.functions import exact_mean, half_up
from frontrank.plans.learning import l12_rules
from frontrank.plans.ranking import rule_metrics

DIR = "/root/testdata/sf0.01"  # the smallest table that has such fronts


def test_rules_agree_with_rule_metrics(spark):
    v = rule_metrics(spark, DIR, (5,)).filter("metric = 'Regret@5'").withColumn("value", F.round("value", 9))
    want = {tuple(r) for r in v.groupBy("rule").agg(half_up(exact_mean("value"), 6), F.count("*")).collect()}
    assert {tuple(r) for r in l12_rules(spark, DIR).collect()} == want
