"""Paired comparison of methods over fronts: rank sums, Friedman, Holm, z tests against the winner, summaries.

Tables are long: (metric, front_id, method, value). All metrics are tested in one pass, partitioned by metric. Windows run
over one front's methods or one metric's methods; only per-method totals (a row for each metric and method) meet in one
group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import KS, average_rank, direction, exact_mean, half_up, metric_family, metric_k

# Tier and place of each metric family; the place of k among KS is added.
TIERS = {"Regret": "primary", "BestTarget": "primary", "Hit": "primary", "NDCG": "secondary", "Spearman": "tertiary", "KendallTau": "tertiary", "n_items": "aux"}
PLACES = {"Regret": 10, "BestTarget": 20, "Hit": 30, "NDCG": 40, "Spearman": 50, "KendallTau": 51, "n_items": 99}
ALPHA = 0.05


def paired(values: DataFrame, over: Sequence[str] = ("metric",)) -> DataFrame:
    """Rows of fronts that all methods of the metric have."""
    usable = values.filter(F.col("value").isNotNull())
    methods = usable.select(*over, "method").distinct().groupBy(*over).agg(F.count("*").alias("n_methods"))
    counted = usable.withColumn("__have", F.count("*").over(Window.partitionBy(*over, "front_id")))
    # a row for each metric: a sort-merge join would deal all values out by metric, a few large tasks
    return counted.join(F.broadcast(methods), list(over)).filter("__have = n_methods").drop("__have")


def method_ranks(values: DataFrame, over: Sequence[str] = ("metric",)) -> DataFrame:
    """Average rank of each method in each front; by the metric's direction, 1 is best. tied: how many share the value."""
    signed = values.withColumn("__v", F.col("value") * direction(F.col("metric")))
    tied = F.count(F.lit(1)).over(Window.partitionBy(*over, "front_id", "__v"))
    return signed.withColumns({"rank": average_rank([*over, "front_id"], F.desc("__v"), ["__v"]), "tied": tied}).drop("__v")


def common(values: DataFrame, key: str, over: Sequence[str] = ()) -> DataFrame:
    """Values of key (fronts or metrics) that every method has."""
    usable = values.filter(F.col("value").isNotNull())
    n = usable.select(*over, "method").distinct().groupBy(*over).agg(F.count("*").alias("n")) if over else usable.agg(F.count_distinct("method").alias("n"))
    have = usable.select(*over, key, "method").distinct().groupBy(*over, key).agg(F.count("*").alias("have"))
    joined = have.join(n, list(over)) if over else have.join(F.broadcast(n), F.col("have") == F.col("n"))  # one row
    return joined.filter("have = n").select(*over, key)


def rank_stats(values: DataFrame, over: Sequence[str] = ("metric",)) -> DataFrame:
    """A row for each metric and method: avg_rank, position, Friedman statistic, z against the best average rank.

    The Friedman statistic is corrected for ties, and null if all values tie or there are under 3 methods or 2 fronts.
    Of equal average ranks the first name wins. A single method has rank 1 and no test.
    """
    over = list(over)
    ranked = method_ranks(paired(values, over), over)
    t = F.col("tied")  # t rows of t * t - 1 each make t^3 - t
    per = ranked.groupBy(*over, "method").agg(F.avg("rank").alias("avg_rank"), F.sum("rank").alias("rank_sum"), F.count("*").alias("n_fronts"), F.sum(t * t - 1).alias("ties"))
    group = Window.partitionBy(*over)
    per = per.withColumns({"k": F.count("*").over(group), "squares": F.sum(F.col("rank_sum") * F.col("rank_sum")).over(group), "ties": F.sum("ties").over(group)})
    n, k = F.col("n_fronts").cast("double"), F.col("k").cast("double")
    plain = 12.0 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    fix = 1 - F.col("ties") / (n * (k * k * k - k))
    friedman = F.when((F.col("k") >= 3) & (F.col("n_fronts") >= 2), F.try_divide(plain, F.nullif(fix, F.lit(0.0))))
    best = Window.partitionBy(*over).orderBy("avg_rank", "method")
    per = per.withColumns({"friedman": friedman, "position": F.row_number().over(best), "winner": F.first("method").over(best), "best_rank": F.first("avg_rank").over(best)})
    se = F.sqrt(k * (k + 1) / (6 * n))
    per = per.withColumn("z", F.when(F.col("position") > 1, (F.col("avg_rank") - F.col("best_rank")) / se))
    return per.select(*over, "method", "avg_rank", "n_fronts", "k", "friedman", "position", "winner", "z")


def _chi_tail(x: float, df: int) -> float:
    """P(chi-square > x) for a whole number of degrees of freedom, as a finite sum."""
    if df < 1 or x is None or x != x:
        return float("nan")
    h = max(x, 0.0) / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / (math.sqrt(math.pi) / 2)
    for i in range((df - 1) // 2):
        total += term
        term *= h / (i + 1.5)
    return total


def _normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; the table has a row for each metric and method only."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan"))


def _chi_square_tails(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_chi_tail(a, int(b)) for a, b in zip(x, df, strict=True)])


def holm(df: DataFrame, over: Sequence[str], p: str = "p", name: str = "p_holm", tie: str = "method") -> DataFrame:
    """Holm's step-down correction of p inside groups; null p stays null."""
    order = Window.partitionBy(*over).orderBy(F.asc_nulls_last(p), tie)
    m = F.count(p).over(Window.partitionBy(*over))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn(name, F.when(F.col(p).isNotNull(), F.max("__step").over(order))).drop("__step")


def rank_tests(values: DataFrame, over: Sequence[str] = ("metric",)) -> DataFrame:
    """rank_stats with the Friedman p value, and z tests against the winner corrected by Holm."""
    stats = rank_stats(values, over)
    chi_square_tail, normal_two_sided = (F.pandas_udf(f, "double") for f in (_chi_square_tails, _normal_two_sided))  # no erfc in SQL
    no_nan = lambda c: F.when(~F.isnan(c), c)
    tested = stats.withColumns({"friedman_p": no_nan(chi_square_tail("friedman", F.col("k") - 1)), "p": no_nan(normal_two_sided("z"))})
    done = holm(tested, over)
    return done.withColumn("significant", F.col("p_holm") < ALPHA)


def summary(values: DataFrame, over: Sequence[str] = ("method", "metric")) -> DataFrame:
    """Mean, sample standard deviation and count of each method and metric."""
    return values.groupBy(*over).agg(exact_mean("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def with_tiers(values: DataFrame) -> DataFrame:
    """Tier, order, direction, family and k of each metric."""
    family, k = metric_family(F.col("metric")), metric_k(F.col("metric"))
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), family)
    step = F.greatest(F.array_position(F.array(*map(F.lit, KS)), k).cast("int") - 1, F.lit(0))
    order = F.coalesce(of(PLACES) + F.coalesce(step, F.lit(0)), F.lit(1000))
    return values.withColumns({"tier": F.coalesce(of(TIERS), F.lit("other")), "order": order, "direction": direction(F.col("metric")), "family": family, "k": k})


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Position of each method by mean (in the metric's direction), then by name; no shared places."""
    order = Window.partitionBy("metric").orderBy(F.desc(F.col("mean") * direction(F.col("metric"))), "method")
    return summaries.withColumn("place", F.row_number().over(order))


def pivoted(df: DataFrame, rows: str, columns: str, names: Sequence[str], value: str) -> DataFrame:
    """One row for each `rows`, one column for each name: for presentation."""
    return df.groupBy(rows).pivot(columns, list(names)).agg(F.first(value))


def selected(summaries: DataFrame, ranks: DataFrame, n: int = 1, over: Sequence[str] = ()) -> DataFrame:
    """Methods in order of choice: average rank on Regret@5, its mean, Hit@5, Regret@1, BestTarget@5, then name."""
    names = ["Regret@5", "Hit@5", "Regret@1", "BestTarget@5"]
    wide = pivoted(summaries, "method", "metric", names, "mean").join(ranks.filter("metric = 'Regret@5'").select("method", "avg_rank"), "method")
    keys = [F.asc_nulls_last("avg_rank"), F.asc_nulls_last("Regret@5"), F.desc_nulls_last("Hit@5"), F.asc_nulls_last("Regret@1"), F.desc_nulls_last("BestTarget@5"), F.asc("method")]
    if over:
        return wide.withColumn("choice", F.row_number().over(Window.partitionBy(*over).orderBy(*keys))).filter(F.col("choice") <= n)
    return wide.orderBy(*keys).limit(n)


def cv_summary(values: DataFrame, required: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """A cross-validation report as a whole: mean, std and n of each method and metric, its place, and its average rank.

    values: (method, front_id, metric, value). Metrics in `required` must be there, else it raises. digits: means are
    rounded to so many before they are placed.
    """
    if required:
        have = {r[0] for r in values.select("metric").filter(F.col("metric").isin(*required)).distinct().collect()}
        if missing := sorted(set(required) - have):
            raise ValueError(f"missing metrics: {', '.join(missing)}")
    ranks = rank_stats(values).select("metric", "method", "avg_rank", "friedman", "z")
    means = summary(values) if digits is None else summary(values).withColumn("mean", half_up("mean", digits))
    return leaderboard(means).join(ranks, ["metric", "method"], "left")


def phase_summary(summaries: DataFrame, required: Sequence[str], runs: DataFrame | None = None, primary: str = "Regret@5") -> DataFrame:
    """(method, metrics, primary_mean) of a phase's runs, from summaries (method, metric, mean).

    Every method must have all required metrics, and every run of `runs` (method) a report; what lacks is named in the error.
    """
    per = summaries.groupBy("method").agg(F.count("*").alias("metrics"), F.max(F.when(F.col("metric") == primary, F.col("mean"))).alias("primary_mean"), F.collect_set(F.when(F.col("metric").isin(*required), F.col("metric"))).alias("has"))  # a few metrics
    lacks = per.select("method", F.array_except(F.array(*map(F.lit, required)), "has").alias("lacks")).filter(F.size("lacks") > 0)
    if runs is not None:
        lacks = lacks.unionByName(runs.select("method").distinct().join(per, "method", "left_anti").withColumn("lacks", F.array(F.lit("its report"))))
    if faults := lacks.orderBy("method").limit(20).collect():
        raise ValueError("; ".join(f"{r['method']} lacks {', '.join(r['lacks'])}" for r in faults))
    return per.drop("has")


def comparison_summary(values: DataFrame, primary: str = "Regret@5") -> DataFrame:
    """Means over common fronts with the tests of the primary metric: the final comparison, and likewise ablations and baselines."""
    tests = rank_tests(values.filter(F.col("metric") == primary)).select("method", "z", "friedman", "p_holm", "significant")
    return comparison(values).join(tests, "method", "left")


def comparison(values: DataFrame) -> DataFrame:
    """Over fronts that all methods share: mean, std (0 for one front), fronts, mean rank."""
    ranked = method_ranks(paired(values))
    return ranked.groupBy("metric", "method").agg(exact_mean("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n_fronts"), F.avg("rank").alias("mean_rank"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """nulls, distinct, min, max, mean, population std and zero share of numeric columns, in one aggregate."""
    fields = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), (F.count_if(F.col(c) == 0) / F.count("*")).alias("zeros"))
        for c in columns
    ]
    return df.agg(F.array(*fields).alias("x")).select(F.explode("x").alias("x")).select("x.*").withColumn("constant", F.col("n_distinct") <= 1)


def front_profile(df: DataFrame) -> DataFrame:
    """n_items, target min, max, mean, std, range, distinct and best item of each front."""
    stats = df.groupBy("front_id").agg(
        F.count("*").alias("n_items"), F.min("target").alias("low"), F.max("target").alias("high"), exact_mean("target").alias("mean"), F.stddev_pop("target").alias("std"), F.count_distinct("target").alias("n_distinct"), F.max_by("item_id", F.struct(F.col("target"), -F.col("item_id"))).alias("best_item")
    )
    return stats.withColumn("range", F.col("high") - F.col("low"))


