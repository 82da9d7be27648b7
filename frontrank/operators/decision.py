"""Multi-criteria decision rules: every rule scores each candidate, larger is better.

Objectives become badness in [0, 1] inside each front (0 best); rules are expressions over badness columns, so all rules
of a case are one pass. Weights are equal unless given, and sum to 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import RHO, average_rank, clamp, ratio
from frontrank.operators.labels import FRONT, ITEM

MINIMIZE, MAXIMIZE = "minimize", "maximize"
AGGREGATES = ("weighted_sum", "ideal_l2", "tchebycheff", "augmented_tchebycheff", "topsis", "vikor", "mean_rank")


def checked_weights(objectives: Sequence[str], weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights of all objectives, made to sum to 1; negative, missing or unknown ones are errors."""
    if weights is None:
        return {o: 1.0 / len(objectives) for o in objectives}
    if set(weights) != set(objectives) or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative, for just the objectives, and not all 0")
    return {o: weights[o] / sum(weights.values()) for o in objectives}


def directed(column: str, way: str) -> Column:
    """A single objective as a score."""
    return -F.col(column) if way == MINIMIZE else F.col(column)


def bad(o: str) -> str:
    return f"bad_{o}"


def with_badness(df: DataFrame, objectives: Mapping[str, str]) -> DataFrame:
    """bad_<objective> by min-max inside the front and by direction; a constant front gives 0."""
    front = Window.partitionBy(FRONT)
    made = {}
    for o, way in objectives.items():
        low, high = F.min(o).over(front), F.max(o).over(front)
        part = F.col(o) - low if way == MINIMIZE else high - F.col(o)
        made[bad(o)] = F.coalesce(ratio(part, high - low), F.lit(0.0))
    return df.withColumns(made)


def badness_faults(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """For each objective how many values are missing or outside [0, 1] by more than 1e-12."""
    counts = [F.count_if(F.col(bad(o)).isNull() | (F.col(bad(o)) < -1e-12) | (F.col(bad(o)) > 1 + 1e-12)).alias(o) for o in objectives]
    return df.agg(*counts).unpivot([], list(objectives), "objective", "faults")


def clipped(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    return df.withColumns({bad(o): clamp(F.col(bad(o)), 0.0, 1.0) for o in objectives})


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(add, parts)


def _most(parts: Sequence[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def weighted_sum(w: Mapping[str, float]) -> Column:
    return _sum([F.lit(x) * (1 - F.col(bad(o))) for o, x in w.items()])


def ideal_l2(w: Mapping[str, float]) -> Column:
    return -F.sqrt(_sum([F.lit(x) * F.col(bad(o)) * F.col(bad(o)) for o, x in w.items()]))


def tchebycheff(w: Mapping[str, float]) -> Column:
    return -_most([F.col(bad(o)) for o in w])


def augmented_tchebycheff(w: Mapping[str, float], rho: float = RHO) -> Column:
    parts = [F.lit(x) * F.col(bad(o)) for o, x in w.items()]
    return -(_most(parts) + rho * _sum(parts))


def topsis(w: Mapping[str, float]) -> Column:
    """Distance from the worst over the sum of distances from the worst and the best; the ideals are fixed at 1 and 0."""
    good = {o: 1 - F.col(bad(o)) for o in w}
    to_best = F.sqrt(_sum([F.pow(F.lit(x) * (1 - good[o]), F.lit(2)) for o, x in w.items()]))
    to_worst = F.sqrt(_sum([F.pow(F.lit(x) * good[o], F.lit(2)) for o, x in w.items()]))
    return to_worst / (to_best + to_worst)


def mean_rank(objectives: Mapping[str, str]) -> Column:
    """Mean of the average ranks by each objective, negated."""
    ranks = [average_rank([FRONT], F.asc(o) if way == MINIMIZE else F.desc(o), [o]) for o, way in objectives.items()]
    return -_sum(ranks) / len(ranks)


def with_vikor(df: DataFrame, objectives: Sequence[str], v: float = 0.5, name: str = "vikor") -> DataFrame:
    """-Q per front. Objectives that are constant in the front drop out and the rest share the weight equally."""
    front = Window.partitionBy(FRONT)

    def apart(high: Column, low: Column) -> Column:
        return F.abs(high - low) > 1e-8 + 1e-5 * F.abs(low)

    varies = {o: apart(F.max(bad(o)).over(front), F.min(bad(o)).over(front)).cast("int") for o in objectives}
    df = df.withColumns({f"__v_{o}": c for o, c in varies.items()})
    n = _sum([F.col(f"__v_{o}") for o in objectives])

    def share(o: str) -> Column:
        low, high = F.min(bad(o)).over(front), F.max(bad(o)).over(front)
        regret = F.coalesce(ratio(F.col(bad(o)) - low, high - low), F.lit(0.0))
        return F.when(F.col(f"__v_{o}") == 1, regret / n).otherwise(0.0)

    df = df.withColumns({"__s": _sum([share(o) for o in objectives]), "__r": _most([share(o) for o in objectives])})

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(front), F.max(c).over(front)
        return F.when(apart(high, low), (F.col(c) - low) / (high - low)).otherwise(0.0)

    q = F.lit(v) * scaled("__s") + F.lit(1 - v) * scaled("__r")
    return df.withColumn(name, -q).drop("__s", "__r", *[f"__v_{o}" for o in objectives])


def with_rules(df: DataFrame, objectives: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """A score column for each objective and each rule in AGGREGATES."""
    w = checked_weights(list(objectives), weights)
    df = with_badness(df, objectives) if bad(next(iter(objectives))) not in df.columns else df
    made = {f"single_{o}": directed(o, way) for o, way in objectives.items()}
    made |= {"weighted_sum": weighted_sum(w), "ideal_l2": ideal_l2(w), "tchebycheff": tchebycheff(w)}
    made |= {"augmented_tchebycheff": augmented_tchebycheff(w), "topsis": topsis(w), "mean_rank": mean_rank(objectives)}
    return with_vikor(df.withColumns(made), list(objectives))


def rule_names(objectives: Mapping[str, str]) -> list[str]:
    return [f"single_{o}" for o in objectives] + list(AGGREGATES)


def score_rule(df: DataFrame, rule: str, objectives: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """df with the column `score` of one rule."""
    if rule not in rule_names(objectives):
        raise ValueError(f"unknown rule {rule}; one of {rule_names(objectives)}")
    return with_rules(df, objectives, weights).withColumn("score", F.col(rule))


def rule_scores(df: DataFrame, objectives: Mapping[str, str], keep: Sequence[str] = ("target",)) -> DataFrame:
    """Long form (front, item, keep, rule, score) of all rules from one pass."""
    wide = with_rules(df, objectives)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in rule_names(objectives)])  # explode keeps the exchange by front, unpivot wouldn't
    return wide.select(FRONT, ITEM, *keep, F.explode(each).alias("x")).select(FRONT, ITEM, *keep, "x.rule", "x.score")


def best_candidates(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """The best item of each front under each rule; of scores that are equal (to so many digits) the smallest item."""
    by = F.col("score") if digits is None else F.round("score", digits)
    return scores.groupBy(FRONT, "rule").agg(F.max_by(F.struct(ITEM, "score"), F.struct(by, -F.col(ITEM))).alias("b")).select(FRONT, "rule", "b.*")


def best_values(df: DataFrame, objectives: Mapping[str, str], value: str, digits: int) -> DataFrame:
    """(front, rule, value): a value of the best item of each front under each rule, ties as in best_candidates.

    Rules stay columns until a front is one row, so items are neither repeated for each rule nor shuffled again.
    """
    best = {r: F.max_by(value, F.struct(F.round(r, digits).alias("by"), (-F.col(ITEM)).alias("first"))).alias(r) for r in rule_names(objectives)}
    wide = with_rules(df, objectives).groupBy(FRONT).agg(*best.values())
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias(value)) for r in best])
    return wide.select(FRONT, F.explode(each).alias("x")).select(FRONT, "x.*")


def case_faults(df: DataFrame, case: str, objectives: Sequence[str], weights: Sequence[str] = ()) -> DataFrame:
    """(case, fault): cases of more than one front, and those that miss values of an objective or weight."""
    per = df.groupBy(case).agg(F.count_distinct(FRONT).alias("fronts"), *[F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in (*objectives, *weights)])
    missing = [F.when(F.col(f"__{c}") > 0, F.concat(F.lit("no "), F.lit(c))) for c in (*objectives, *weights)]
    return per.select(case, F.explode(F.array_compact(F.array(F.when(F.col("fronts") > 1, "several fronts"), *missing))).alias("fault"))


def selectable(candidates: DataFrame, reports: DataFrame, key: str, value: str) -> DataFrame:
    """(key, selectable, reason): a candidate needs a report and a value that is there and not negative."""
    has = reports.select(key).distinct().withColumn("__has", F.lit(True))
    reason = F.when(F.col("__has").isNull(), "no report").when(F.col(value).isNull() | (F.col(value) < 0), "negative").otherwise("ok")
    return candidates.join(has, key, "left").select(key, (reason == "ok").alias("selectable"), reason.alias("reason"))


def direction_faults(objectives: DataFrame, columns: DataFrame) -> DataFrame:
    """Objectives (objective, direction) that name no column or no known direction. columns: (column)."""
    missing = objectives.join(columns, objectives["objective"] == columns["column"], "left_anti").select("objective", F.lit("no such column").alias("fault"))
    odd = objectives.filter(~F.col("direction").isin(MINIMIZE, MAXIMIZE) | F.col("direction").isNull()).select("objective", F.lit("unknown direction").alias("fault"))
    return missing.unionByName(odd)
