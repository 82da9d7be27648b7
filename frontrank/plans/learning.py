"""Queries on learning to rank and figure tables. Learned scores have no SQL; tests check their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frontrank.functions import exact_mean, half_up
from frontrank.operators import decision as D
from frontrank.operators import figures as G
from frontrank.operators import labels as L
from frontrank.operators import ltr as R
from frontrank.operators import metrics as M
from frontrank.operators import stats as S
from frontrank.plans import fixtures as X
from frontrank.plans.comparing import _METHODS, _SUMMARY, _summaries, values
from frontrank.plans.profiling import splits
from frontrank.plans.ranking import _with
from frontrank.plans.registry import half_sql, mean_sql, query, r6
from frontrank.sources.tables import bucketed, exists, fresh_path

ORDER = ["price", "discount", "tax", "quantity"]
SCREENED = (*L.MODES, "quantiles5", "quantiles15")


def rows(spark, d):
    """Items with their features, as a table by front: labels, ranks, fits and metrics shuffle no items."""
    parts = X.tasks(spark, d)
    return bucketed(X.fronts(spark, d, parts).select("front_id", "item_id", "target", *ORDER), "rows", "front_id", parts)


def _fitted(spark, d, kind, params=None):
    df = rows(spark, d)
    return r6(M.evaluate(R.rank_fronts(df, R.fit(L.build_labels(df, "continuous"), kind, ORDER, params))))


@query("l1_listwise")
def l1(spark, d):
    return _fitted(spark, d, "listwise")


@query("l2_pairwise")
def l2(spark, d):
    return _fitted(spark, d, "pairwise")


@query("l3_pointwise")
def l3(spark, d):
    return _fitted(spark, d, "pointwise")


@query("l3_sampled_pairs")
def l3_sampled(spark, d):
    return r6(M.evaluate(R.ranked_by(rows(spark, d), ORDER, "sampled")))


@query("l5_cross_validated")
def l5(spark, d):
    return r6(M.front_mean(R.cv_metrics(R.cross_validate(rows(spark, d), "pairwise", ORDER)), ["fold"]))


@query("l6_stored_ranker")
def l6(spark, d):
    df, path = rows(spark, d), fresh_path(spark, "ranker")
    R.fit(L.build_labels(df, "continuous"), "pointwise", ORDER).save(path)
    return R.rank_fronts(df, R.load(spark, path)).select("front_id", "item_id", "rank_in_front")


@query("l7_ranked_fronts")
def l7(spark, d):
    df = rows(spark, d)
    return R.rank_fronts(df, R.fit(L.build_labels(df, "rank_dense"), "pairwise", ORDER)).select("front_id", "item_id", "rank_in_front")


_DONE: dict[tuple, DataFrame] = {}


def _once(spark, d, name, make):
    """A written table that several queries of a session share, as long as its files are there."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _DONE or not exists(_DONE[key]):
        _DONE[key] = make()
    return _DONE[key]


def screened(spark, d):
    return _once(spark, d, "screened", lambda: R.screening(rows(spark, d), ORDER, modes=SCREENED))


@query("l8_screening")
def l8(spark, d):
    return S.leaderboard(S.summary(screened(spark, d)))


#: Every run, and how many fronts have each of its metrics: what SQL can say of screening and tuning.
_COUNTED = ("m AS (SELECT metric, count(*) AS n FROM (SELECT unnest(['Regret@1', 'BestTarget@1', 'Hit@1'] || CASE WHEN n > 1 THEN ['NDCG@1'] ELSE [] END || "
    "CASE WHEN n >= 5 THEN ['Regret@5', 'BestTarget@5', 'Hit@5', 'NDCG@5'] ELSE [] END || ['Spearman']) AS metric FROM (SELECT front_id, count(*) AS n FROM fronts GROUP BY 1)) GROUP BY 1)")  # fmt: skip
_MODES = "mode AS (SELECT unnest(['rank_dense', 'rank_avg', 'quantiles', 'continuous', 'reversed', 'shuffled', 'quantiles5', 'quantiles15']) AS mode)"


@query("l8_screened_runs", f"WITH {X.FRONTS}, {_COUNTED}, {_MODES} SELECT family || '__' || mode AS method, metric, n FROM (SELECT unnest(['listwise', 'pairwise', 'sampled']) AS family), mode, m")
def l8_runs(spark, d):
    return S.summary(screened(spark, d)).select("method", "metric", "n")


def shortlist(runs):
    """The best (kind, label mode) of each family."""
    family = F.split_part(F.col("method"), F.lit("__"), F.lit(1))
    best = S.selected(S.summary(runs), S.rank_stats(runs.filter("metric = 'Regret@5'")), over=[family])
    return sorted(tuple(r["method"].split("__")) for r in best.select("method").collect())


def tuned(spark, d):
    return _once(spark, d, "tuned", lambda: R.tuning(rows(spark, d), ORDER, shortlist(screened(spark, d))))


@query("l9_tuning")
def l9(spark, d):
    return G.tuning_table(S.summary(tuned(spark, d)), [])


def _list(values):
    return f"(SELECT unnest({list(values)}) AS x)"


_TAGS = f"""tags AS (SELECT 'listwise' AS family, 'd' || a.x || '_mcs' || b.x || '_lr' || c.x AS tag FROM {_list([5, 6, 7])} a, {_list([30, 50, 100])} b, {_list(["003", "005", "01"])} c
UNION ALL SELECT 'pairwise', 'd' || a.x || '_ss' || b.x || '_mcw' || c.x || '_lr' || e.x FROM {_list([4, 6, 8])} a, {_list(["08", "10"])} b, {_list([1, 5, 10])} c, {_list(["003", "005"])} e
UNION ALL SELECT 'sampled', 'd' || a.x || '_l2' || b.x || '_lr' || c.x FROM {_list([4, 6, 8])} a, {_list([3, 5, 7, 10])} b, {_list(["003", "005", "01"])} c)"""


@query("l9_tuned_settings", f"WITH {X.FRONTS}, {_COUNTED}, {_TAGS} SELECT family, tag, metric, n FROM tags, m")
def l9_settings(spark, d):
    part = lambda i: F.split_part(F.col("method"), F.lit("__"), F.lit(i))
    return S.summary(tuned(spark, d)).select(part(1).alias("family"), part(3).alias("tag"), "metric", "n")


@query("l10_held_out")
def l10(spark, d):
    return r6(M.evaluate(R.held_out(rows(spark, d), splits(spark, d), "pairwise", ORDER)))


SETS = {"full": ORDER, "money": ["price", "tax"], "rest": ["discount", "quantity"]}


def ablated(spark, d):
    return R.ablation(rows(spark, d), splits(spark, d), SETS)


@query("l11_ablation")
def l11(spark, d):
    """Every feature set out of fold on development fronts, and held out on test fronts."""
    found = ablated(spark, d)
    both = [S.comparison(found.filter(F.col("split") == part).drop("split")).withColumn("split", F.lit(part)) for part in ("development", "test")]
    return both[0].unionByName(both[1])


@query("l12_learned_among_rules")
def l12(spark, d):
    df = rows(spark, d)
    ranked = R.rank_fronts(df, R.fit(L.build_labels(df, "continuous"), "pairwise", ORDER))
    learned = ranked.select("front_id", "item_id", "target", F.lit("learned").alias("rule"), "score")
    top = M.top_k(D.rule_scores(df, X.OBJECTIVES), (5,), over=["rule"]).unionByName(M.top_k(learned, (5,), over=["rule"]))  # apart, so that each stays by front
    return r6(top.groupBy("rule").agg(F.avg("regret").alias("regret"), F.count("*").alias("n_fronts")))


@query("l12_rules_beside_learned", _with(*_METHODS) + f"SELECT method AS rule, {half_sql(mean_sql('value'), 6)} AS regret, count(*) AS n_fronts FROM v WHERE metric = 'Regret@5' GROUP BY 1")
def l12_rules(spark, d):
    """The decision rules of that comparison."""
    df = rows(spark, d)
    both = R.with_learned(D.rule_scores(df, X.OBJECTIVES), D.score_rule(df, "topsis", X.OBJECTIVES)).withColumn("score", F.round("score", 9))  # scores that differ by noise tie
    top = M.top_k(both.filter("rule <> 'learned'"), (5,), over=["rule"]).withColumn("regret", F.round("regret", 9))
    return top.groupBy("rule").agg(half_up(exact_mean("regret"), 6).alias("regret"), F.count("*").alias("n_fronts"))


@query("f1_screening_table")
def f1(spark, d):
    return G.screening_table(S.rank_tests(values(spark, d).filter("metric = 'Regret@5'")), ["topsis"]).withColumn("avg_rank", F.round("avg_rank", 5))


_PLACE = """place AS (SELECT method, row_number() OVER (ORDER BY round(avg(rank), 7), method) AS place FROM (SELECT method, front_id,
rank() OVER (PARTITION BY front_id ORDER BY value) + (count(*) OVER (PARTITION BY front_id, value) - 1) / 2.0 AS rank FROM v WHERE metric = 'Regret@5') GROUP BY 1)"""


@query("f6_top_k_table", _with(*_METHODS, _SUMMARY, _PLACE) + "SELECT method, split_part(metric, '@', 1) AS family, split_part(metric, '@', 2)::INT AS k, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, place FROM summary LEFT JOIN place USING (method)")
def f6(spark, d):
    v = values(spark, d)
    ranks = S.rank_stats(v.filter("metric = 'Regret@5'")).withColumn("avg_rank", F.round("avg_rank", 7))
    return G.top_k_table(S.summary(v).withColumn("mean", half_up("mean", 7)), ranks).withColumn("mean", half_up("mean", 5))


@query("f7_metric_pairs", _with(*_METHODS, _SUMMARY) + "SELECT method, (floor(max(mean) FILTER (metric = 'Regret@5') * 1e5 + 0.5) / 1e5) AS x, (floor(max(mean) FILTER (metric = 'Hit@5') * 1e5 + 0.5) / 1e5) AS y FROM summary GROUP BY 1")
def f7(spark, d):
    pairs = G.metric_pairs(_summaries(spark, d), "Regret@5", "Hit@5")
    return pairs.withColumns({"x": half_up("x", 5), "y": half_up("y", 5)})
