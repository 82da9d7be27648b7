"""Queries on labels, ranks, ranking metrics and decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from frontrank.functions import exact_mean, half_up
from frontrank.operators import decision as D
from frontrank.operators import labels as L
from frontrank.operators import metrics as M
from frontrank.plans import fixtures as X
from frontrank.plans.registry import half_sql, mean_sql, query, r6

KEYS = ["front_id", "item_id"]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- labels and ranks


@query("w1_rank_in_front", _with(X.FRONTS) + """
SELECT front_id, item_id, row_number() OVER (PARTITION BY front_id ORDER BY score DESC,
md5('42|' || front_id || '|' || item_id), item_id) AS rank_in_front FROM fronts""")
def w1(spark, d):
    return L.rank_in_front(X.fronts(spark, d), hashed="md5").select(*KEYS, "rank_in_front")


@query("p31_tie_hash")
def p31(spark, d):
    return L.rank_in_front(X.fronts(spark, d)).select(*KEYS, "rank_in_front")


@query("w1_repeated_items", _with(X.FRONTS) + """
SELECT front_id, quantity::BIGINT AS item_id, count(*) AS count FROM fronts GROUP BY 1, 2 HAVING count(*) > 1""")
def w1r(spark, d):
    return L.repeated_items(X.fronts(spark, d).withColumn("item_id", F.col("quantity").cast("long")))


_CONT = "coalesce((target - min(target) OVER w) / nullif(max(target) OVER w - min(target) OVER w, 0), 0)"
_LABELS = {
    "w2_rank_dense": "count(target) OVER w - dense_rank() OVER (PARTITION BY front_id ORDER BY target DESC)",
    "w3_rank_avg": "round_even(count(target) OVER w - (rank() OVER (PARTITION BY front_id ORDER BY target DESC) + (count(*) OVER (PARTITION BY front_id, target) - 1) / 2.0), 0)::BIGINT",
    "w5_continuous": f"round({_CONT}, 6)",
    "w6_reversed": f"round(1 - {_CONT}, 6)",
}
for _name, _sql in _LABELS.items():

    @query(_name, _with(X.FRONTS) + f"SELECT front_id, item_id, {_sql} AS label FROM fronts WINDOW w AS (PARTITION BY front_id)")
    def _label(spark, d, mode=_name[3:]):
        return r6(L.build_labels(X.fronts(spark, d), mode).select(*KEYS, "label"))


_EDGES = """sorted AS (SELECT front_id, list(target ORDER BY target) AS v, least(10, count(DISTINCT target)) AS q FROM fronts GROUP BY 1),
edges AS (SELECT front_id, list_distinct(list_transform(range(0, q + 1), lambda i:
v[floor(i * (len(v) - 1) / q)::INT + 1] + (v[least(floor(i * (len(v) - 1) / q)::INT + 2, len(v))] - v[floor(i * (len(v) - 1) / q)::INT + 1])
* (i * (len(v) - 1) / q - floor(i * (len(v) - 1) / q)))) AS edges FROM sorted)"""


@query("w4_quantiles", _with(X.FRONTS, _EDGES) + """
SELECT front_id, item_id, greatest(len(list_filter(edges, lambda e: e < target)) - 1, 0) AS label FROM fronts JOIN edges USING (front_id)""")
def w4(spark, d):
    return L.build_labels(X.fronts(spark, d), "quantiles").select(*KEYS, F.col("label").cast("long").alias("label"))


@query("w7_shuffled", _with(X.FRONTS) + f"""
, c AS (SELECT front_id, {_CONT} AS label FROM fronts WINDOW w AS (PARTITION BY front_id))
SELECT front_id, count(*) AS n, round(sum(label), 6) AS total, round(max(label), 6) AS most FROM c GROUP BY 1""")
def w7(spark, d):
    shuffled = L.build_labels(X.fronts(spark, d), "shuffled")
    return r6(shuffled.groupBy("front_id").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.max("label").alias("most")))


@query("w8_label_modes", _with(X.FRONTS) + f"""
, c AS (SELECT front_id, {_CONT} AS a FROM fronts WINDOW w AS (PARTITION BY front_id))
SELECT 'continuous' AS mode, count(*) AS n, round(avg(a), 6) AS mean FROM c UNION ALL SELECT 'reversed', count(*), round(avg(1 - a), 6) FROM c""")
def w8(spark, d):
    f = X.fronts(spark, d)
    parts = [L.build_labels(f, m).select(F.lit(m).alias("mode"), F.col("label").cast("double").alias("label")) for m in ("continuous", "reversed")]
    return r6(parts[0].unionByName(parts[1]).groupBy("mode").agg(F.count("*").alias("n"), F.avg("label").alias("mean")))


@query("p35_integer_gains", _with(X.FRONTS) + f"""
, c AS (SELECT front_id, item_id, {_CONT} AS label FROM fronts WINDOW w AS (PARTITION BY front_id))
SELECT front_id, item_id, floor(least(greatest(label, 0), 1) * 255)::INT AS gain FROM c""")
def p35(spark, d):
    return L.integer_gains(L.build_labels(X.fronts(spark, d), "continuous")).select(*KEYS, "gain")


@query("w10_method_ranks", _with(X.FRONTS) + """
SELECT front_id, item_id, rank() OVER (PARTITION BY front_id ORDER BY discount DESC) + (count(*) OVER (PARTITION BY front_id, discount) - 1) / 2.0 AS avg_rank FROM fronts""")
def w10(spark, d):
    from frontrank.functions import average_rank

    return X.fronts(spark, d).select(*KEYS, average_rank(["front_id"], F.desc("discount"), ["discount"]).alias("avg_rank"))


@query("w19_group_sizes", _with(X.FRONTS) + "SELECT front_id, count(*) AS n_items FROM fronts GROUP BY 1")
def w19(spark, d):
    return L.group_sizes(L.contiguous(X.fronts(spark, d)))


@query("n19_position_ids", """SELECT l_partkey AS front_id, l_orderkey, l_linenumber, l_suppkey,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS item_id FROM lineitem""")
def n19(spark, d):
    rows = X.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "front_id")
    made = L.position_ids(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return made.select("front_id", "l_orderkey", "l_linenumber", "l_suppkey", F.col("item_id").cast("long").alias("item_id"))


@query("j18_item_pairs", _with(X.FRONTS) + """
SELECT a.front_id, count(*) AS pairs, sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END)::BIGINT AS tied
FROM fronts a JOIN fronts b ON a.front_id = b.front_id AND a.item_id < b.item_id GROUP BY 1""")
def j18(spark, d):
    return L.pair_counts(X.fronts(spark, d), "score")


# ---- metrics: oracles follow the order statistics of tie blocks, spelled out over lists

_BLOCKS = """base AS (SELECT front_id, score, target, count(*) OVER f AS n, max(target) OVER f AS best,
rank() OVER (PARTITION BY front_id ORDER BY score DESC) - 1 AS start, count(*) OVER b AS b,
row_number() OVER (PARTITION BY front_id, score ORDER BY target) AS j,
sum(CASE WHEN abs(target - m) <= 1e-8 + 1e-5 * abs(m) THEN 1 ELSE 0 END) OVER b AS bests
FROM (SELECT *, max(target) OVER (PARTITION BY front_id) AS m FROM fronts)
WINDOW f AS (PARTITION BY front_id), b AS (PARTITION BY front_id, score)),
blocks AS (SELECT *, least(k - start, b) AS r FROM base, (VALUES (1), (3), (5), (10)) t(k) WHERE k <= n AND start < k),
floored AS (SELECT *, max(CASE WHEN r = b THEN target END) OVER (PARTITION BY front_id, k) AS base_v FROM blocks),
shares AS (SELECT *, CASE WHEN r = b THEN NULL ELSE greatest(target, coalesce(base_v, target)) *
(CASE WHEN j < r THEN 0 ELSE coalesce(list_product(list_transform(range(0, r), lambda i: (j - i) / (b - i)::DOUBLE)), 1) END
- CASE WHEN j - 1 < r THEN 0 ELSE coalesce(list_product(list_transform(range(0, r), lambda i: (j - 1 - i) / (b - i)::DOUBLE)), 1) END) END AS part,
CASE WHEN r = b THEN CASE WHEN bests > 0 THEN 0 ELSE 1 END WHEN b - bests < r THEN 0
ELSE coalesce(list_product(list_transform(range(0, r), lambda i: (b - bests - i) / (b - i)::DOUBLE)), 1) END AS missed FROM floored),
topk AS (SELECT front_id, k, coalesce(sum(part), max(base_v)) AS best_target, 1 - min(missed) AS hit, max(best) AS best FROM shares GROUP BY 1, 2)"""

_TOPK = {
    "m1_best_target": "round(best_target, 6) AS best_target",
    "m3_hit": "round(hit, 6) AS hit",
    "m4_regret": "round(greatest(best - best_target, 0), 6) AS regret",
    "m5_top_k": "round(best_target, 6) AS best_target, round(hit, 6) AS hit, round(greatest(best - best_target, 0), 6) AS regret",
}
for _name, _sql in _TOPK.items():

    @query(_name, _with(X.FRONTS, _BLOCKS) + f"SELECT front_id, k, {_sql} FROM topk")
    def _topk(spark, d, columns=tuple(p.rsplit(" AS ", 1)[1] for p in _sql.split(", round"))):
        return r6(M.top_k(X.fronts(spark, d)).select("front_id", "k", *columns))


@query("m2_cutoff_block", _with(X.FRONTS, _BLOCKS) + "SELECT front_id, k, round(sum(part), 6) AS expected, max(r)::BIGINT AS taken FROM shares WHERE r < b GROUP BY 1, 2")
def m2(spark, d):
    from frontrank.functions import comb_ratio

    blocks = M.tie_blocks(X.fronts(spark, d))
    floor = F.max(F.when(F.col("r") == F.col("b"), F.col("target"))).over(L.Window.partitionBy("front_id", "k"))
    share = comb_ratio(F.col("j"), F.col("r"), F.col("b")) - comb_ratio(F.col("j") - 1, F.col("r"), F.col("b"))
    cut = blocks.withColumn("floor", floor).filter("r < b").withColumn("part", F.greatest("target", F.coalesce("floor", "target")) * share)
    return r6(cut.groupBy("front_id", "k").agg(F.sum("part").alias("expected"), F.max("r").cast("long").alias("taken")))


@query("p30_comb_ratio", _with(X.FRONTS, "s AS (SELECT front_id, count(*) AS n, count(*) FILTER (score > 0.5) AS a FROM fronts GROUP BY 1)") + """
SELECT front_id, round(CASE WHEN a < 5 THEN 0 ELSE list_product(list_transform(range(0, 5), lambda i: (a - i) / (n - i)::DOUBLE)) END, 6) AS ratio FROM s""")
def p30(spark, d):
    from frontrank.functions import comb_ratio

    s = X.fronts(spark, d).groupBy("front_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.5).alias("a"))
    return r6(s.select("front_id", comb_ratio(F.col("a"), F.lit(5), F.col("n")).alias("ratio")))


_NDCG = """placed AS (SELECT front_id, target, count(*) OVER f AS n, avg(target) OVER (PARTITION BY front_id, score) AS gain,
row_number() OVER (PARTITION BY front_id ORDER BY score DESC, target DESC) AS pos,
row_number() OVER (PARTITION BY front_id ORDER BY target DESC) AS ideal FROM fronts WINDOW f AS (PARTITION BY front_id)),
ndcg AS (SELECT front_id, k, sum(CASE WHEN pos <= k THEN gain / log2(pos + 1) ELSE 0 END) /
nullif(sum(CASE WHEN ideal <= k THEN target / log2(ideal + 1) ELSE 0 END), 0) AS ndcg
FROM placed, (VALUES (1), (3), (5), (10)) t(k) WHERE k <= n AND n > 1 GROUP BY 1, 2)"""
_RANKS = """ranked AS (SELECT front_id, rank() OVER (PARTITION BY front_id ORDER BY score) + (count(*) OVER (PARTITION BY front_id, score) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY front_id ORDER BY target) + (count(*) OVER (PARTITION BY front_id, target) - 1) / 2.0 AS y FROM fronts),
spearman AS (SELECT front_id, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) AS spearman FROM ranked GROUP BY 1)"""


@query("m6_ndcg", _with(X.FRONTS, _NDCG) + "SELECT front_id, k, round(coalesce(ndcg, 0), 6) AS ndcg FROM ndcg")
def m6(spark, d):
    return r6(M.ndcg(X.fronts(spark, d)))


@query("m7_spearman", _with(X.FRONTS, _RANKS) + "SELECT front_id, round(spearman, 6) AS spearman FROM spearman")
def m7(spark, d):
    return r6(M.spearman(X.fronts(spark, d)))


@query("m8_kendall", _with(X.FRONTS) + """
, p AS (SELECT a.front_id, sign(a.score - b.score) AS x, sign(a.target - b.target) AS y FROM fronts a JOIN fronts b ON a.front_id = b.front_id AND a.item_id < b.item_id)
SELECT front_id, round(coalesce(sum(x * y) / nullif(sqrt(count(*) FILTER (x <> 0) * (count(*) FILTER (y <> 0))::DOUBLE), 0), 0), 6) AS kendall FROM p GROUP BY 1""")
def m8(spark, d):
    return r6(M.kendall(X.fronts(spark, d)))


_LONG = """long AS (SELECT front_id, 'Regret@' || k AS metric, greatest(best - best_target, 0) AS value FROM topk
UNION ALL SELECT front_id, 'BestTarget@' || k, best_target FROM topk UNION ALL SELECT front_id, 'Hit@' || k, hit FROM topk
UNION ALL SELECT front_id, 'NDCG@' || k, coalesce(ndcg, 0) FROM ndcg UNION ALL SELECT front_id, 'Spearman', spearman FROM spearman)"""
_ALL = (X.FRONTS, _BLOCKS, _NDCG, _RANKS, _LONG)


@query("m9_front_metrics", _with(*_ALL) + "SELECT front_id, metric, round(value, 6) AS value FROM long")
def m9(spark, d):
    return r6(M.long_metrics(X.fronts(spark, d)))


@query("m10_front_mean", _with(*_ALL) + "SELECT metric, " + half_sql(mean_sql("value"), 6) + " AS value, count(value) AS n_fronts FROM long GROUP BY 1")
def m10(spark, d):
    return M.front_mean(M.long_metrics(X.fronts(spark, d))).withColumn("value", half_up("value", 6))


@query("m11_evaluate", _with(*_ALL) + "SELECT metric, " + half_sql(mean_sql("value"), 6) + " AS value, count(value) AS n_fronts FROM long WHERE metric LIKE '%@5' OR metric = 'Spearman' GROUP BY 1")
def m11(spark, d):
    return M.evaluate(X.fronts(spark, d), ks=(5,)).withColumn("value", half_up("value", 6))


# ---- decision rules

_W = "WINDOW w AS (PARTITION BY front_id)"


def _bad(o: str, way: str) -> str:
    part = f"{o} - min({o}) OVER w" if way == "minimize" else f"max({o}) OVER w - {o}"
    return f"coalesce(({part}) / nullif(max({o}) OVER w - min({o}) OVER w, 0), 0) AS bad_{o}"


_BAD = "bad AS (SELECT *, " + ", ".join(_bad(o, w) for o, w in X.OBJECTIVES.items()) + f" FROM fronts {_W})"
_OS = list(X.OBJECTIVES)
_BS = [f"bad_{o}" for o in _OS]
_VIKOR = "varying AS (SELECT *, " + ", ".join(f"(abs(max({b}) OVER w - min({b}) OVER w) > 1e-8 + 1e-5 * abs(min({b}) OVER w))::INT AS v_{b}" for b in _BS) + f" FROM bad {_W}),\n"
_VIKOR += "parts AS (SELECT *, " + ", ".join(f"CASE WHEN v_{b} = 1 THEN coalesce(({b} - min({b}) OVER w) / nullif(max({b}) OVER w - min({b}) OVER w, 0), 0) / ({' + '.join(f'v_{x}' for x in _BS)}) ELSE 0 END AS p_{b}" for b in _BS) + f" FROM varying {_W}),\n"
_VIKOR += f"sr AS (SELECT *, {' + '.join(f'p_{b}' for b in _BS)} AS s, greatest({', '.join(f'p_{b}' for b in _BS)}) AS r FROM parts),\n"
_SCALED = "CASE WHEN abs(max({0}) OVER w - min({0}) OVER w) > 1e-8 + 1e-5 * abs(min({0}) OVER w) THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END"
_VIKOR += f"vikor AS (SELECT *, -(0.5 * {_SCALED.format('s')} + 0.5 * {_SCALED.format('r')}) AS vikor FROM sr {_W})"
_AVG = "(rank() OVER (PARTITION BY front_id ORDER BY {0} {1}) + (count(*) OVER (PARTITION BY front_id, {0}) - 1) / 2.0)"
_RULE = {f"single_{o}": ("-" if w == "minimize" else "") + o for o, w in X.OBJECTIVES.items()} | {
    "weighted_sum": " + ".join(f"0.25 * (1 - {b})" for b in _BS),
    "ideal_l2": f"-sqrt({' + '.join(f'0.25 * {b} * {b}' for b in _BS)})",
    "tchebycheff": f"-greatest({', '.join(_BS)})",
    "augmented_tchebycheff": f"-(greatest({', '.join(f'0.25 * {b}' for b in _BS)}) + 1e-6 * ({' + '.join(f'0.25 * {b}' for b in _BS)}))",
    "topsis": "sqrt(" + " + ".join(f"pow(0.25 * (1 - {b}), 2)" for b in _BS) + ") / (sqrt(" + " + ".join(f"pow(0.25 * {b}, 2)" for b in _BS) + ") + sqrt(" + " + ".join(f"pow(0.25 * (1 - {b}), 2)" for b in _BS) + "))",
    "vikor": "vikor",
    "mean_rank": "-(" + " + ".join(_AVG.format(o, "" if w == "minimize" else "DESC") for o, w in X.OBJECTIVES.items()) + ") / 4",
}
_RULES = _VIKOR + ",\nrules AS (SELECT front_id, item_id, target, " + ", ".join(f"{s} AS {n}" for n, s in _RULE.items()) + " FROM vikor)"
_UNPIVOT = f"scores AS (UNPIVOT rules ON {', '.join(_RULE)} INTO NAME rule VALUE score)"
_SCORES = (X.FRONTS, _BAD, _RULES, _UNPIVOT)


@query("d1_badness", _with(X.FRONTS, _BAD) + "SELECT front_id, item_id, " + ", ".join(f"round({b}, 6) AS {b}" for b in _BS) + " FROM bad")
def d1(spark, d):
    return r6(D.with_badness(X.fronts(spark, d), X.OBJECTIVES).select(*KEYS, *_BS))


@query("w9_badness_checked", _with(X.FRONTS, _BAD) + " UNION ALL ".join(f"SELECT '{o}' AS objective, count(*) FILTER (bad_{o} IS NULL OR bad_{o} < -1e-12 OR bad_{o} > 1 + 1e-12) AS faults FROM bad" for o in _OS))
def w9(spark, d):
    return D.badness_faults(D.with_badness(X.fronts(spark, d), X.OBJECTIVES), _OS)


@query("p27_clipped_badness", _with(X.FRONTS, _BAD) + "SELECT front_id, item_id, " + ", ".join(f"round(least(greatest({b}, 0), 1), 6) AS {b}" for b in _BS) + " FROM bad")
def p27(spark, d):
    return r6(D.clipped(D.with_badness(X.fronts(spark, d), X.OBJECTIVES), _OS).select(*KEYS, *_BS))


for _id, _rule in {"d2": "weighted_sum", "d3": "ideal_l2", "d4": "augmented_tchebycheff", "d5": "topsis", "d6": "vikor", "d8": "tchebycheff", "d9": "single_price", "d10": "mean_rank"}.items():

    @query(f"{_id}_{_rule}", _with(X.FRONTS, _BAD, _RULES) + f"SELECT front_id, item_id, round({_rule}, 6) AS score FROM rules")
    def _one(spark, d, rule=_rule):
        return r6(D.score_rule(X.fronts(spark, d), rule, X.OBJECTIVES).select(*KEYS, "score"))


@query("d7_vikor_fronts", _with(X.FRONTS, _BAD, _VIKOR) + "SELECT front_id, round(max(vikor), 6) AS best, round(min(vikor), 6) AS worst FROM vikor GROUP BY 1")
def d7(spark, d):
    f = D.with_vikor(D.with_badness(X.fronts(spark, d), X.OBJECTIVES), _OS)
    return r6(f.groupBy("front_id").agg(F.max("vikor").alias("best"), F.min("vikor").alias("worst")))


@query("d11_score_rule", _with(X.FRONTS, _BAD, _RULES) + "SELECT front_id, item_id, round(topsis, 6) AS score FROM rules")
def d11(spark, d):
    return r6(D.score_rule(X.fronts(spark, d), "topsis", X.OBJECTIVES).select(*KEYS, "score"))


@query("d12_rule_scores", _with(*_SCORES) + "SELECT rule, count(*) AS n, " + half_sql(mean_sql("score"), 6) + " AS mean, round(max(score), 6) AS most FROM scores GROUP BY 1")
def d12(spark, d):
    scores = D.rule_scores(X.fronts(spark, d), X.OBJECTIVES)
    return scores.groupBy("rule").agg(F.count("*").alias("n"), half_up(exact_mean("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("most"))


_RULE_FRONTS = "fronts_of AS (SELECT rule || ':' || front_id AS front_id, rule, front_id AS own, item_id, target, round(score, 9) AS score FROM scores)"
_RULE_BLOCKS = _BLOCKS.replace("FROM fronts)", "FROM fronts_of)")
_BY_RULE = (*_SCORES, _RULE_FRONTS, _RULE_BLOCKS)


def rule_metrics(spark, d, ks=(1, 3, 5, 10), parts=None):
    """Long metrics (rule, front, metric, value) of every rule on every front, in one plan that shuffles line items only."""
    scores = D.rule_scores(X.fronts(spark, d, parts or X.tasks(spark, d)), X.OBJECTIVES).withColumn("score", F.round("score", 9))
    top = M.top_k(scores, ks, over=["rule"])
    three = F.array(*[F.struct(F.concat(F.lit(f"{n}@"), F.col("k").cast("string")).alias("metric"), F.col(c).alias("value")) for n, c in (("Regret", "regret"), ("BestTarget", "best_target"), ("Hit", "hit"))])
    return top.select("rule", "front_id", F.explode(three).alias("m")).select("rule", "front_id", "m.metric", "m.value")


RULE_METRICS = (*_BY_RULE, """methods AS (SELECT split_part(front_id, ':', 1) AS rule, split_part(front_id, ':', 2)::BIGINT AS front_id, metric, value FROM (
SELECT front_id, 'Regret@' || k AS metric, greatest(best - best_target, 0) AS value FROM topk UNION ALL SELECT front_id, 'BestTarget@' || k, best_target FROM topk
UNION ALL SELECT front_id, 'Hit@' || k, hit FROM topk))""")


@query("d13_rules_evaluated", _with(*RULE_METRICS) + "SELECT rule, metric, " + half_sql(mean_sql("value"), 5) + " AS value, count(*) AS n_fronts FROM methods GROUP BY 1, 2")
def d13(spark, d):
    return rule_metrics(spark, d).groupBy("rule", "metric").agg(half_up(exact_mean("value"), 5).alias("value"), F.count("*").alias("n_fronts"))


@query("d14_selected_by_rule", _with(*_SCORES) + """, b AS (SELECT rule, target FROM scores QUALIFY row_number() OVER (PARTITION BY front_id, rule ORDER BY round(score, 9) DESC, item_id) = 1)
SELECT rule, count(*) AS n_fronts, """ + half_sql(mean_sql("target"), 5) + " AS mean_target FROM b GROUP BY 1")
def d14(spark, d):
    best = D.best_values(X.fronts(spark, d, X.tasks(spark, d)), X.OBJECTIVES, "target", 9)
    return best.groupBy("rule").agg(F.count("*").alias("n_fronts"), half_up(exact_mean("target"), 5).alias("mean_target"))


@query("t1_best_candidates", _with(*_SCORES) + """
SELECT front_id, rule, item_id, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY front_id, rule ORDER BY round(score, 9) DESC, item_id) = 1""")
def t1(spark, d):
    scores = D.rule_scores(X.fronts(spark, d), X.OBJECTIVES, keep=())
    return r6(D.best_candidates(scores, digits=9))


@query("p25_directed_objective", _with(X.FRONTS) + "SELECT front_id, item_id, -price AS price, discount FROM fronts")
def p25(spark, d):
    return X.fronts(spark, d).select(*KEYS, D.directed("price", "minimize").alias("price"), D.directed("discount", "maximize").alias("discount"))


def flagship(spark, sf_dir):
    """Mean regret and hit rate of TOPSIS over all fronts."""
    ranked = D.score_rule(X.fronts(spark, sf_dir), "topsis", X.OBJECTIVES)
    return r6(M.evaluate(ranked))
