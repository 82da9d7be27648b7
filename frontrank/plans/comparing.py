"""Queries on statistics, selection and network features."""

from __future__ import annotations

from pyspark.sql import functions as F

from frontrank.functions import half_up
from frontrank.operators import networks as N
from frontrank.operators import stats as S
from frontrank.plans import fixtures as X
from frontrank.plans.ranking import RULE_METRICS, _with, rule_metrics
from frontrank.plans.registry import half_sql, mean_sql, query, r6
from frontrank.sources.tables import bucketed, first_of

_METHODS = (*RULE_METRICS, "v AS (SELECT rule AS method, front_id, metric, round(value, 9) AS value FROM methods)")


def values(spark, d):
    """(metric, front_id, method, value): decision rules as methods. A table by front, as most operators read it more than once."""
    parts = X.tasks(spark, d)
    v = rule_metrics(spark, d, parts=parts).select(F.col("rule").alias("method"), "front_id", "metric", F.round("value", 9).alias("value"))
    return bucketed(v, "values", "front_id", parts)


_DIR = "(CASE WHEN metric LIKE 'Regret@%' THEN -1 ELSE 1 END)"
_RANKED = f"""ranked AS (SELECT *, rank() OVER (PARTITION BY metric, front_id ORDER BY value * {_DIR} DESC)
+ (count(*) OVER (PARTITION BY metric, front_id, value) - 1) / 2.0 AS rank FROM v)"""
_STATS = """ties AS (SELECT metric, sum(t * t * t - t) AS ties FROM (SELECT metric, front_id, rank, count(*) AS t FROM ranked GROUP BY ALL) GROUP BY 1),
per AS (SELECT metric, method, avg(rank) AS avg_rank, sum(rank) AS rs, count(*) AS n FROM ranked GROUP BY 1, 2),
tot AS (SELECT *, count(*) OVER (PARTITION BY metric) AS k, sum(rs * rs) OVER (PARTITION BY metric) AS sq FROM per JOIN ties USING (metric)),
stat AS (SELECT *, (12.0 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / nullif(1 - ties / (n * (k * k * k - k)::DOUBLE), 0) AS friedman,
row_number() OVER b AS position, first_value(method) OVER b AS winner,
(avg_rank - first_value(avg_rank) OVER b) / sqrt(k * (k + 1) / (6.0 * n)) AS z FROM tot WINDOW b AS (PARTITION BY metric ORDER BY avg_rank, method))"""
_ST = (*_METHODS, _RANKED, _STATS)


@query("j4_paired_fronts", _with(*_METHODS) + """, c AS (SELECT *, count(*) OVER (PARTITION BY metric, front_id) AS have FROM v)
SELECT metric, count(DISTINCT front_id) AS fronts, count(*) AS n FROM c WHERE have = 11 GROUP BY 1""")
def j4(spark, d):
    return S.paired(values(spark, d)).groupBy("metric").agg(F.count_distinct("front_id").alias("fronts"), F.count("*").alias("n"))


@query("j16_common_fronts", _with(*_METHODS) + "SELECT front_id FROM v WHERE metric = 'Regret@5' GROUP BY 1 HAVING count(DISTINCT method) = 11")
def j16(spark, d):
    return S.common(values(spark, d).filter("metric = 'Regret@5'"), "front_id")


@query("j17_common_metrics", _with(*_METHODS) + "SELECT metric FROM v GROUP BY 1 HAVING count(DISTINCT method) = 11")
def j17(spark, d):
    return S.common(values(spark, d), "metric")


@query("s3_friedman", _with(*_ST) + "SELECT DISTINCT metric, n AS n_fronts, k, round(friedman, 4) AS friedman, winner FROM stat")
def s3(spark, d):
    return S.rank_stats(values(spark, d)).select("metric", "n_fronts", "k", F.round("friedman", 4).alias("friedman"), "winner").distinct()


@query("s5_z_against_winner", _with(*_ST) + "SELECT metric, method, round(CASE WHEN position > 1 THEN z END, 5) AS z FROM stat")
def s5(spark, d):
    return S.rank_stats(values(spark, d)).select("metric", "method", F.round("z", 5).alias("z"))


@query("s6_rank_stats", _with(*_ST) + "SELECT method, round(avg_rank, 5) AS avg_rank, position FROM stat WHERE metric = 'Regret@5'")
def s6(spark, d):
    return S.rank_stats(values(spark, d).filter("metric = 'Regret@5'")).select("method", F.round("avg_rank", 5).alias("avg_rank"), "position")


@query("s7_rank_stats_all", _with(*_ST) + "SELECT metric, method, round(avg_rank, 5) AS avg_rank, position, n AS n_fronts FROM stat")
def s7(spark, d):
    return S.rank_stats(values(spark, d)).select("metric", "method", F.round("avg_rank", 5).alias("avg_rank"), "position", "n_fronts")


@query("s17_rank_tests")
def s17(spark, d):
    t = S.rank_tests(values(spark, d))
    return t.withColumns({c: F.round(c, n) for c, n in (("avg_rank", 5), ("friedman", 3), ("z", 4), ("friedman_p", 5), ("p", 5), ("p_holm", 5))})


@query("s4_holm", _with(*_METHODS) + """, p AS (SELECT metric, method, round(avg(value) / (1 + avg(value)) / 10, 9) AS p FROM v WHERE metric LIKE 'Regret@%' GROUP BY 1, 2),
s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY metric) - row_number() OVER o + 1) * p) AS step, row_number() OVER o AS i FROM p WINDOW o AS (PARTITION BY metric ORDER BY p, method))
SELECT metric, method, round(max(step) OVER (PARTITION BY metric ORDER BY i), 6) AS p_holm FROM s""")
def s4(spark, d):
    p = values(spark, d).filter("metric LIKE 'Regret@%'").groupBy("metric", "method").agg(F.avg("value").alias("m"))
    p = p.select("metric", "method", F.round(F.col("m") / (1 + F.col("m")) / 10, 9).alias("p"))
    return r6(S.holm(p, ["metric"]).select("metric", "method", "p_holm"))


@query("s1_tiers", _with(*_METHODS) + f"""SELECT metric, 'primary' AS tier, CASE split_part(metric, '@', 1) WHEN 'Regret' THEN 10 WHEN 'BestTarget' THEN 20 ELSE 30 END
+ CASE split_part(metric, '@', 2) WHEN '1' THEN 0 WHEN '3' THEN 1 WHEN '5' THEN 2 ELSE 3 END AS "order", {_DIR} AS direction, split_part(metric, '@', 1) AS family, split_part(metric, '@', 2)::INT AS k, count(*) AS n FROM v GROUP BY ALL""")
def s1(spark, d):
    return S.with_tiers(values(spark, d)).groupBy("metric", "tier", "order", "direction", "family", "k").agg(F.count("*").alias("n"))


_SUMMARY = f"summary AS (SELECT method, metric, {half_sql(mean_sql('value'), 7)} AS mean, stddev_samp(value) AS std, count(value) AS n FROM v GROUP BY 1, 2)"


@query("s2_summary", _with(*_METHODS, _SUMMARY) + "SELECT method, metric, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, round(std, 5) AS std, n FROM summary")
def s2(spark, d):
    s = _summaries(spark, d)
    return s.withColumns({"mean": half_up("mean", 5), "std": F.round("std", 5)})


@query("w11_leaderboard", _with(*_METHODS, _SUMMARY) + f"SELECT metric, method, row_number() OVER (PARTITION BY metric ORDER BY (floor(mean * 1e7 + 0.5) / 1e7) * {_DIR} DESC, method) AS place FROM summary")
def w11(spark, d):
    return S.leaderboard(_summaries(spark, d)).select("metric", "method", "place")


_PIV = "wide AS (SELECT method, " + ", ".join(f"max(floor(mean * 1e7 + 0.5) / 1e7) FILTER (metric = '{m}') AS \"{m}\"" for m in ("Regret@5", "Hit@5", "Regret@1", "BestTarget@5")) + " FROM summary GROUP BY 1)"
_CHOICE = "ORDER BY round(avg_rank, 7), \"Regret@5\", \"Hit@5\" DESC, \"Regret@1\", \"BestTarget@5\" DESC, method"


def _summaries(spark, d, v=None):
    return S.summary(v or values(spark, d)).withColumn("mean", half_up("mean", 7))


def _ranks(spark, d, v=None):
    return S.rank_stats(v or values(spark, d)).withColumn("avg_rank", F.round("avg_rank", 7))


@query("s11_selection", _with(*_ST, _SUMMARY, _PIV) + f"SELECT method, round(avg_rank, 5) AS avg_rank, (floor(\"Regret@5\" * 1e5 + 0.5) / 1e5) AS regret FROM wide JOIN (SELECT method, avg_rank FROM stat WHERE metric = 'Regret@5') USING (method) {_CHOICE} LIMIT 3")
def s11(spark, d):
    v = values(spark, d)
    best = S.selected(_summaries(spark, d, v), _ranks(spark, d, v), 3)
    return best.select("method", F.round("avg_rank", 5).alias("avg_rank"), half_up("`Regret@5`", 5).alias("regret"))


@query("s12_candidates", _with(*_METHODS, _SUMMARY, _PIV) + "SELECT method, (floor(\"Regret@5\" * 1e5 + 0.5) / 1e5) AS r5, (floor(\"Hit@5\" * 1e5 + 0.5) / 1e5) AS h5, (floor(\"Regret@1\" * 1e5 + 0.5) / 1e5) AS r1, (floor(\"BestTarget@5\" * 1e5 + 0.5) / 1e5) AS b5 FROM wide")
def s12(spark, d):
    names = ["Regret@5", "Hit@5", "Regret@1", "BestTarget@5"]
    wide = S.pivoted(_summaries(spark, d), "method", "metric", names, "mean")
    return wide.select("method", *[half_up(F.col(f"`{n}`"), 5).alias(a) for n, a in zip(names, ("r5", "h5", "r1", "b5"), strict=True)])


@query("s13_best_of_family", _with(*_ST) + """SELECT split_part(method, '_', 1) AS family, method, round(avg_rank, 5) AS avg_rank FROM stat WHERE metric = 'Regret@5'
QUALIFY row_number() OVER (PARTITION BY split_part(method, '_', 1) ORDER BY round(avg_rank, 7), method) = 1""")
def s13(spark, d):
    ranked = _ranks(spark, d).filter("metric = 'Regret@5'").withColumn("family", F.split_part("method", F.lit("_"), F.lit(1)))
    return first_of(ranked, ["family"], ["avg_rank", "method"]).select("family", "method", F.round("avg_rank", 5).alias("avg_rank"))


@query("s14_primary_rank_table", _with(*_ST, _SUMMARY) + "SELECT method, round(avg_rank, 5) AS avg_rank, position, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, summary.n FROM stat JOIN summary USING (method, metric) WHERE metric = 'Regret@5'")
def s14(spark, d):
    v = values(spark, d)
    joined = _ranks(spark, d, v).join(_summaries(spark, d, v), ["metric", "method"], "left").filter("metric = 'Regret@5'")
    return joined.select("method", F.round("avg_rank", 5).alias("avg_rank"), "position", half_up("mean", 5).alias("mean"), "n")


@query("s16_comparison", _with(*_METHODS, _RANKED) + "SELECT metric, method, " + half_sql(mean_sql("value"), 5) + " AS mean, round(coalesce(stddev_samp(value), 0), 5) AS std, count(*) AS n_fronts, round(avg(rank), 5) AS mean_rank FROM ranked GROUP BY 1, 2")
def s16(spark, d):
    c = S.comparison(values(spark, d))
    return c.select("metric", "method", half_up("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n_fronts", F.round("mean_rank", 5).alias("mean_rank"))


@query("s31_rank_heatmap", _with(*_ST) + "SELECT method, " + ", ".join(f"max(position) FILTER (metric = 'Regret@{k}') AS r{k}" for k in (1, 3, 5, 10)) + " FROM stat GROUP BY 1")
def s31(spark, d):
    names = [f"Regret@{k}" for k in (1, 3, 5, 10)]
    wide = S.pivoted(S.rank_stats(values(spark, d)), "method", "metric", names, "position")
    return wide.select("method", *[F.col(f"`Regret@{k}`").alias(f"r{k}") for k in (1, 3, 5, 10)])


@query("s19_column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct, round(min({c})::DOUBLE, 6) AS low, round(max({c})::DOUBLE, 6) AS high,
round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(count(*) FILTER ({c} = 0) / count(*), 6) AS zeros, count(DISTINCT {c}) <= 1 AS constant FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def s19(spark, d):
    p = S.column_profile(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return p.withColumns({"mean": half_up("mean", 4), "std": F.round("std", 4), "zeros": F.round("zeros", 6)})


@query("s21_front_profile", _with(X.FRONTS) + """SELECT front_id, count(*) AS n_items, round(min(target), 6) AS low, round(max(target), 6) AS high, """ + half_sql(mean_sql("target"), 6) + """ AS mean, round(stddev_pop(target), 6) AS std,
round(max(target) - min(target), 6) AS range, count(DISTINCT target) AS n_distinct, arg_min(item_id, (-target, item_id)) AS best_item FROM fronts GROUP BY 1""")
def s21(spark, d):
    p = S.front_profile(X.fronts(spark, d))
    return r6(p.drop("mean")).join(p.select("front_id", half_up("mean", 6).alias("mean")), "front_id")


# ---- networks

_CONS = """once AS (SELECT technique, src, dst, avg(w) AS w FROM edge_lists GROUP BY 1, 2, 3),
n1 AS (SELECT net_id, technique, weight / CASE WHEN abs(sum(weight) OVER (PARTITION BY net_id) - 1) > 1e-3 THEN sum(weight) OVER (PARTITION BY net_id) ELSE 1 END AS weight FROM candidate_weights WHERE weight > 0),
cons AS (SELECT net_id, src, dst, sum(weight * once.w) AS w FROM n1 JOIN once USING (technique) GROUP BY 1, 2, 3)"""
_NET = (X.FRONTS, X.EDGES, X.WEIGHTS, _CONS)


def consensus(spark, d):
    return N.consensus(X.candidate_weights(spark, d), X.edge_lists(spark, d))


@query("n1_normalized_weights", _with(X.FRONTS, X.EDGES, X.WEIGHTS, _CONS) + "SELECT net_id, technique, round(weight, 6) AS weight FROM n1")
def n1(spark, d):
    return r6(N.normalized_weights(N.positive_weights(X.candidate_weights(spark, d))))


@query("p13_positive_weights", _with(X.FRONTS, X.WEIGHTS) + "SELECT net_id, technique, round(weight, 6) AS weight FROM candidate_weights WHERE weight > 0")
def p13(spark, d):
    return r6(N.positive_weights(X.candidate_weights(spark, d)))


@query("n2_consensus", _with(*_NET) + "SELECT net_id, src, dst, round(w, 6) AS w FROM cons")
def n2(spark, d):
    return r6(consensus(spark, d))


@query("j1_weights_by_technique", _with(X.FRONTS, X.EDGES, X.WEIGHTS) + "SELECT net_id, technique, count(*) AS edges, round(sum(weight * w), 5) AS mass FROM candidate_weights JOIN edge_lists USING (technique) GROUP BY 1, 2")
def j1(spark, d):
    joined = X.candidate_weights(spark, d).join(X.edge_lists(spark, d), "technique")
    return joined.groupBy("net_id", "technique").agg(F.count("*").alias("edges"), F.round(F.sum(F.col("weight") * F.col("w")), 5).alias("mass"))


_G = (X.EDGES, "g AS (SELECT technique AS net_id, src, dst, sum(w) AS w FROM edge_lists GROUP BY 1, 2, 3)")
_STR = """st AS (SELECT net_id, node, sum(o) AS out_s, sum(i) AS in_s, sum(o) + sum(i) AS total_s FROM (SELECT net_id, src AS node, w AS o, 0 AS i FROM g UNION ALL SELECT net_id, dst, 0, w FROM g) GROUP BY 1, 2)"""


def networks(spark, d):
    return N.graph(X.edge_lists(spark, d).withColumnRenamed("technique", "net_id"))


def _gini(t: str, v: str) -> str:
    return f"""(SELECT net_id, (max(n) + 1 - 2 * sum((n - i + 1) * x) / sum(x)) / max(n) AS {v}_gini FROM
(SELECT net_id, {v} AS x, row_number() OVER (PARTITION BY net_id ORDER BY {v}) AS i, count(*) OVER (PARTITION BY net_id) AS n FROM {t}) GROUP BY 1)"""


@query("n3_graph", _with(*_G) + "SELECT net_id, src, dst, round(w, 6) AS w FROM g")
def n3(spark, d):
    return r6(networks(spark, d))


@query("n4_global", _with(*_G) + f"""SELECT g.net_id, count(*) AS n_edges, any_value(n_nodes) AS n_nodes, round(sum(w), 6) AS total_w, round(avg(w), 6) AS mean_w, round(any_value(w_gini), 6) AS weight_gini,
round(any_value(top_share), 6) AS top_share, round(sum(w) / greatest(any_value(n_nodes) * (any_value(n_nodes) - 1), 1), 6) AS density
FROM g JOIN (SELECT net_id, count(*) AS n_nodes FROM (SELECT net_id, src FROM g UNION SELECT net_id, dst FROM g) GROUP BY 1) USING (net_id) JOIN {_gini('g', 'w')} USING (net_id)
JOIN (SELECT net_id, sum(CASE WHEN i <= greatest(1, floor(n * 0.1)) THEN w ELSE 0 END) / sum(w) AS top_share FROM
(SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY w DESC, src, dst) AS i, count(*) OVER (PARTITION BY net_id) AS n FROM g) GROUP BY 1) USING (net_id) GROUP BY 1""")
def n4(spark, d):
    return r6(N.global_features(networks(spark, d)))


@query("n5_gini", _with(*_G) + f"SELECT net_id, round(w_gini, 6) AS gini FROM {_gini('g', 'w')}")
def n5(spark, d):
    return r6(N.gini(networks(spark, d), "w", ["net_id"]))


@query("n7_strengths", _with(*_G, _STR) + "SELECT net_id, node, round(out_s, 6) AS out_s, round(in_s, 6) AS in_s, round(total_s, 6) AS total_s FROM st")
def n7(spark, d):
    return r6(N.strengths(networks(spark, d)))


@query("n8_strength_features", _with(*_G, _STR) + "SELECT net_id, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("out_s", "in_s", "total_s") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"))) + ", " + ", ".join(f"round(any_value({c}_gini), 6) AS {c}_gini" for c in ("out_s", "in_s", "total_s")) + ", sum(hub)::BIGINT AS hubs FROM (SELECT *, (total_s > avg(total_s) OVER w + 2 * stddev_pop(total_s) OVER w)::INT AS hub FROM st WINDOW w AS (PARTITION BY net_id)) " + " ".join(f"JOIN {_gini('st', c)} USING (net_id)" for c in ("out_s", "in_s", "total_s")) + " GROUP BY 1")
def n8(spark, d):
    return r6(N.strength_features(networks(spark, d)))


@query("n9_assortativity", _with(*_G, _STR) + """SELECT g.net_id, round(coalesce(covar_pop(a.out_s, b.in_s) / nullif(stddev_pop(a.out_s) * stddev_pop(b.in_s), 0), 0), 6) AS assortativity
FROM g JOIN st a ON g.net_id = a.net_id AND g.src = a.node JOIN st b ON g.net_id = b.net_id AND g.dst = b.node GROUP BY 1""")
def n9(spark, d):
    return r6(N.assortativity(networks(spark, d)))


@query("n10_reciprocity", _with(*_G) + """SELECT g.net_id, round(sum(CASE WHEN r.w IS NULL THEN 0 ELSE least(g.w, r.w) END) / sum(g.w), 6) AS reciprocity FROM g LEFT JOIN g r ON g.net_id = r.net_id AND g.src = r.dst AND g.dst = r.src GROUP BY 1""")
def n10(spark, d):
    return r6(N.reciprocity(networks(spark, d)))


@query("j14_reciprocal_edges", _with(*_G) + "SELECT g.net_id, g.src, g.dst, round(g.w, 6) AS w, round(r.w, 6) AS back_w FROM g JOIN g r ON g.net_id = r.net_id AND g.src = r.dst AND g.dst = r.src")
def j14(spark, d):
    return r6(N.reciprocal(networks(spark, d)))


_UND = """ord AS (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY w DESC, src, dst) AS i FROM g),
fst AS (SELECT net_id, src, min(i) AS f FROM ord GROUP BY 1, 2),
u AS (SELECT net_id, least(src, dst) AS a, greatest(src, dst) AS b, arg_max(w, f) AS w FROM g JOIN fst USING (net_id, src) WHERE src <> dst GROUP BY 1, 2, 3),
sc AS (SELECT net_id, a, b, cbrt(u.w / top) AS g FROM u JOIN (SELECT net_id, max(w) AS top FROM g GROUP BY 1) USING (net_id)),
tri AS (SELECT x.net_id, x.a, x.b, y.b AS c, x.g * y.g * z.g AS t FROM sc x JOIN sc y ON x.net_id = y.net_id AND x.b = y.a JOIN sc z ON x.net_id = z.net_id AND x.a = z.a AND y.b = z.b),
tn AS (SELECT net_id, node, sum(t) AS t FROM (SELECT net_id, unnest([a, b, c]) AS node, t FROM tri) GROUP BY 1, 2),
dg AS (SELECT net_id, node, count(*) AS d FROM (SELECT net_id, unnest([a, b]) AS node FROM u) GROUP BY 1, 2),
nd AS (SELECT net_id, src AS node FROM g UNION SELECT net_id, dst FROM g)"""


@query("n11_clustering", _with(*_G, _UND) + "SELECT net_id, round(avg(CASE WHEN d >= 2 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM nd LEFT JOIN dg USING (net_id, node) LEFT JOIN tn USING (net_id, node) GROUP BY 1")
def n11(spark, d):
    return r6(N.clustering(networks(spark, d)))


def _heavy(spark, d):
    """The heavier half of each network's edges, so that components and paths are not trivial."""
    g = networks(spark, d).filter("src <> dst")
    cut = g.groupBy("net_id").agg(F.percentile("w", F.lit(0.9)).alias("cut"))
    return g.join(cut, "net_id").filter("w >= cut").drop("cut")


_HEAVY = "h AS (SELECT net_id, src, dst, w FROM g JOIN (SELECT net_id, quantile_cont(w, 0.9) AS cut FROM g WHERE src <> dst GROUP BY 1) USING (net_id) WHERE src <> dst AND w >= cut)"
_REACH = """reach(net_id, src, dst) AS (SELECT net_id, src, dst FROM h UNION SELECT r.net_id, r.src, h.dst FROM reach r JOIN h ON r.net_id = h.net_id AND r.dst = h.src),
hn AS (SELECT net_id, src AS node FROM h UNION SELECT net_id, dst FROM h),
scc AS (SELECT hn.net_id, hn.node, least(hn.node, coalesce(min(a.dst), hn.node)) AS component FROM hn LEFT JOIN
(SELECT x.net_id, x.src, x.dst FROM reach x JOIN reach y ON x.net_id = y.net_id AND x.src = y.dst AND x.dst = y.src) a ON a.net_id = hn.net_id AND a.src = hn.node GROUP BY 1, 2)"""


@query("n12_strong_components", "WITH RECURSIVE " + ",\n".join((*_G, _HEAVY, _REACH)) + " SELECT net_id, node, component FROM scc")
def n12(spark, d):
    return N.strong_components(_heavy(spark, d))


@query("j15_inside_component", "WITH RECURSIVE " + ",\n".join((*_G, _HEAVY, _REACH)) + """, big AS (SELECT net_id, component FROM scc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY net_id ORDER BY count(*) DESC, component) = 1),
mem AS (SELECT net_id, node FROM scc JOIN big USING (net_id, component))
SELECT net_id, src, dst, round(w, 6) AS w FROM h WHERE (net_id, src) IN (SELECT (net_id, node) FROM mem) AND (net_id, dst) IN (SELECT (net_id, node) FROM mem)""")
def j15(spark, d):
    h = _heavy(spark, d)
    return r6(N.inside(h, N.largest_component(N.strong_components(h))).select("net_id", "src", "dst", "w"))


#: Shortest walks of exactly hop edges; a shortest path has fewer edges than there are nodes.
_PATHS = """big AS (SELECT net_id, component FROM scc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY net_id ORDER BY count(*) DESC, component) = 1),
mem AS (SELECT net_id, node FROM scc JOIN big USING (net_id, component)),
hi AS (SELECT net_id, src, dst, 1 / (w + 1e-9) AS step FROM h WHERE (net_id, src) IN (SELECT (net_id, node) FROM mem) AND (net_id, dst) IN (SELECT (net_id, node) FROM mem)),
walk(hop, net_id, src, dst, d) AS (SELECT 1, net_id, src, dst, step FROM hi UNION ALL
SELECT w.hop + 1, w.net_id, w.src, hi.dst, min(w.d + hi.step) FROM walk w JOIN hi ON w.net_id = hi.net_id AND w.dst = hi.src WHERE w.hop < 25 GROUP BY ALL),
path AS (SELECT net_id, src, dst, min(d) AS d FROM walk WHERE src <> dst GROUP BY 1, 2, 3)"""


@query("n13_path_features", "WITH RECURSIVE " + ",\n".join((*_G, _HEAVY, _REACH, _PATHS)) + " SELECT net_id, round(avg(d), 6) AS path_mean, round(quantile_cont(d, 0.95), 6) AS path_p95 FROM path GROUP BY 1")
def n13(spark, d):
    return r6(N.path_features(_heavy(spark, d)))


@query("n13_whole_paths")
def n13_whole(spark, d):
    """The same over all edges."""
    return r6(N.path_features(networks(spark, d)))


@query("n14_communities")
def n14(spark, d):
    return r6(N.community_features(networks(spark, d)))


@query("n15_modularity", _with(*_G, _STR) + """, p AS (SELECT net_id, node, total_s, substr(node, 2)::INT % 3 AS part FROM st),
own AS (SELECT g.net_id, a.part, sum(w) AS own FROM g JOIN p a ON g.net_id = a.net_id AND g.src = a.node JOIN p b ON g.net_id = b.net_id AND g.dst = b.node AND a.part = b.part GROUP BY 1, 2),
dg AS (SELECT net_id, part, sum(total_s) AS deg FROM p GROUP BY 1, 2)
SELECT net_id, round(sum(coalesce(own, 0) / m - pow(deg / (2 * m), 2)), 6) AS modularity FROM dg LEFT JOIN own USING (net_id, part) JOIN (SELECT net_id, sum(w) AS m FROM g GROUP BY 1) USING (net_id) GROUP BY 1""")
def n15(spark, d):
    g = networks(spark, d)
    parts = N.nodes(g).withColumn("part", F.substring("node", 2, 9).cast("int") % 3)
    return r6(N.modularity(g, parts))


@query("n16_entropies", _with(*_G, _STR) + """SELECT net_id, round(edge_entropy, 6) AS edge_entropy, round(node_entropy, 6) AS node_entropy FROM
(SELECT net_id, -sum(p * ln(p)) AS edge_entropy FROM (SELECT net_id, w / (sum(w) OVER (PARTITION BY net_id) + 1e-9) AS p FROM g) WHERE p > 0 GROUP BY 1) JOIN
(SELECT net_id, -sum(p * ln(p)) AS node_entropy FROM (SELECT net_id, total_s / (sum(total_s) OVER (PARTITION BY net_id) + 1e-9) AS p FROM st) WHERE p > 0 GROUP BY 1) USING (net_id)""")
def n16(spark, d):
    return r6(N.entropies(networks(spark, d)))


@query("w17_ranked_edges", _with(*_G) + "SELECT net_id, src, dst, row_number() OVER (PARTITION BY net_id ORDER BY round(w, 9) DESC, src, dst) AS edge_rank FROM g")
def w17(spark, d):
    return N.ranked_edges(networks(spark, d).withColumn("w", F.round("w", 9))).select("net_id", "src", "dst", "edge_rank")


@query("t5_top_edges", _with(*_G) + "SELECT net_id, src, dst FROM g QUALIFY row_number() OVER (PARTITION BY net_id ORDER BY round(w, 9) DESC, src, dst) <= 10")
def t5(spark, d):
    return N.ranked_edges(networks(spark, d).withColumn("w", F.round("w", 9))).filter("edge_rank <= 10").select("net_id", "src", "dst")


@query("t11_selected_networks", _with(*_NET) + ", s AS (SELECT DISTINCT net_id FROM candidate_weights WHERE technique = 'A' AND weight >= 0.5) SELECT net_id, src, dst, round(w, 6) AS w FROM cons WHERE net_id IN (SELECT net_id FROM s)")
def t11(spark, d):
    weights = X.candidate_weights(spark, d)
    chosen = weights.filter("technique = 'A' AND weight >= 0.5").select("net_id").distinct()
    return r6(N.consensus(weights.join(chosen, "net_id", "left_semi"), X.edge_lists(spark, d)))


#: Paths of whole networks, each of which is one strong component here.
_WHOLE_PATHS = _HEAVY.replace(" AND w >= cut", "")


@query("n17_network_features")
def n17(spark, d):
    """All blocks that SQL can say."""
    return r6(N.network_features(networks(spark, d), [b for b in N.BLOCKS if b != "communities"]))


@query("n17_all_blocks")
def n17_all(spark, d):
    return r6(N.network_features(networks(spark, d)))



