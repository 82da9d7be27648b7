"""Queries on the remaining readers, joins, selections and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frontrank.functions import exact_mean, half_up, lenient, metric_family, metric_k
from frontrank.operators import decision as D
from frontrank.operators import evidence as V
from frontrank.operators import figures as G
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.operators import stats as S
from frontrank.plans import fixtures as X
from frontrank.plans.comparing import _ST, _SUMMARY, _METHODS, _RANKED, _ranks, _summaries, networks, values
from frontrank.plans.profiling import _EV, _NAMED, _SPLIT, evidence, named, ranked, splits
from frontrank.plans.profiling import _RANKED as _EDGE_RANKS
from frontrank.plans.ranking import _SCORES, _with
from frontrank.plans.registry import half_sql, mean_sql, query, r6
from frontrank.sources import tables as T

# ---- readers and writers


@query("a4_missing_techniques", _with(X.EDGES, X.WEIGHTS) + "SELECT technique, count(*) AS weights FROM candidate_weights WHERE technique NOT IN (SELECT technique FROM edge_lists WHERE technique <> 'N') GROUP BY 1")
def a4(spark, d):
    """Weights whose base network has no file in a folder: that of N is never written."""
    path = T.fresh_path(spark, "networks")
    T.write_edge_folder(X.edge_lists(spark, d).filter("technique <> 'N'"), path)
    return T.missing_techniques(spark, path, X.candidate_weights(spark, d)).groupBy("technique").agg(F.count("*").alias("weights"))


@query("a9_run_names", "SELECT DISTINCT p_brand AS run, replace(p_brand, '#', '-') AS model FROM part")
def a9(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_brand").alias("run")).distinct()
    return p.select("run", T.run_name(F.concat(F.lit("/x/model="), F.regexp_replace("run", "#", "-"), F.lit("/report.json"))).alias("model"))


@query("a10_front_names", _with(_NAMED) + "SELECT DISTINCT front_id, front_name FROM named")
def a10(spark, d):
    path = T.fresh_path(spark, "names")
    named(spark, d).write.csv(path)
    return spark.read.schema("front_id long, front_name string").csv(path).distinct()


@query("a12_gene_universe", "SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer WHERE trim(c_mktsegment) <> ''")
def a12(spark, d):
    return V.universe(X.table(spark, d, "customer").withColumnRenamed("c_mktsegment", "gene_symbol"))


@query("a13_interactions", """SELECT upper(n_name) AS source, upper(r_name) AS target, r AS resource FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('AFRICA'), ('ASIA')) t(r)
WHERE contains(r_name, r) AND NOT contains(r_name, '_') AND NOT contains(replace(n_name, '_', '-'), '_')""")
def a13(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    raw = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.translate("n_name", "_", "-").alias("source_genesymbol"), F.col("r_name").alias("target_genesymbol"), F.col("r_name").alias("sources"))
    path = T.fresh_path(spark, "interactions")
    raw.write.option("sep", "\t").option("header", True).csv(path)
    read = spark.read.schema(raw.schema).csv(path, sep="\t", header=True)
    return V.interactions(read, {"AFRICA": "AFRICA", "ASIA": "ASIA"}).select(F.translate("source", "-", "_").alias("source"), "target", "resource")


@query("a14_curated", "SELECT DISTINCT upper(trim(p_type)) AS source, upper(trim(p_name)) AS target, 'parts' AS resource FROM part")
def a14(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_type").alias("source"), F.col("p_name").alias("target"), F.lit("up").alias("mode"), F.lit("1").alias("pmid")).distinct()
    return V.curated(p, "parts").select("source", "target", "resource").distinct()


@query("a17_summary_reader", _with(*_METHODS, _SUMMARY) + "SELECT method, metric, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, n FROM summary")
def a17(spark, d):
    path = T.fresh_path(spark, "summary")
    T.write_table(_summaries(spark, d), path, kind="csv")
    read = spark.read.schema("method string, metric string, mean double, std double, n long").csv(path, header=True)
    return T.require(read, ["method", "metric", "mean"]).select("method", "metric", half_up("mean", 5).alias("mean"), "n")


@query("a20_json_reports", _with(*_METHODS) + "SELECT method AS model, 0 AS fold, count(DISTINCT front_id) AS n_fronts, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM v GROUP BY 1")
def a20(spark, d):
    v = values(spark, d).select(F.col("method").alias("model"), F.lit(0).alias("fold"), "front_id", "metric", "value")
    found = T.reports(v).groupBy("model", "fold").agg(F.sum(F.coalesce(F.size("groups"), F.lit(0))).alias("n_fronts"), F.max(F.array_join(F.map_keys("agg"), ",")).alias("metrics"))
    return found.select("model", "fold", "n_fronts", "metrics")


# ---- filters and names


@query("p11_chosen_metrics", _with(*_METHODS) + "SELECT metric, count(*) AS n FROM v WHERE metric IN ('Regret@5', 'Hit@1') GROUP BY 1")
def p11(spark, d):
    return values(spark, d).filter(F.col("metric").isin("Regret@5", "Hit@1")).groupBy("metric").agg(F.count("*").alias("n"))


@query("p14_evidence_filters", _with(_EV) + "SELECT source, count(*) AS n FROM ev GROUP BY 1")
def p14(spark, d):
    return evidence(spark, d).filter("resource = 'trade'").groupBy("source").agg(F.count("*").alias("n"))


@query("p18_directions", _with(*_METHODS) + "SELECT DISTINCT metric, CASE WHEN metric LIKE 'Regret@%' THEN -1 ELSE 1 END AS direction FROM v")
def p18(spark, d):
    return S.with_tiers(values(spark, d)).select("metric", "direction").distinct()


@query("p19_metric_family", _with(*_METHODS) + "SELECT DISTINCT metric, split_part(metric, '@', 1) AS family, split_part(metric, '@', 2)::INT AS k FROM v")
def p19(spark, d):
    return values(spark, d).select("metric", metric_family(F.col("metric")).alias("family"), metric_k(F.col("metric")).alias("k")).distinct()


@query("p22_run_parts", "SELECT DISTINCT p_type AS model, p_brand AS label_mode, 'nl' || p_size AS tag, p_size::DOUBLE AS nl FROM part")
def p22(spark, d):
    run = F.concat_ws("__", "p_type", "p_brand", F.concat(F.lit("nl"), "p_size"))
    parts = G.run_parts(F.col("run"))
    p = X.table(spark, d, "part").select(run.alias("run")).distinct()
    return p.select(parts["model"].alias("model"), parts["label_mode"].alias("label_mode"), parts["tag"].alias("tag"), G.tag_value(parts["tag"], "nl").alias("nl"))


@query("p8_strict_numbers", "SELECT count(*) AS n, sum(p_size)::DOUBLE AS total FROM part")
def p8(spark, d):
    p = X.table(spark, d, "part").withColumn("size", F.col("p_size").cast("string"))
    return T.strict_numbers(p, ["size"]).agg(F.count("*").alias("n"), F.sum("size").alias("total"))


# ---- joins and selections


@query("j2_outer_networks", _with(X.EDGES) + "SELECT src, dst, round(sum(w), 5) AS w, count(*) AS networks FROM edge_lists GROUP BY 1, 2")
def j2(spark, d):
    return X.edge_lists(spark, d).groupBy("src", "dst").agg(F.round(F.sum("w"), 5).alias("w"), F.count("*").alias("networks"))


@query("j6_supported_edges", _with(*_EDGE_RANKS, _EV) + "SELECT method, src, dst FROM g WHERE (src, dst) IN (SELECT (source, target) FROM ev)")
def j6(spark, d):
    known = evidence(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return ranked(spark, d).join(known, ["src", "dst"], "left_semi").select("method", "src", "dst")


@query("j7_ranks_and_means", _with(*_ST, _SUMMARY) + "SELECT metric, method, position, (floor(mean * 1e5 + 0.5) / 1e5) AS mean FROM stat LEFT JOIN summary USING (metric, method)")
def j7(spark, d):
    v = values(spark, d)
    return _ranks(spark, d, v).join(_summaries(spark, d, v), ["metric", "method"], "left").select("metric", "method", "position", half_up("mean", 5).alias("mean"))


@query("j9_secondary_metrics", _with(*_METHODS, _SUMMARY) + "SELECT method, " + ", ".join(f"(floor(max(mean) FILTER (metric = 'Hit@{k}') * 1e5 + 0.5) / 1e5) AS h{k}" for k in (1, 3, 10)) + " FROM summary GROUP BY 1")
def j9(spark, d):
    wide = S.pivoted(_summaries(spark, d), "method", "metric", [f"Hit@{k}" for k in (1, 3, 10)], "mean")
    return wide.select("method", *[half_up(F.col(f"`Hit@{k}`"), 5).alias(f"h{k}") for k in (1, 3, 10)])


@query("j11_without_report", "SELECT c_custkey AS candidate FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j11(spark, d):
    orders = X.table(spark, d, "orders").select(F.col("o_custkey").alias("candidate")).distinct()
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("candidate")).join(orders, "candidate", "left_anti")


@query("j19_test_fronts_ranked", _with(X.FRONTS, X.FAMILIES, _SPLIT) + "SELECT front_id, 'manifest' AS side FROM splits WHERE split = 'test' AND front_id NOT IN (SELECT front_id FROM fronts)")
def j19(spark, d):
    test = splits(spark, d).filter("split = 'test'")
    done = X.fronts(spark, d).join(test.select("front_id"), "front_id", "left_semi")
    return P.unmatched_fronts(done, test)


@query("n6_density", _with(X.EDGES) + """SELECT technique AS net_id, round(sum(w) / greatest(any_value(n) * (any_value(n) - 1), 1), 6) AS density FROM edge_lists
JOIN (SELECT technique, count(*) AS n FROM (SELECT technique, src FROM edge_lists UNION SELECT technique, dst FROM edge_lists) GROUP BY 1) USING (technique) GROUP BY 1""")
def n6(spark, d):
    return r6(N.global_features(networks(spark, d)).select("net_id", "density"))


@query("s9_phase_summary", _with(*_METHODS, _SUMMARY) + "SELECT method, count(*) AS metrics, (floor(max(mean) FILTER (metric = 'Regret@5') * 1e5 + 0.5) / 1e5) AS primary_mean FROM summary GROUP BY 1")
def s9(spark, d):
    s = S.phase_summary(_summaries(spark, d), ["Regret@5", "Hit@5"])
    return s.select("method", "metrics", half_up("primary_mean", 5).alias("primary_mean"))


@query("s10_selection_ranks", _with(*_ST) + "SELECT method, position FROM stat WHERE metric = 'Regret@5'")
def s10(spark, d):
    return S.rank_stats(values(spark, d).filter("metric = 'Regret@5'")).select("method", "position")


@query("s15_grouped_rank_table", _with(*_METHODS) + """, gv AS (SELECT *, split_part(method, '_', 1) = 'single' AS single FROM v WHERE metric = 'Regret@5'),
r AS (SELECT single, method, front_id, rank() OVER (PARTITION BY single, front_id ORDER BY value) + (count(*) OVER (PARTITION BY single, front_id, value) - 1) / 2.0 AS rank FROM gv)
SELECT single, method, round(avg(rank), 5) AS avg_rank FROM r GROUP BY 1, 2""")
def s15(spark, d):
    v = values(spark, d).filter("metric = 'Regret@5'").withColumn("single", F.col("method").startswith("single_"))
    return S.rank_stats(v, ["single", "metric"]).select("single", "method", F.round("avg_rank", 5).alias("avg_rank"))


@query("s18_comparison_summary", _with(*_METHODS, _RANKED) + "SELECT metric, count(DISTINCT method) AS methods, count(DISTINCT front_id) AS fronts, " + half_sql(mean_sql("value"), 5) + " AS mean FROM ranked GROUP BY 1")
def s18(spark, d):
    v = S.paired(values(spark, d))
    return v.groupBy("metric").agg(F.count_distinct("method").alias("methods"), F.count_distinct("front_id").alias("fronts"), half_up(exact_mean("value"), 5).alias("mean"))


@query("s20_numeric_summary", "SELECT count(value) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events")
def s20(spark, d):
    v = lenient("value")
    return X.table(spark, d, "events").agg(F.count(v).alias("n"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"))


@query("w18_varying_parameters", """WITH p AS (SELECT p_brand AS g, p_partkey AS id, p_size::DOUBLE AS x, min(p_size) OVER w AS low, max(p_size) OVER w AS high FROM part WINDOW w AS (PARTITION BY p_brand))
SELECT g, id, round((x - low) / (high - low), 6) AS scaled FROM p WHERE low < high""")
def w18(spark, d):
    w = Window.partitionBy("g")
    p = X.table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"))
    p = p.withColumns({"low": F.min("x").over(w), "high": F.max("x").over(w)}).filter("low < high")
    return r6(p.select("g", "id", ((F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).alias("scaled")))


@query("w20_display_order", _with(*_ST) + "SELECT method, row_number() OVER (ORDER BY round(avg_rank, 7), method) AS place FROM stat WHERE metric = 'Regret@5'")
def w20(spark, d):
    r = _ranks(spark, d).filter("metric = 'Regret@5'")
    return r.select("method", F.row_number().over(Window.partitionBy("metric").orderBy("avg_rank", "method")).alias("place"))


@query("t2_top_weights", _with(X.WEIGHTS) + "SELECT net_id, string_agg(technique, ',' ORDER BY round(weight, 9) DESC, technique) AS best FROM (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY round(weight, 9) DESC, technique) AS i FROM candidate_weights) WHERE i <= 2 GROUP BY 1")
def t2(spark, d):
    w = Window.partitionBy("net_id").orderBy(F.desc(F.round("weight", 9)), "technique")
    top = X.candidate_weights(spark, d).withColumn("i", F.row_number().over(w)).filter("i <= 2")
    return top.groupBy("net_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "technique"))), lambda x: x["technique"]), ",").alias("best"))


@query("t6_distinct_edges", _with(X.EDGES) + "SELECT DISTINCT src, dst FROM edge_lists")
def t6(spark, d):
    return X.edge_lists(spark, d).select("src", "dst").distinct()


@query("t8_shared_fronts", "SELECT l_partkey AS front_id FROM lineitem INTERSECT SELECT p_partkey FROM part")
def t8(spark, d):
    return X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("front_id")).intersect(X.table(spark, d, "part").select("p_partkey"))


@query("t12_selected_report", _with(*_SCORES) + """SELECT front_id, item_id, round(score, 6) AS score, price, discount FROM scores JOIN (SELECT front_id, item_id, price, discount FROM fronts) USING (front_id, item_id)
WHERE rule = 'topsis' QUALIFY row_number() OVER (PARTITION BY front_id ORDER BY round(score, 9) DESC, item_id) = 1""")
def t12(spark, d):
    f = X.fronts(spark, d)
    best = D.best_candidates(D.score_rule(f, "topsis", X.OBJECTIVES).select("front_id", "item_id", F.lit("topsis").alias("rule"), "score"), digits=9)
    return r6(best.join(f.select("front_id", "item_id", "price", "discount"), ["front_id", "item_id"]).drop("rule"))


@query("f3_ablation_matrix")
def f3(spark, d):
    v = values(spark, d).filter("metric = 'Regret@5'")
    s = splits(spark, d).select("front_id", "split")
    both = {k: S.rank_stats(v.join(s.filter(F.col("split") == k), "front_id", "left_semi")) for k in ("development", "test")}
    return G.ablation_table(both["development"], both["test"]).withColumns({c: F.round(c, 5) for c in ("dev_rank", "test_rank")})


@query("t3_edges_to_cutoff", _with(*_EDGE_RANKS) + "SELECT method, src, dst, edge_rank FROM g WHERE edge_rank <= 50")
def t3(spark, d):
    return ranked(spark, d).filter("edge_rank <= 50").select("method", "src", "dst", "edge_rank")


@query("t10_sorted_edges", _with(X.EDGES) + "SELECT technique, src, dst, round(w, 6) AS w FROM edge_lists")
def t10(spark, d):
    return r6(X.edge_lists(spark, d)).orderBy("technique", F.desc("w"), "src", "dst")


@query("t7_tagged_union", _with(X.FAMILIES, _SPLIT) + "SELECT 'part' AS kind, p_partkey AS id FROM part UNION ALL SELECT 'customer', c_custkey FROM customer")
def t7(spark, d):
    part = X.table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return part.unionByName(X.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("p12_selectable", """SELECT c_custkey AS candidate, c_acctbal >= 0 AND n IS NOT NULL AS selectable, CASE WHEN n IS NULL THEN 'no report' WHEN c_acctbal < 0 THEN 'negative' ELSE 'ok' END AS reason
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def p12(spark, d):
    c = X.table(spark, d, "customer").withColumnRenamed("c_custkey", "candidate")
    return D.selectable(c, X.table(spark, d, "orders").withColumnRenamed("o_custkey", "candidate"), "candidate", "c_acctbal")


@query("f5_rule_ranks", _with(*_ST, _SUMMARY) + "SELECT method, position, round(avg_rank, 5) AS avg_rank, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, position = 1 AS winner FROM stat JOIN summary USING (metric, method) WHERE metric = 'Regret@5'")
def f5(spark, d):
    v = values(spark, d)
    joined = _ranks(spark, d, v).join(_summaries(spark, d, v), ["metric", "method"]).filter("metric = 'Regret@5'")
    return joined.select("method", "position", F.round("avg_rank", 5).alias("avg_rank"), half_up("mean", 5).alias("mean"), (F.col("position") == 1).alias("winner"))


@query("f8_curves", _with(*_METHODS, _SUMMARY) + "SELECT method, split_part(metric, '@', 2)::INT AS k, (floor(mean * 1e5 + 0.5) / 1e5) AS mean, round(std, 5) AS std FROM summary WHERE metric LIKE 'Regret@%'")
def f8(spark, d):
    s = _summaries(spark, d).filter("metric LIKE 'Regret@%'")
    return s.select("method", metric_k(F.col("metric")).alias("k"), half_up("mean", 5).alias("mean"), F.round("std", 5).alias("std"))
