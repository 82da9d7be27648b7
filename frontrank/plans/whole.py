"""Queries on whole jobs (reports, comparisons, built data), run names, stores and column catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frontrank.functions import half_up, metric_k
from frontrank.operators import decision as D
from frontrank.operators import expression as E
from frontrank.operators import figures as G
from frontrank.operators import labels as L
from frontrank.operators import ltr as R
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.operators import stats as S
from frontrank.plans import fixtures as X
from frontrank.plans.comparing import _CHOICE, _DIR, _HEAVY, _METHODS, _PIV, _RANKED, _ST, _SUMMARY, _WHOLE_PATHS, _ranks, _summaries, values
from frontrank.plans.learning import ORDER, rows
from frontrank.plans.profiling import _C, _SPLIT, _recursive, cells, front_meta, splits
from frontrank.plans.ranking import _with
from frontrank.plans.registry import ORACLE_SQL, half_sql, mean_sql, query, r6
from frontrank.sources import tables as T

# ---- reports and stores


def _reported(spark, v, label):
    """Values of metrics, written as reports of one fold for each method; the path."""
    path = T.fresh_path(spark, label)
    T.write_reports(v.select(F.col("method").alias("model"), F.lit(0).alias("fold"), "front_id", "metric", "value"), path)
    return path


@query("a8_many_reports", _with(*_METHODS) + "SELECT method AS model, count(*) AS n, count(DISTINCT front_id) AS fronts, count(DISTINCT metric) AS metrics FROM v GROUP BY 1")
def a8(spark, d):
    v, first = values(spark, d), F.col("metric").endswith("@1")
    paths = [_reported(spark, v.filter(some), "many") for some in (first, ~first)]
    g = T.group_metrics(T.read_reports(spark, paths))
    return g.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("front_id").alias("fronts"), F.count_distinct("metric").alias("metrics"))


@query("s8_cv_summary", _with(*_ST, _SUMMARY) + f"""SELECT metric, method, {half_sql('mean', 5)} AS mean, summary.n, round(avg_rank, 5) AS avg_rank,
row_number() OVER (PARTITION BY metric ORDER BY mean * {_DIR} DESC, method) AS place FROM summary JOIN stat USING (metric, method)""")
def s8(spark, d):
    parts = X.tasks(spark, d)
    g = T.averaged_groups(T.read_reports(spark, _reported(spark, values(spark, d), "cv")), parts)
    s = S.cv_summary(T.bucketed(g.withColumnRenamed("model", "method"), "cv", "front_id", parts), required=["Regret@5"], digits=7)
    return s.select("metric", "method", half_up("mean", 5).alias("mean"), "n", F.round("avg_rank", 5).alias("avg_rank"), "place")


@query("a18_figure_tables", _with(*_ST, _SUMMARY) + f"""SELECT metric, method, position::BIGINT AS rank, 'ranks' AS kind, round(avg_rank, 5) AS value FROM stat
UNION ALL SELECT metric, method, NULL, 'means', {half_sql('mean', 5)} FROM summary""")
def a18(spark, d):
    schema, out = "metric string, method string, rank long, kind string, value double", []
    v = values(spark, d)
    ranks = S.rank_stats(v).select("metric", "method", F.col("position").alias("rank"), F.lit("ranks").alias("kind"), F.round("avg_rank", 5).alias("value"))
    means = _summaries(spark, d, v).select("metric", "method", F.lit("means").alias("kind"), half_up("mean", 5).alias("value"))
    for df in (ranks, means):
        path = T.fresh_path(spark, "figure")
        T.write_table(df, path, kind="csv")
        out.append(T.read_figure_table(spark, path, schema, ["metric", "method"]))
    return out[0].unionByName(out[1])


@query("a19_table_sinks", "SELECT kind, p_partkey AS front_id, p_size::BIGINT AS size FROM part, (VALUES ('csv'), ('parquet')) t(kind)")
def a19(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("front_id"), F.col("p_size").cast("long").alias("size"))
    out = []
    for kind in ("csv", "parquet"):
        path = T.fresh_path(spark, "sink")
        T.write_table(p.limit(0), path, kind=kind)
        T.write_table(p, path, existing="force", kind=kind)
        T.write_table(p.limit(0), path, existing="skip", kind=kind)
        read = spark.read.schema(p.schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(p.schema).parquet(path)
        out.append(read.withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@query("a22_stored_ranker", _with(X.FRONTS) + "SELECT 'pairwise' AS kind, 'price,discount,tax,quantity' AS features, count(*) AS scored, count(DISTINCT front_id) AS fronts FROM fronts")
def a22(spark, d):
    df, path = rows(spark, d), T.fresh_path(spark, "ranker")
    R.fit(L.build_labels(df, "continuous"), "pairwise", ORDER).save(path)
    ranker = R.load(spark, path)
    scored = ranker.score(T.aligned(df, ranker.order, ["front_id", "item_id"]))
    return scored.agg(F.lit(ranker.kind).alias("kind"), F.lit(",".join(ranker.order)).alias("features"), F.count("score").alias("scored"), F.count_distinct("front_id").alias("fronts"))


@query("l4_fit_contract", _with(X.FRONTS, X.FAMILIES, _SPLIT) + "SELECT front_id, item_id, TRUE AS scored FROM fronts JOIN splits USING (front_id) WHERE split = 'test'")
def l4(spark, d):
    """One score for each row of fronts that the fit didn't see, whatever the order of rows."""
    df = P.with_split(rows(spark, d), splits(spark, d))
    ranker = R.fit(L.build_labels(df.filter("split = 'development'"), "continuous"), "pairwise", ORDER)
    return ranker.score(df.filter("split = 'test'")).select("front_id", "item_id", F.col("score").isNotNull().alias("scored"))


# ---- run names and tags


@query("p20_any_k", "SELECT p_partkey AS id, try_cast(split_part(p_type || '@' || CASE WHEN p_size % 5 = 0 THEN 'all' ELSE p_size::VARCHAR END, '@', 2) AS INT) AS k FROM part")
def p20(spark, d):
    name = F.concat("p_type", F.lit("@"), F.when(F.col("p_size") % 5 == 0, "all").otherwise(F.col("p_size").cast("string")))
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), metric_k(name).alias("k"))


@query("p21_run_model", "SELECT p_partkey AS id, p_type AS model, CASE WHEN p_size % 3 > 0 THEN p_brand END AS label_mode FROM part")
def p21(spark, d):
    run = F.when(F.col("p_size") % 3 > 0, F.concat_ws("__", "p_type", "p_brand")).otherwise(F.col("p_type"))
    parts = G.run_parts(run)
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), parts["model"].alias("model"), parts["label_mode"].alias("label_mode"))


@query("p23_tag_map", """SELECT p_partkey AS id, 'nl=' || (p_size + 1)::DOUBLE || ',mcs=' || (p_size % 7)::DOUBLE || ',lr=' || round((p_size % 9 + 1) / 100, 2)::DOUBLE AS tags FROM part""")
def p23(spark, d):
    size = F.col("p_size")
    tag = F.concat(F.lit("nl"), size + 1, F.lit("_mcs"), size % 7, F.lit("_lr00"), size % 9 + 1)
    found = G.tag_map(tag)
    text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), found[n].cast("string")) for n in ("nl", "mcs", "lr")])
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("tags"))


@query("f2_tuning_table", _with(*_METHODS, _SUMMARY) + f"""SELECT method || '__continuous__nl' || n || '_lr0' || lpad(i::VARCHAR, 2, '0') AS method, method AS model, 'continuous' AS label_mode, metric, {half_sql('mean', 5)} AS mean, n::DOUBLE AS nl, i / 100 AS lr, method LIKE 'single%' AS selected
FROM (SELECT *, dense_rank() OVER (ORDER BY method) AS i FROM summary)""")
def f2(spark, d):
    """Each method as a run whose tag tells how many fronts it has and its place by name."""
    s = _summaries(spark, d)
    place = s.select("method").distinct().withColumn("i", F.row_number().over(Window.orderBy("method")))  # a row for each method
    s = s.join(place, "method").withColumn("method", F.concat("method", F.lit("__continuous__nl"), "n", F.lit("_lr0"), F.lpad(F.col("i").cast("string"), 2, "0")))
    chosen = [r[0] for r in s.filter("method LIKE 'single%'").select("method").distinct().collect()]
    return G.tuning_table(s, chosen, ["nl", "lr"]).withColumn("mean", half_up("mean", 5))


@query("t4_first_configurations", _with(*_ST, _SUMMARY, _PIV) + f"SELECT method FROM wide JOIN (SELECT method, avg_rank FROM stat WHERE metric = 'Regret@5') USING (method) {_CHOICE} LIMIT 5")
def t4(spark, d):
    v = values(spark, d)
    return S.selected(_summaries(spark, d, v), _ranks(spark, d, v), 5).select("method")


# ---- held-out and ablation tables

_BY_SPLIT = "by_split AS (SELECT split, method, avg(rank) AS avg_rank FROM ranked JOIN splits USING (front_id) WHERE metric = 'Regret@5' GROUP BY 1, 2)"
_ABLATED = (*_METHODS, _RANKED, X.FAMILIES, _SPLIT, _BY_SPLIT)


def split_ranks(spark, d):
    v = values(spark, d).filter("metric = 'Regret@5'")
    s = splits(spark, d).select("front_id", "split")
    return {k: S.rank_stats(v.join(s.filter(F.col("split") == k), "front_id", "left_semi")) for k in ("development", "test")}


_FULL = "CASE method WHEN 'learned' THEN 'full' ELSE method END"


@query("j8_development_and_held_out", _with(*_ABLATED) + """SELECT method AS variant, round(max(avg_rank) FILTER (split = 'development'), 5) AS dev_rank, round(max(avg_rank) FILTER (split = 'test'), 5) AS test_rank,
starts_with(method, 'single_') AS single, NOT starts_with(method, 'single_') AS aggregate FROM by_split GROUP BY method""")
def j8(spark, d):
    ranks = split_ranks(spark, d)
    table = G.ablation_table(ranks["development"], ranks["test"])
    of = table.select("variant", F.when(F.col("variant").startswith("single_"), "single").otherwise("aggregate").alias("block"))
    out = G.with_blocks(table, of, ["single", "aggregate"])
    return out.withColumns({c: F.round(c, 5) for c in ("dev_rank", "test_rank")})


ORACLE_SQL["f3_ablation_matrix"] = _with(*_ABLATED) + "SELECT method AS variant, round(max(avg_rank) FILTER (split = 'development'), 5) AS dev_rank, round(max(avg_rank) FILTER (split = 'test'), 5) AS test_rank FROM by_split GROUP BY method"


# ---- tests with their tail probabilities: chi-square of an even number of degrees as a finite sum, the normal by Simpson's rule

_NORMAL = """(1 - 2 / sqrt(2 * pi()) * least(abs(z), 8) / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(least(abs(z), 8) * i / 2000, 2)))))"""
_TESTS = f"""pz AS (SELECT *, CASE WHEN position > 1 THEN greatest({_NORMAL}, 0) END AS p,
exp(-friedman / 2) * list_sum(list_transform(range(0, 5), lambda i: pow(friedman / 2, i) / gamma(i + 1))) AS friedman_p FROM stat),
ps AS (SELECT *, least(1, (count(p) OVER (PARTITION BY metric) - row_number() OVER o + 1) * p) AS step, row_number() OVER o AS i FROM pz WINDOW o AS (PARTITION BY metric ORDER BY p NULLS LAST, method)),
tests AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(step) OVER (PARTITION BY metric ORDER BY i) END AS p_holm FROM ps)"""
ORACLE_SQL["s17_rank_tests"] = _with(*_ST, _TESTS) + """SELECT metric, method, round(avg_rank, 5) AS avg_rank, n AS n_fronts, k, round(friedman, 3) AS friedman, position, winner, round(CASE WHEN position > 1 THEN z END, 4) AS z,
round(friedman_p, 5) AS friedman_p, round(p, 5) AS p, round(p_holm, 5) AS p_holm, p_holm < 0.05 AS significant FROM tests"""
_CLASS = "CASE WHEN p_holm IS NULL THEN 'winner' WHEN p_holm < 0.05 THEN 'significant' ELSE 'not_significant' END AS class, CASE WHEN p_holm IS NULL THEN 'winner' WHEN p_holm < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', p_holm) END AS label"
ORACLE_SQL["f1_screening_table"] = _with(*_ST, _TESTS) + f"SELECT method, method AS model, NULL::VARCHAR AS label_mode, round(avg_rank, 5) AS avg_rank, {_CLASS}, method = 'topsis' AS selected FROM tests WHERE metric = 'Regret@5'"


@query("s18_whole_comparison", _with(*_ST, _TESTS) + f"""SELECT r.metric, r.method, {half_sql(mean_sql('value'), 5)} AS mean, count(*) AS n_fronts, round(any_value(t.z), 4) AS z, any_value(t.significant) AS significant FROM ranked r
LEFT JOIN (SELECT method, CASE WHEN position > 1 THEN z END AS z, p_holm < 0.05 AS significant FROM tests WHERE metric = 'Regret@5') t USING (method) GROUP BY 1, 2""")
def s18_whole(spark, d):
    c = S.comparison_summary(values(spark, d))
    return c.select("metric", "method", half_up("mean", 5).alias("mean"), "n_fronts", F.round("z", 4).alias("z"), "significant")


@query("f4_held_out_table", _with(*_METHODS, _RANKED.replace("FROM v)", "FROM v JOIN splits USING (front_id) WHERE split = 'test' AND metric = 'Regret@5')"), *_ST[-1:], _TESTS).replace("methods AS (", f"{X.FAMILIES},\n{_SPLIT},\nmethods AS (", 1)
+ f"SELECT {_FULL} AS variant, round(avg_rank, 5) AS avg_rank, position, {_CLASS} FROM tests")
def f4(spark, d):
    test = splits(spark, d).filter("split = 'test'").select("front_id")
    tests = S.rank_tests(values(spark, d).filter("metric = 'Regret@5'").join(test, "front_id", "left_semi"))
    return G.held_out_table(tests).withColumn("avg_rank", F.round("avg_rank", 5))


# ---- splits and built data


@query("w16_audited_split", _recursive("SELECT family, CASE WHEN c.turn IS NULL THEN 'development' ELSE 'test' END AS split, count(*) AS fronts FROM families LEFT JOIN chosen AS c USING (front_id, family) GROUP BY 1, 2"))
def w16(spark, d):
    return P.audited_split(front_meta(spark, d), name="front_name").groupBy("family", "split").agg(F.count("*").alias("fronts"))


_NET_SQL = """once AS (SELECT technique, src, dst, avg(w) AS w FROM edge_lists GROUP BY 1, 2, 3),
n1 AS (SELECT net_id, technique, weight / CASE WHEN abs(sum(weight) OVER (PARTITION BY net_id) - 1) > 1e-3 THEN sum(weight) OVER (PARTITION BY net_id) ELSE 1 END AS weight FROM candidate_weights WHERE weight > 0),
cons AS (SELECT net_id, src, dst, sum(weight * once.w) AS w FROM n1 JOIN once USING (technique) GROUP BY 1, 2, 3)"""


@query("n18_whole_data", _with(X.EDGES, X.WEIGHTS, _NET_SQL, *_C, """e AS (SELECT front_id, round(avg(value), 4) AS expr_global_mean, count(DISTINCT gene) AS expr_global_n_genes FROM cells GROUP BY 1),
k AS (SELECT c.net_id, count(*) AS grn_n_edges, round(sum(c.w), 5) AS grn_total_w, round(sum(CASE WHEN r.w IS NULL THEN 0 ELSE least(c.w, r.w) END) / sum(c.w), 5) AS grn_reciprocity FROM cons c LEFT JOIN cons r ON c.net_id = r.net_id AND c.src = r.dst AND c.dst = r.src GROUP BY 1)""")
+ "SELECT net_id // 100 % 5 AS front_id, net_id, expr_global_mean, expr_global_n_genes, grn_n_edges, grn_reciprocity, grn_total_w FROM (SELECT DISTINCT net_id FROM candidate_weights) LEFT JOIN k USING (net_id) LEFT JOIN e ON e.front_id = net_id // 100 % 5")
def n18_whole(spark, d):
    """Candidates with the features of their consensus networks and of their front's expression matrix."""
    w = X.candidate_weights(spark, d)
    candidates = w.select((F.floor(F.col("net_id") / 100) % 5).alias("front_id"), "net_id").distinct()
    made = N.build_data(candidates, w, X.edge_lists(spark, d), E.expression_features(cells(spark, d), ("global",)))
    rounded = {"expr_global_mean": 4, "grn_total_w": 5, "grn_reciprocity": 5}
    return made.select("front_id", "net_id", "expr_global_n_genes", "grn_n_edges", *[F.round(c, n).alias(c) for c, n in rounded.items()])


def _joined(parts: dict[str, str], key: str, prefix: str) -> str:
    """The SQL of several feature blocks side by side."""
    made = [f"(SELECT {key}, COLUMNS(* EXCLUDE ({key})) AS '{prefix.format(name)}\\0' FROM ({ORACLE_SQL[q]}))" for name, q in parts.items()]
    return "SELECT * FROM " + " JOIN ".join(m if i == 0 else f"{m} USING ({key})" for i, m in enumerate(made))


ORACLE_SQL["e10_expression_features"] = _joined({"global": "e1_global", "gene": "e2_gene", "condition": "e3_condition", "gene_r": "e4_gene_correlation", "cond_r": "e4_condition_correlation", "time": "e9_time"}, "front_id", "expr_{}_")
ORACLE_SQL["n13_whole_paths"] = ORACLE_SQL["n13_path_features"].replace(_HEAVY, _WHOLE_PATHS)
ORACLE_SQL["n17_network_features"] = _joined({"global": "n4_global", "strength": "n8_strength_features", "assortativity": "n9_assortativity", "reciprocity": "n10_reciprocity", "clustering": "n11_clustering", "entropy": "n16_entropies", "paths": "n13_whole_paths"}, "net_id", "grn_")

# ---- catalogs of columns, over the values that the columns hold

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_CAT = "cat AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS position, count({c}) AS n_values, count(try_cast({c}::VARCHAR AS DOUBLE)) AS n_numbers FROM lineitem" for i, c in enumerate(_LINE)) + ")"
_RULES = [("keys", None, "l_order"), ("keys", "l_partkey", None), ("money", "l_tax", None), ("money", None, "l_ex"), ("flags", None, "l_re"), ("flags", "l_tax", None)]
_B = """b AS (SELECT block, "column", position, n_values FROM cat JOIN (VALUES ('keys', 'l_orderkey'), ('keys', 'l_partkey'), ('money', 'l_extendedprice'), ('money', 'l_tax'), ('flags', 'l_tax'), ('flags', 'l_returnflag')) r(block, "column") USING ("column"))"""


def _catalog(spark, d):
    return P.catalog(X.table(spark, d, "lineitem").select(*_LINE))


def _blocks(spark, d):
    """Feature blocks of lineitem's columns, with the number of values that each column holds."""
    found = _catalog(spark, d)
    blocks = P.resolved_blocks(found, spark.createDataFrame(_RULES, "block string, column string, prefix string"))
    return blocks.join(found.select("column", "n_values"), "column")


@query("p3_column_kinds", _with(_CAT) + "SELECT CASE \"column\" WHEN 'l_orderkey' THEN 'control' WHEN 'l_tax' THEN 'target' ELSE 'objective_or_metadata' END AS kind, count(*) AS columns, sum(n_values)::BIGINT AS n_values, sum(n_numbers)::BIGINT AS n_numbers FROM cat GROUP BY 1")
def p3(spark, d):
    kinds = P.classified(_catalog(spark, d), ["l_orderkey"], "l_tax")
    return kinds.groupBy("kind").agg(F.count("*").alias("columns"), F.sum("n_values").alias("n_values"), F.sum("n_numbers").alias("n_numbers"))


@query("p4_feature_blocks", _with(_CAT, _B) + "SELECT block, \"column\", n_values FROM b")
def p4(spark, d):
    return _blocks(spark, d).select("block", "column", "n_values")


@query("s26_shared_columns", _with(_CAT, _B) + "SELECT \"column\", count(*) AS n_blocks, max(n_values) AS n_values FROM b GROUP BY 1 HAVING count(*) > 1")
def s26(spark, d):
    b = _blocks(spark, d)
    return P.shared_columns(b).select("column", "n_blocks").join(b.select("column", "n_values").distinct(), "column")


_SETS = [("full", "keys"), ("full", "money"), ("lean", "keys"), ("extra", "flags")]
_S = """s AS (SELECT DISTINCT feature_set, "column", position, n_values FROM b JOIN (VALUES ('full', 'keys'), ('full', 'money'), ('lean', 'keys'), ('extra', 'flags')) t(feature_set, block) USING (block))"""


def _sets(spark, d):
    b = _blocks(spark, d)
    found = P.resolved_sets(b, spark.createDataFrame(_SETS, "feature_set string, block string"))
    size = found.select("feature_set", F.explode("columns").alias("column")).join(b.select("column", "n_values").distinct(), "column")
    return found.join(size.groupBy("feature_set").agg(F.sum("n_values").alias("n_values")), "feature_set")


@query("p5_feature_sets", _with(_CAT, _B, _S) + "SELECT feature_set, string_agg(\"column\", ',' ORDER BY position) AS columns, sum(n_values)::BIGINT AS n_values FROM s GROUP BY 1")
def p5(spark, d):
    return _sets(spark, d).withColumn("columns", F.array_join("columns", ","))


@query("p6_ablation_order", _with(_CAT, _B, _S) + "SELECT feature_set, CASE feature_set WHEN 'full' THEN 1 WHEN 'lean' THEN 2 ELSE 3 END AS \"order\", sum(n_values)::BIGINT AS n_values FROM s GROUP BY 1")
def p6(spark, d):
    sets = _sets(spark, d)
    return P.ordered_sets(sets, ["full", "lean"]).join(sets.select("feature_set", "n_values"), "feature_set")


@query("p26_direction_faults", _with(_CAT, "o(objective, direction) AS (VALUES ('l_tax', 'minimize'), ('l_discount', 'up'), ('l_weight', 'maximize'), ('l_returnflag', 'minimize'))")
+ """SELECT objective, 'no such column' AS fault, 0::BIGINT AS n_values FROM o WHERE objective NOT IN (SELECT "column" FROM cat)
UNION ALL SELECT objective, 'unknown direction', n_values FROM o JOIN cat ON "column" = objective WHERE direction NOT IN ('minimize', 'maximize')
UNION ALL SELECT objective, 'no numbers', n_values FROM o JOIN cat ON "column" = objective WHERE n_numbers = 0""")
def p26(spark, d):
    found = _catalog(spark, d)
    objectives = spark.createDataFrame([("l_tax", "minimize"), ("l_discount", "up"), ("l_weight", "maximize"), ("l_returnflag", "minimize")], "objective string, direction string")
    faults = D.direction_faults(objectives, found).unionByName(objectives.join(found.filter("n_numbers = 0"), F.col("objective") == F.col("column"), "left_semi").select("objective", F.lit("no numbers").alias("fault")))
    known = found.select(F.col("column").alias("objective"), "n_values")
    return faults.join(known, "objective", "left").select("objective", "fault", F.coalesce("n_values", F.lit(0)).alias("n_values"))


@query("p28_ranked_faults", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL) AS texts FROM lineitem" for c in ("l_discount", "l_returnflag", "l_quantity")))
def p28(spark, d):
    return T.ranked_faults(X.table(spark, d, "lineitem"), ["l_discount", "l_returnflag", "l_quantity"])


@query("p29_one_front", """SELECT o_orderpriority || '-' || o_custkey AS "case", CASE WHEN k > 1 THEN 'several fronts' END AS fault FROM (SELECT o_orderpriority, o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1, 2) WHERE k > 1
UNION ALL SELECT o_orderpriority || '-' || o_custkey, 'no price' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice < 2000) > 0""")
def p29(spark, d):
    o = X.table(spark, d, "orders")
    cases = o.select(F.concat("o_orderpriority", F.lit("-"), F.col("o_custkey").cast("string")).alias("case"), F.col("o_orderstatus").alias("front_id"), F.when(F.col("o_totalprice") >= 2000, F.col("o_totalprice")).alias("price"))
    return D.case_faults(cases, "case", ["price"])
