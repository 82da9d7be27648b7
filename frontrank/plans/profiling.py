"""Queries on expression matrices, splits, contracts, evidence, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from frontrank.functions import half_up, lenient, or_unknown, p_class, p_label, row_fingerprint, split_key
from frontrank.operators import evidence as V
from frontrank.operators import expression as E
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.plans import fixtures as X
from frontrank.plans.comparing import networks, values
from frontrank.plans.ranking import _with
from frontrank.plans.registry import half_sql, query, r6
from frontrank.sources import tables as T

# ---- expression

_CELLS = """cells AS (SELECT g.front_id, g.gene, c.cond, m.value FROM (SELECT DISTINCT front_id, gene FROM matrix) g
JOIN (SELECT DISTINCT front_id, cond FROM matrix) c USING (front_id) LEFT JOIN matrix m ON m.front_id = g.front_id AND m.gene = g.gene AND m.cond = c.cond)"""
_C = (X.MATRIX, _CELLS)


def cells(spark, d):
    return E.complete(X.matrix(spark, d))


def r4(df):
    return df.withColumns({c: F.round(c, 4) for c, kind in df.dtypes if kind == "double"})


@query("e1_global", _with(*_C) + """SELECT front_id, count(DISTINCT gene) AS n_genes, count(DISTINCT cond) AS n_conditions, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(count(*) FILTER (value IS NULL) / count(*), 4) AS missing, round(count(*) FILTER (value = 0) / count(*), 4) AS zeros, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurtosis FROM cells GROUP BY 1""")
def e1(spark, d):
    return r4(E.global_features(cells(spark, d)))


def _per(key: str) -> str:
    return f"""per AS (SELECT front_id, {key}, avg(value) AS mean, stddev_pop(value) AS std, count(*) FILTER (value = 0) / count(*) AS zeros, count(*) FILTER (value IS NULL) / count(*) AS missing FROM cells GROUP BY 1, 2),
p AS (SELECT *, std / (nullif(mean, 0) + 1e-12) AS cv, abs((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0)) AS z FROM per WINDOW w AS (PARTITION BY front_id))"""


_FIVE = ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 4) AS {c}_p{q}" for q in (10, 50, 90)) for c in ("mean", "std", "cv", "zeros", "missing"))


@query("e2_gene", _with(*_C, _per("gene")) + f"SELECT front_id, {_FIVE} FROM p GROUP BY 1")
def e2(spark, d):
    return r4(E.gene_features(cells(spark, d)))


@query("e3_condition", _with(*_C, _per("cond")) + f"SELECT front_id, {_FIVE}, round(max(z), 4) AS max_z FROM p GROUP BY 1")
def e3(spark, d):
    return r4(E.condition_features(cells(spark, d)))


def _pairs(key: str, other: str) -> str:
    return f"""r AS (SELECT a.front_id, a.{key} AS a, b.{key} AS b, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r
FROM matrix a JOIN matrix b ON a.front_id = b.front_id AND a.{other} = b.{other} AND a.{key} < b.{key} GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


for _id, _key, _other in (("e4_gene_correlation", "gene", "cond"), ("e4_condition_correlation", "cond", "gene")):

    @query(_id, _with(X.MATRIX, _pairs(_key, _other)) + f"SELECT front_id, round(avg(r), 4) AS {_key}_r_mean, round(stddev_pop(r), 4) AS {_key}_r_std, round(avg(abs(r)), 4) AS {_key}_r_abs_mean, round(quantile_cont(abs(r), 0.9), 4) AS {_key}_r_abs_p90 FROM r WHERE r IS NOT NULL GROUP BY 1")
    def _corr(spark, d, key=_key):
        return r4(E.correlation_features(cells(spark, d), key))


@query("j13_pairwise_correlation", _with(X.MATRIX, _pairs("cond", "gene")) + "SELECT front_id, a, b, round(r, 4) AS r FROM r WHERE r IS NOT NULL")
def j13(spark, d):
    return r4(E.correlations(cells(spark, d), "cond"))


@query("e5_pca")
def e5(spark, d):
    return E.pca_features(E.exploded_vectors(X.table(spark, d, "embeddings"), "vec_id", "embedding"))


@query("e5_trace", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT i, v - avg(v) OVER (PARTITION BY i) AS c FROM v), d AS (SELECT i, sum(c * c) AS s FROM c GROUP BY 1)
SELECT 0::BIGINT AS front_id, count(*) AS axes, round(sum(s), 4) AS trace, TRUE AS first_holds_largest, TRUE AS first_under_trace FROM d""")
def e5_trace(spark, d):
    """The eigenvalues add up to the variance; the first is at least the largest variance of a column and at most all of it."""
    found = E.exploded_vectors(X.table(spark, d, "embeddings"), "vec_id", "embedding")
    total = E.spectrum(found).groupBy("front_id").agg(F.count("*").alias("axes"), F.sum("eigenvalue").alias("sum"), F.max("eigenvalue").alias("first"))
    widest = found.groupBy("front_id", "cond").agg((F.var_pop("value") * F.count("value")).alias("v")).groupBy("front_id").agg(F.max("v").alias("v"))
    return total.join(widest, "front_id").select("front_id", "axes", F.round("sum", 4).alias("trace"), (F.col("first") >= F.col("v") * (1 - 1e-9)).alias("first_holds_largest"), (F.col("first") <= F.col("sum") * (1 + 1e-9)).alias("first_under_trace"))


@query("e6_effective_rank", """WITH v AS (SELECT label AS front_id, vec_id, list_sum(list_transform(embedding, lambda x: x * x))::DOUBLE AS e FROM embeddings),
p AS (SELECT front_id, e / sum(e) OVER (PARTITION BY front_id) AS p FROM v) SELECT front_id, round(exp(-sum(p * ln(p))), 3) AS effective_rank FROM p WHERE p > 0 GROUP BY 1""")
def e6(spark, d):
    v = X.table(spark, d, "embeddings").select(F.col("label").alias("front_id"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("eigenvalue"))
    return E.effective_rank(v).withColumn("effective_rank", F.round("effective_rank", 3))


_LAG = """lagged AS (SELECT front_id, gene, value AS x, lag(value) OVER (PARTITION BY front_id, gene ORDER BY cond) AS y FROM matrix),
ac AS (SELECT front_id, gene, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y) + 1e-12) AS r FROM lagged WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)"""
_TREND = """placed AS (SELECT front_id, gene, value, (row_number() OVER (PARTITION BY front_id, gene ORDER BY cond) - 1)::DOUBLE AS t FROM matrix),
tr AS (SELECT front_id, gene, regr_slope(value, t) AS slope, 1 - (regr_syy(value, t) - pow(regr_slope(value, t), 2) * regr_sxx(value, t)) / (regr_syy(value, t) + 1e-12) AS r2 FROM placed GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("e7_autocorrelation", _with(X.MATRIX, _LAG) + "SELECT front_id, gene, round(r, 4) AS r FROM ac")
def e7(spark, d):
    return r4(E.autocorrelation(cells(spark, d)))


@query("e8_trends", _with(X.MATRIX, _TREND) + "SELECT front_id, gene, round(slope, 4) AS slope, round(r2, 4) AS r2 FROM tr")
def e8(spark, d):
    return r4(E.trends(cells(spark, d)))


@query("e9_time", _with(X.MATRIX, _LAG, _TREND) + """SELECT front_id, round(avg(r), 4) AS auto_mean, round(quantile_cont(r, 0.5), 4) AS auto_median, round(avg(slope), 4) AS slope_mean, round(quantile_cont(slope, 0.9), 4) AS slope_p90,
round(avg(r2), 4) AS r2_mean, round(count(*) FILTER (slope > 0) / count(*), 4) AS rising FROM (SELECT DISTINCT front_id, gene FROM matrix) LEFT JOIN ac USING (front_id, gene) LEFT JOIN tr USING (front_id, gene) GROUP BY 1""")
def e9(spark, d):
    return r4(E.time_features(cells(spark, d)))


@query("e10_expression_features")
def e10(spark, d):
    """All blocks that SQL can say."""
    return r4(E.expression_features(cells(spark, d), [b for b in E.BLOCKS if b != "pca"]))


@query("e10_all_blocks")
def e10_all(spark, d):
    return r4(E.expression_features(cells(spark, d)))


@query("j3_attached_features", _with(*_C) + """, g AS (SELECT front_id AS block, round(avg(value), 4) AS expr_mean FROM cells GROUP BY 1)
SELECT user_id AS front_id, event_id AS item_id, expr_mean FROM events JOIN g ON g.block = user_id % 5 WHERE value IS NOT NULL""")
def j3(spark, d):
    g = cells(spark, d).groupBy("front_id").agg(F.round(F.avg("value"), 4).alias("expr_mean")).withColumnRenamed("front_id", "block")
    f = X.event_fronts(spark, d)
    return f.join(g, F.col("front_id") % 5 == F.col("block")).select("front_id", "item_id", "expr_mean")


@query("n18_build_data", _with(X.FRONTS, X.EDGES, X.WEIGHTS, """once AS (SELECT technique, src, dst, avg(w) AS w FROM edge_lists GROUP BY 1, 2, 3),
n1 AS (SELECT net_id, technique, weight / CASE WHEN abs(sum(weight) OVER (PARTITION BY net_id) - 1) > 1e-3 THEN sum(weight) OVER (PARTITION BY net_id) ELSE 1 END AS weight FROM candidate_weights WHERE weight > 0),
cons AS (SELECT net_id, src, dst, sum(weight * once.w) AS w FROM n1 JOIN once USING (technique) GROUP BY 1, 2, 3)""") + """
SELECT net_id, count(*) AS grn_n_edges, round(sum(w), 5) AS grn_total_w, round(sum(CASE WHEN i <= greatest(1, floor(n * 0.1)) THEN w ELSE 0 END) / sum(w), 5) AS grn_top_share FROM
(SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY w DESC, src, dst) AS i, count(*) OVER (PARTITION BY net_id) AS n FROM cons) GROUP BY 1""")
def n18(spark, d):
    """A front's candidates with features of their consensus networks."""
    consensus = N.consensus(X.candidate_weights(spark, d), X.edge_lists(spark, d))
    f = N.network_features(consensus, ("global", "reciprocity"))
    return f.select("net_id", "grn_n_edges", F.round("grn_total_w", 5).alias("grn_total_w"), F.round("grn_top_share", 5).alias("grn_top_share"))


# ---- names, splits, folds, contracts

_NAMED = """named AS (SELECT p_partkey AS front_id, CASE p_size % 6 WHEN 0 THEN 'InSilicoSize' || p_size || '-' || left(p_type, 3) || '1-' || p_name WHEN 1 THEN 'dream4_0' || p_size || '_02'
WHEN 2 THEN 'gnw' || p_size WHEN 3 THEN 'switch-' || p_type WHEN 4 THEN 'sim_TFLink_' || p_type || '_size-' || p_size || '_mixed' ELSE p_type || '-' || p_size || '_x' END || '_exp' AS front_name, p_size, p_type, p_name FROM part)"""


def named(spark, d):
    """Names of all families, made from parts."""
    kind = F.col("p_size") % 6
    size = F.col("p_size").cast("string")
    name = F.when(kind == 0, F.concat(F.lit("InSilicoSize"), size, F.lit("-"), F.left("p_type", F.lit(3)), F.lit("1-"), "p_name")).when(kind == 1, F.concat(F.lit("dream4_0"), size, F.lit("_02"))).when(kind == 2, F.concat(F.lit("gnw"), size))
    name = name.when(kind == 3, F.concat(F.lit("switch-"), "p_type")).when(kind == 4, F.concat(F.lit("sim_TFLink_"), "p_type", F.lit("_size-"), size, F.lit("_mixed"))).otherwise(F.concat("p_type", F.lit("-"), size, F.lit("_x")))
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("front_id"), F.concat(name, F.lit("_exp")).alias("front_name"))


@query("p7_front_names", _with(_NAMED) + """SELECT front_id, CASE p_size % 6 WHEN 0 THEN 'InSilico' WHEN 1 THEN 'dream4' WHEN 2 THEN 'gnw' WHEN 3 THEN 'switch' WHEN 4 THEN 'TFLink' ELSE p_type END AS family,
CASE p_size % 6 WHEN 0 THEN left(p_type, 3) || '1' WHEN 1 THEN 'dream4_02' WHEN 2 THEN 'gnw' WHEN 3 THEN 'switch' WHEN 4 THEN p_type || '_size-' || p_size ELSE p_type || '-' || p_size || '_x' END AS source,
CASE WHEN p_size % 6 IN (0, 1, 2, 4) THEN p_size END AS size, CASE p_size % 6 WHEN 0 THEN p_name WHEN 3 THEN p_type WHEN 4 THEN 'mixed' ELSE 'unknown' END AS condition FROM named""")
def p7(spark, d):
    return P.parsed_names(named(spark, d)).select("front_id", "family", "source", "size", "condition")


# ---- splits


@query("w12_balanced_folds", "WITH RECURSIVE " + X.FRONTS + """, s AS (SELECT front_id, count(*) AS n_items FROM fronts GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n_items DESC, substr(sha256('0:' || front_id), 1, 16), front_id) AS i FROM s),
r(i, fold, loads) AS (SELECT 0::BIGINT, -1::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT o.i, list_position(loads, list_min(loads)) - 1,
list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n_items ELSE 0 END) FROM r JOIN o ON o.i = r.i + 1)
SELECT front_id, n_items, fold::INT AS fold FROM o JOIN r USING (i)""")
def w12(spark, d):
    return P.balanced_folds(X.fronts(spark, d))


_QUOTA = """sz AS (SELECT family, count(*) AS n FROM families GROUP BY 1),
t AS (SELECT sum(n) AS total, least(round_even(sum(n) * 0.2, 0), greatest(sum(n) - 1, 0)) AS want FROM sz),
b AS (SELECT family, n, want, (n > 1)::INT AS low, greatest(n - 1, 0) AS high, n * want / total - floor(n * want / total) AS rest, least(greatest(floor(n * want / total), (n > 1)::INT), greatest(n - 1, 0)) AS quota, substr(sha256('0:' || family), 1, 16) AS tie FROM sz, t),
w AS (SELECT *, want - sum(quota) OVER () AS lack FROM b),
q AS (SELECT family, n, (quota + CASE WHEN lack >= 0 THEN greatest(least(lack - coalesce(sum(high - quota) OVER (ORDER BY rest DESC, tie, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), high - quota), 0)
ELSE -greatest(least(-lack - coalesce(sum(quota - low) OVER (ORDER BY rest, tie DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), quota - low), 0) END)::BIGINT AS quota FROM w)"""
#: Plain greedy: a step for each front of the largest quota.
_GREEDY = """g AS (SELECT family, 0 AS turn, []::BIGINT[] AS ids, []::VARCHAR[] AS sizes, []::VARCHAR[] AS conditions, []::VARCHAR[] AS sources FROM q
UNION ALL SELECT family, turn + 1, list_append(ids, b.front_id), list_append(sizes, b.size), list_append(conditions, b.condition), list_append(sources, b.source) FROM (
SELECT g.family, any_value(g.turn) AS turn, any_value(ids) AS ids, any_value(sizes) AS sizes, any_value(conditions) AS conditions, any_value(sources) AS sources,
arg_min({'front_id': f.front_id, 'size': f.size, 'condition': f.condition, 'source': f.source},
{'s': -(8 * (NOT list_contains(sizes, f.size))::INT + 4 * (NOT list_contains(conditions, f.condition))::INT + 2 * (NOT list_contains(sources, f.source))::INT), 'k': f.key, 'i': f.front_id}) AS b
FROM g JOIN q USING (family) JOIN f USING (family) WHERE g.turn < q.quota AND NOT list_contains(ids, f.front_id) GROUP BY g.family)),
chosen AS (SELECT family, unnest(ids) AS front_id, generate_subscripts(ids, 1) AS turn FROM g JOIN q USING (family) WHERE turn = quota)"""
_FRONT_META = """families AS (SELECT p_partkey AS front_id, substr(p_brand, 1, 7) AS family, p_size AS size, p_type AS condition, split_part(p_name, ' ', 1) AS source, p_name AS front_name FROM part),
f AS (SELECT front_id, family, coalesce(size::VARCHAR, 'unknown') AS size, coalesce(condition, 'unknown') AS condition, coalesce(source, 'unknown') AS source, substr(sha256('42:' || front_name), 1, 16) AS key FROM families)"""


def _recursive(last):
    return f"WITH RECURSIVE {_FRONT_META}, {_QUOTA}, {_GREEDY} {last}"


def front_meta(spark, d):
    """Parts as fronts with a name, of some five families."""
    p = X.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("front_id"), F.substring("p_brand", 1, 7).alias("family"), F.col("p_size").alias("size"), F.col("p_type").alias("condition"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("source"), F.col("p_name").alias("front_name"))


@query("w13_test_quotas", _with(X.FAMILIES, _QUOTA) + "SELECT family, n, quota FROM q")
def w13(spark, d):
    return P.test_quotas(X.families(spark, d))


@query("w15_assigned_splits", _recursive("SELECT front_id, family, CASE WHEN c.turn IS NULL THEN 'development' ELSE 'test' END AS split FROM families LEFT JOIN chosen AS c USING (front_id, family)"))
def w15(spark, d):
    f = front_meta(spark, d)
    return P.assigned(f, P.diverse_test_fronts(f, P.test_quotas(f), name="front_name")).select("front_id", "family", "split")


@query("w14_diverse_fronts", _recursive("SELECT front_id, family, turn FROM chosen"))
def w14(spark, d):
    f = front_meta(spark, d)
    return P.diverse_test_fronts(f, P.test_quotas(f), name="front_name")


_SPLIT = "splits AS (SELECT front_id, family, size, CASE WHEN substr(sha256('7:' || front_id), 1, 1) < '3' THEN 'test' ELSE 'development' END AS split FROM families)"


def splits(spark, d):
    return X.families(spark, d).withColumn("split", F.when(F.substring(split_key(7, F.col("front_id")), 1, 1) < "3", "test").otherwise("development"))


@query("p33_split_key", _with(X.FAMILIES) + "SELECT front_id, substr(sha256('7:' || front_id), 1, 16) AS split_key FROM families")
def p33(spark, d):
    return X.families(spark, d).select("front_id", split_key(7, F.col("front_id")).alias("split_key"))


@query("p10_test_rows", _with(X.FRONTS, X.FAMILIES, _SPLIT) + "SELECT front_id, item_id FROM fronts JOIN splits USING (front_id) WHERE split = 'test'")
def p10(spark, d):
    return P.with_split(X.fronts(spark, d), splits(spark, d)).filter("split = 'test'").select("front_id", "item_id")


@query("j5_with_split", _with(X.FRONTS, X.FAMILIES, _SPLIT) + "SELECT split, count(*) AS n, count(DISTINCT front_id) AS fronts FROM fronts LEFT JOIN splits USING (front_id) GROUP BY 1")
def j5(spark, d):
    return P.with_split(X.fronts(spark, d), splits(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("front_id").alias("fronts"))


@query("j10_unmatched_fronts", """SELECT o_custkey AS front_id, 'data' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1
UNION ALL SELECT c_custkey, 'manifest' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j10(spark, d):
    return P.unmatched_fronts(X.table(spark, d, "orders").withColumnRenamed("o_custkey", "front_id"), X.table(spark, d, "customer").withColumnRenamed("c_custkey", "front_id"))


@query("j12_moved_fronts", _with(X.FAMILIES, _SPLIT) + """, b AS (SELECT front_id, CASE WHEN size > 40 THEN 'test' ELSE 'development' END AS split FROM families WHERE size <> 7)
SELECT coalesce(s.front_id, b.front_id) AS front_name, s.split AS split_a, b.split AS split_b FROM splits s FULL JOIN b USING (front_id) WHERE s.split IS DISTINCT FROM b.split""")
def j12(spark, d):
    a = splits(spark, d).withColumnRenamed("front_id", "front_name")
    b = a.filter("size <> 7").withColumn("split", F.when(F.col("size") > 40, "test").otherwise("development"))
    return P.moved_fronts(a, b)


@query("s22_split_summary", _with(X.FAMILIES, _SPLIT) + "SELECT coalesce(family, '__TOTAL__') AS family, split, count(*) AS fronts, sum(size)::BIGINT AS items FROM splits GROUP BY GROUPING SETS ((family, split), (split))")
def s22(spark, d):
    return P.split_summary(splits(spark, d).withColumn("n_items", F.col("size")))


@query("s23_split_crosstab", _with(X.FAMILIES, _SPLIT) + "SELECT family, count(*) FILTER (split = 'development') AS development, count(*) FILTER (split = 'test') AS test FROM splits GROUP BY 1")
def s23(spark, d):
    return P.split_crosstab(splits(spark, d))


@query("s24_target_summary", _with(X.FRONTS) + "SELECT count(*) AS n, round(min(target), 6) AS low, round(max(target), 6) AS high, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std FROM fronts")
def s24(spark, d):
    return r6(X.fronts(spark, d).agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"), F.avg("target").alias("mean"), F.stddev_pop("target").alias("std")))


@query("s27_small_fronts", "SELECT o_custkey AS front_id, count(*) AS n_items FROM orders GROUP BY 1 HAVING count(*) < 8")
def s27(spark, d):
    return P.small_fronts(X.table(spark, d, "orders").withColumnRenamed("o_custkey", "front_id"), 8)


@query("a11_split_faults", _with(X.FAMILIES) + """, s AS (SELECT front_id % 500 AS front_id, CASE WHEN size < 5 THEN 'none' WHEN size < 20 THEN 'test' ELSE 'development' END AS split FROM families),
p AS (SELECT front_id, count(*) AS n, count(DISTINCT split) AS k, count(*) FILTER (split = 'none') AS odd FROM s GROUP BY 1)
SELECT front_id, 'repeated' AS fault FROM p WHERE n > 1 UNION ALL SELECT front_id, 'several splits' FROM p WHERE k > 1 UNION ALL SELECT front_id, 'unknown split' FROM p WHERE odd > 0""")
def a11(spark, d):
    split = F.when(F.col("size") < 5, "none").when(F.col("size") < 20, "test").otherwise("development")
    return T.split_faults(X.families(spark, d).select((F.col("front_id") % 500).alias("front_id"), split.alias("split")))


@query("s25_contract_faults", """WITH have AS (SELECT column_name AS c FROM (DESCRIBE SELECT l_tax, l_quantity, l_returnflag, l_shipdate FROM lineitem)),
want AS (SELECT unnest(['l_quantity', 'l_returnflag', 'l_weight']) AS c), cells AS (SELECT unnest(['l_quantity', 'l_returnflag']) AS c, unnest([l_quantity::VARCHAR, l_returnflag::VARCHAR]) AS v FROM lineitem)
SELECT c AS "column", 'missing' AS fault FROM want WHERE c NOT IN (SELECT c FROM have) UNION ALL SELECT c, 'forbidden' FROM have WHERE c = 'l_tax' UNION ALL SELECT c, 'unassigned' FROM have WHERE c NOT IN ('l_tax', 'l_quantity', 'l_returnflag')
UNION ALL SELECT c, 'not numeric' FROM cells GROUP BY 1 HAVING count(*) FILTER (v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) > 0
UNION ALL SELECT c, 'null' FROM cells GROUP BY 1 HAVING count(*) FILTER (v IS NULL) > 0 UNION ALL SELECT c, 'constant' FROM cells GROUP BY 1 HAVING min(v) IS NOT DISTINCT FROM max(v)""")
def s25(spark, d):
    df = X.table(spark, d, "lineitem").select("l_tax", "l_quantity", "l_returnflag", "l_shipdate")
    return P.contract_faults(df, ["l_quantity", "l_returnflag", "l_weight"], ["l_tax"], ["l_tax", "l_quantity", "l_returnflag"])


# ---- scalar functions over text columns


@query("p9_lenient_numbers", "SELECT count(*) AS n, count(try_cast(event_type AS DOUBLE)) AS kinds, round(sum(try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE)), 3) AS total FROM events")
def p9(spark, d):
    e = X.table(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.count(lenient("event_type")).alias("kinds"), F.round(F.sum(lenient(F.regexp_extract("props", "[0-9]+", 0))), 3).alias("total"))


@query("p15_symbols", "SELECT DISTINCT coalesce(upper(trim(p_name)), '') AS symbol FROM part WHERE coalesce(upper(trim(p_name)), '') <> ''")
def p15(spark, d):
    return V.universe(X.table(spark, d, "part"), "p_name")


@query("p24_p_labels", """WITH p AS (SELECT l_partkey, avg(l_tax) AS p FROM lineitem GROUP BY 1) SELECT l_partkey AS front_id, CASE WHEN p < 0.05 THEN 'significant' ELSE 'not_significant' END AS class,
CASE WHEN round(p, 6) < 0.001 THEN 'p<0.001' ELSE printf('p=%.1f', round(p, 1)) END AS label FROM p WHERE abs(p - 0.05) > 1e-9""")
def p24(spark, d):
    p = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("front_id")).agg(F.avg("l_tax").alias("p")).filter(F.abs(F.col("p") - 0.05) > 1e-9)
    label = F.when(F.round("p", 6) < 0.001, p_label(F.round("p", 6))).otherwise(F.format_string("p=%.1f", F.round("p", 1)))
    return p.select("front_id", p_class(F.col("p")).alias("class"), label.alias("label"))


@query("p34_or_unknown", "SELECT coalesce(nullif(o_orderstatus, 'F'), 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1")
def p34(spark, d):
    return X.table(spark, d, "orders").groupBy(or_unknown(F.nullif("o_orderstatus", F.lit("F"))).alias("status")).agg(F.count("*").alias("n"))


@query("p32_row_fingerprint_md5", "SELECT o_orderkey, md5(coalesce(o_orderkey::VARCHAR, '<NA>') || '|' || coalesce(o_custkey::VARCHAR, '<NA>') || '|' || coalesce(o_orderstatus, '<NA>')) AS fingerprint FROM orders")
def p32_md5(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", row_fingerprint("o_orderkey", "o_custkey", "o_orderstatus", hashed="md5").alias("fingerprint"))


@query("p32_row_fingerprint")
def p32(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", row_fingerprint("o_orderkey", "o_custkey", "o_totalprice").alias("fingerprint"))


# ---- evidence

_EV = "ev AS (SELECT DISTINCT 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS source, 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_discount >= 0.08 AND l_quantity > 48 AND s_nationkey <> c_nationkey)"


def evidence(spark, d):
    """Pairs of nations with large, heavily discounted trade, as evidence rows of two resources."""
    line = X.table(spark, d, "lineitem").filter("l_discount >= 0.08 AND l_quantity > 48")
    s, o, c = (X.table(spark, d, t) for t in ("supplier", "orders", "customer"))
    joined = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = lambda x: F.concat(F.lit(" n"), F.lpad(F.col(x).cast("string"), 2, "0"))
    raw = joined.select(name("s_nationkey").alias("source"), name("c_nationkey").alias("target"), F.lit("up").alias("mode"), F.lit("1").alias("pmid")).distinct()
    genes = V.universe(raw.select(F.col("source").alias("gene_symbol")).union(raw.select("target")))
    return V.normalized([V.curated(raw, "trade"), V.curated(raw, "ledger")], genes)


@query("s30_evidence", _with(_EV) + "SELECT source, target, r AS resource FROM ev, (VALUES ('trade'), ('ledger')) t(r)")
def s30(spark, d):
    return evidence(spark, d).select("source", "target", "resource")


_RANKED = (X.EDGES, "g AS (SELECT technique AS method, src, dst, row_number() OVER (PARTITION BY technique ORDER BY round(w, 9) DESC, src, dst) AS edge_rank FROM edge_lists)")


def ranked(spark, d):
    return N.ranked_edges(networks(spark, d).withColumn("w", F.round("w", 9))).withColumnRenamed("net_id", "method")


@query("s28_support", _with(*_RANKED, _EV) + """SELECT method, count(*) FILTER ((src, dst) IN (SELECT (source, target) FROM ev)) AS pairs, count(*) FILTER (src IN (SELECT source FROM ev)) AS sources, count(*) AS edges, 100 AS cutoff,
round(count(*) FILTER ((src, dst) IN (SELECT (source, target) FROM ev)) / 100, 6) AS pair_rate, round(count(*) FILTER (src IN (SELECT source FROM ev)) / 100, 6) AS source_rate FROM g WHERE edge_rank <= 100 GROUP BY 1""")
def s28(spark, d):
    return r6(V.support(ranked(spark, d), evidence(spark, d), 100))


@query("s29_frequent_sources", _with(*_RANKED) + "SELECT src, count(*) AS n FROM g WHERE edge_rank <= 200 GROUP BY 1 ORDER BY n DESC, src LIMIT 10")
def s29(spark, d):
    return V.frequent_sources(ranked(spark, d), 200, 10)


@query("p17_resources", "SELECT DISTINCT props, CASE WHEN contains(upper(props), 'K') THEN 'k' ELSE '' END || CASE WHEN contains(props, '9') THEN ',9' ELSE '' END AS tags FROM events")
def p17(spark, d):
    return X.table(spark, d, "events").select("props", F.array_join(V.resources(F.col("props"), {"k": "k", "9": "9"}), ",").alias("tags")).distinct()


@query("a15_gene_sets", "WITH w AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b FROM part) SELECT a AS source, b AS target FROM w WHERE a <> b AND b <> ''")
def a15(spark, d):
    """Part names as gene-set lines: a term, a description and a target."""
    p = X.table(spark, d, "part").select(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    path = T.fresh_path(spark, "sets")
    p.select(F.concat_ws("\t", F.concat("a", F.lit(" (set)")), F.lit("of"), "b").alias("value")).write.text(path)
    genes = V.universe(p.select(F.col("a").alias("gene_symbol")).union(p.select("b")))
    return V.gene_sets(V.read_gene_sets(spark, path), genes, "names").select("source", "target").distinct()


@query("p16_term_factors", "SELECT DISTINCT p_name, upper(split_part(p_name, ' ', 1)) || '/X' AS factors FROM part")
def p16(spark, d):
    p = X.table(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", F.array_join(V.term_factors(F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("(a)::x/X "), F.col("p_name"))), "/").alias("factors"))


@query("a16_factor_scores", "SELECT upper(o_orderstatus) AS source, upper(trim(o_orderpriority)) AS target, count(*) AS n, round(sum(greatest(o_totalprice - 200000, o_custkey - 10)), 2) AS total FROM orders WHERE greatest(o_totalprice - 200000, o_custkey - 10) > 0 GROUP BY 1, 2")
def a16(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderstatus").alias("factor"), F.col("o_orderpriority").alias("target"), (F.col("o_totalprice") - 200000).cast("string").alias("score_a"), (F.col("o_custkey") - 10).cast("string").alias("score_b"))
    return V.factor_scores(o, "orders").groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.sum(F.col("confidence").cast("double")), 2).alias("total"))


# ---- readers and writers, on data that Spark writes from the given tables


@query("a1_front_table", _with(X.FRONTS) + "SELECT front_id, item_id, round(target, 6) AS target, price FROM fronts")
def a1(spark, d):
    path = T.fresh_path(spark, "fronts")
    T.write_table(X.fronts(spark, d).select("front_id", "item_id", "target", "price"), path, kind="csv")
    return r6(T.read_fronts(spark, path, "front_id long, item_id long, target double, price double"))


@query("a2_expression_matrix", _with(X.MATRIX) + "SELECT gene::VARCHAR AS gene, 'd' || cond AS cond, value FROM matrix")
def a2(spark, d):
    path, names = T.fresh_path(spark, "matrix"), [f"d{i}" for i in range(1, 32)]
    wide = X.matrix(spark, d).withColumn("cond", F.concat(F.lit("d"), "cond")).groupBy("gene").pivot("cond", names).agg(F.first("value"))
    T.write_table(wide, path, kind="csv")
    return T.read_expression(spark, path, names).filter("value IS NOT NULL")


@query("a3_edge_folder", _with(X.EDGES) + "SELECT technique, src, dst, round(w, 6) AS w FROM edge_lists")
def a3(spark, d):
    path = T.fresh_path(spark, "edges")
    T.write_edge_folder(X.edge_lists(spark, d), path)
    return r6(T.read_edge_folder(spark, path, ["A", "N", "R"]).select("technique", "src", "dst", "w"))


def _reports(spark, d):
    path = T.fresh_path(spark, "reports")
    v = values(spark, d).select(F.col("method").alias("model"), (F.col("front_id") % 3).cast("int").alias("fold"), "front_id", "metric", "value")
    T.write_reports(v, path)
    return T.read_reports(spark, path)


def _vsql(select: str) -> str:
    from frontrank.plans.ranking import RULE_METRICS

    return _with(*RULE_METRICS, "v AS (SELECT rule AS model, (front_id % 3)::INT AS fold, front_id, metric, round(value, 9) AS value FROM methods)") + select


@query("a5_fold_reports", _vsql("SELECT model, fold, metric, round(avg(value), 5) AS value FROM v GROUP BY 1, 2, 3"))
def a5(spark, d):
    return T.fold_metrics(_reports(spark, d)).withColumn("value", F.round("value", 5))


@query("a6_group_reports", _vsql(f"SELECT model, fold, front_id, metric, {half_sql('value', 6)} AS value FROM v"))
def a6(spark, d):
    return T.group_metrics(_reports(spark, d)).withColumn("value", half_up("value", 6))


@query("a7_averaged_groups", _vsql(f"SELECT model, front_id, metric, {half_sql('avg(value)', 6)} AS value FROM v GROUP BY 1, 2, 3"))
def a7(spark, d):
    return T.averaged_groups(_reports(spark, d)).withColumn("value", half_up("value", 6))


@query("a21_json_clean", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def a21(spark, d):
    odd = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return T.json_clean(X.table(spark, d, "orders").select("o_orderkey", odd.alias("o_totalprice")))


@query("a23_fingerprint", "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM orders")
def a23(spark, d):
    return T.fingerprint(X.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("p1_features", _with(X.FRONTS) + "SELECT front_id, item_id, round(target, 6) AS target, price, discount FROM fronts")
def p1(spark, d):
    return r6(T.features(X.fronts(spark, d), drop=["tax", "quantity", "score"]))


@query("p2_aligned_features", _with(X.FRONTS) + "SELECT front_id, item_id, tax, price FROM fronts")
def p2(spark, d):
    return T.aligned(X.fronts(spark, d), ["tax", "price"])


@query("t9_preferred_rows", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def t9(spark, d):
    return T.first_of(X.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


