"""Statistics, networks, splits, evidence and storage on small frames."""

import math

import pytest

from frontrank.operators import evidence as V
from frontrank.operators import expression as E
from frontrank.operators import figures as G
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.operators import stats as S
from frontrank.sources import tables as T


def test_friedman_winner_and_tests(spark):
    rows = [("Regret@5", f, m, float(v)) for f in range(1, 5) for m, v in (("A", 1), ("B", 2), ("C", 3))]
    got = {r["method"]: r for r in S.rank_tests(spark.createDataFrame(rows, "metric string, front_id long, method string, value double")).collect()}
    assert got["A"]["winner"] == "A" and got["A"]["p"] is None and got["A"]["friedman"] == pytest.approx(8.0)
    assert got["A"]["friedman_p"] == pytest.approx(math.exp(-4))
    z = 1 / math.sqrt(3 * 4 / (6 * 4))
    assert got["B"]["z"] == pytest.approx(z) and got["B"]["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got["C"]["p_holm"] == pytest.approx(2 * math.erfc(2 * z / math.sqrt(2)))


def test_only_common_fronts(spark):
    df = spark.createDataFrame([("m", 1, "A", 1.0), ("m", 2, "A", 1.0), ("m", 2, "B", 2.0), ("m", 3, "B", 1.0)], "metric string, front_id long, method string, value double")
    assert {r["front_id"] for r in S.paired(df).collect()} == {2}


def test_chi_square_tail_matches_known_values():
    assert S._chi_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert S._chi_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert S._chi_tail(9.487729036781154, 4) == pytest.approx(0.05)


def test_consensus_weights_and_repeats(spark):
    base = spark.createDataFrame([("A", "x", "y", 0.5), ("A", "x", "y", 1.0), ("B", "x", "y", 0.0), ("B", "y", "x", 0.6)], "technique string, src string, dst string, w double")
    weights = spark.createDataFrame([(1, "A", 2.0), (1, "B", 1.0), (1, "C", 0.0)], "net_id long, technique string, weight double")
    got = {(r["src"], r["dst"]): r["w"] for r in N.consensus(weights, base).collect()}
    assert got == {("x", "y"): pytest.approx(2 / 3 * 0.75), ("y", "x"): pytest.approx(0.2)}


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 0.5), (1, "c", "a", 1.0), (1, "c", "d", 1.0), (2, "x", "y", 1.0)], "net_id long, src string, dst string, w double")
    found = {(r["net_id"], r["node"]): r["component"] for r in N.strong_components(edges).collect()}
    assert found == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (2, "x"): "x", (2, "y"): "y"}
    d = {(r["src"], r["dst"]): r["d"] for r in N.shortest_paths(edges.filter("net_id = 1")).collect()}
    assert d["a", "c"] == pytest.approx(3, abs=1e-6) and d["b", "a"] == pytest.approx(3, abs=1e-6)


def test_communities_beat_one_part(spark):
    ring = [(1, a, b, 1.0) for group in ("abc", "xyz") for a in group for b in group if a < b] + [(1, "c", "x", 0.1)]
    edges = spark.createDataFrame(ring, "net_id long, src string, dst string, w double")
    parts = N.communities(edges)
    assert N.modularity(edges, parts).first()["modularity"] > 0.3


def test_expression_skips_missing(spark):
    cells = spark.createDataFrame([(0, g, c, v) for g, row in enumerate([[1.0, 2.0, None], [0.0, 0.0, 0.0], [3.0, 5.0, 9.0]]) for c, v in enumerate(row)], "front_id long, gene long, cond long, value double")
    r = E.global_features(cells).first()
    assert r["n_genes"] == 3 and r["missing"] == pytest.approx(1 / 9) and r["zeros"] == pytest.approx(3 / 9) and r["mean"] == pytest.approx(20 / 8)
    assert E.pca_features(cells, top=3).first()["top_share"] == pytest.approx(1)


def test_quotas_sum_up(spark):
    rows = [(i, fam) for i, fam in enumerate("a" * 7 + "b" * 5 + "c" * 1 + "d" * 9)]
    got = {r["family"]: r["quota"] for r in P.test_quotas(spark.createDataFrame(rows, "front_id long, family string")).collect()}
    assert sum(got.values()) == 4 and got["c"] == 0 and all(got[f] >= 1 for f in "abd")


def test_folds_keep_fronts_whole(spark):
    df = spark.createDataFrame([(f, i) for f in range(10) for i in range(f + 1)], "front_id long, item_id long")
    folds = P.balanced_folds(df, 5).collect()
    load = [sum(r["n_items"] for r in folds if r["fold"] == k) for k in range(5)]
    assert len(folds) == 10 and max(load) - min(load) <= 2


def test_support_counts(spark):
    ranked = spark.createDataFrame([("m", "A", "B", 1), ("m", "A", "C", 2), ("m", "X", "Y", 3)], "method string, src string, dst string, edge_rank int")
    ev = spark.createDataFrame([("A", "B", "r", "t")], "source string, target string, resource string, evidence_type string")
    r = V.support(ranked, ev, 2).first()
    assert (r["pairs"], r["sources"], r["pair_rate"], r["source_rate"]) == (1, 2, 0.5, 1.0)


def test_gene_set_terms(spark):
    lines = spark.createDataFrame([("tp53::myc (human)\tx\tegfr\ttp53",)], "value string")
    genes = spark.createDataFrame([("TP53",), ("MYC",), ("EGFR",)], "symbol string")
    got = {(r["source"], r["target"]) for r in V.gene_sets(lines, genes, "r").collect()}
    assert got == {("TP53", "EGFR"), ("MYC", "EGFR"), ("MYC", "TP53")}


def test_tags(spark):
    row = spark.sql("SELECT 'nl63_mcs50_lr005' AS t").select(*[G.tag_value(__import__("pyspark").sql.functions.col("t"), n).alias(n) for n in ("nl", "mcs", "lr")]).first()
    assert (row["nl"], row["mcs"], row["lr"]) == (63, 50, 0.05)


def test_edges_and_expression_are_cleaned(spark):
    raw = spark.createDataFrame([(" a ", "b", "0.5"), ("a", "c", "bad"), (None, "c", "1")], "src string, dst string, confidence string")
    assert {(r["src"], r["dst"], r["w"]) for r in T.cleaned_edges(raw).collect()} == {("a", "b", 0.5), ("a", "c", 0.0)}
    with pytest.raises(ValueError):
        T.require(raw, ["w"])


def test_stream_ranks_each_batch(spark, tmp_path):
    from frontrank.operators.labels import rank_in_front
    from frontrank.streaming import rank_stream

    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "front_id long, item_id long, score double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    rank_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), rank_in_front, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert {r["item_id"]: r["rank_in_front"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 2, 2: 1}
