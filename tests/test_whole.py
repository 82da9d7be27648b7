"""Whole jobs, readers and splits on small frames."""

import random

import pytest

from frontrank.operators import decision as D
from frontrank.operators import figures as G
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.operators import stats as S
from frontrank.sources import tables as T


def long_values(spark):
    rows = [(m, f, a, float(v + f / 10)) for m in ("Regret@5", "Hit@5") for f in range(1, 5) for a, v in (("A", 1), ("B", 2), ("learned", 3))]
    return spark.createDataFrame(rows, "metric string, front_id long, method string, value double")


def test_cv_and_comparison_summaries(spark):
    v = long_values(spark)
    got = {(r["metric"], r["method"]): r for r in S.cv_summary(v, required=["Regret@5"]).collect()}
    assert len(got) == 6 and got["Regret@5", "A"]["place"] == 1 and got["Hit@5", "A"]["place"] == 3
    assert got["Regret@5", "B"]["mean"] == pytest.approx(2.25) and got["Regret@5", "B"]["avg_rank"] == 2
    with pytest.raises(ValueError, match="Regret@1"):
        S.cv_summary(v, required=["Regret@1"])
    both = {(r["metric"], r["method"]): r for r in S.comparison_summary(v).collect()}
    assert both["Hit@5", "A"]["z"] is None and both["Hit@5", "learned"]["significant"]
    table = {r["variant"]: (r["class"], r["label"]) for r in G.held_out_table(S.rank_tests(v.filter("metric = 'Regret@5'"))).collect()}
    assert table["A"] == ("winner", "winner") and table["full"][0] == "significant"


def test_figure_tables_fill_what_is_absent(spark, tmp_path):
    T.write_table(spark.createDataFrame([("m", 1.5)], "method string, mean double"), f"{tmp_path}/t", kind="csv")
    row = T.read_figure_table(spark, f"{tmp_path}/t", "method string, rank long, mean double", ["method"]).first()
    assert (row["method"], row["rank"], row["mean"]) == ("m", None, 1.5)
    with pytest.raises(ValueError):
        T.read_figure_table(spark, f"{tmp_path}/t", "method string", ["place"])


def test_ranked_tables_are_checked(spark):
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "front_id long, score double")
    assert T.checked_ranked(good, ["score"]) is good
    with pytest.raises(ValueError, match="score: 1 nulls"):
        T.checked_ranked(good.unionByName(spark.createDataFrame([(3, None)], good.schema)), ["front_id", "score"])
    with pytest.raises(ValueError, match="1 texts"):
        T.checked_ranked(spark.createDataFrame([("x",)], "score string"), ["score"])


def test_cases_hold_one_front(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.6), ("b", 1, 0.5), ("b", 2, None)], "case string, front_id long, price double")
    assert {(r["case"], r["fault"]) for r in D.case_faults(df, "case", ["price"]).collect()} == {("b", "several fronts"), ("b", "no price")}


def test_tags_and_blocks(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 'nl63_mcs50_lr005' AS t").select(G.tag_map(F.col("t")).alias("m")).first()
    assert row["m"] == {"nl": 63.0, "mcs": 50.0, "lr": 0.05}
    table = spark.createDataFrame([("full",), ("lean",)], "variant string")
    of = spark.createDataFrame([("full", "keys"), ("full", "money")], "variant string, block string")
    assert {r["variant"]: (r["keys"], r["money"]) for r in G.with_blocks(table, of, ["keys", "money"]).collect()} == {"full": (True, True), "lean": (False, False)}


def test_the_largest_front_goes_to_the_lightest_fold():
    rng = random.Random(1)
    for _ in range(300):
        k, sizes = rng.choice([2, 3, 5]), [rng.choice([1, 2, 3, 4, 7, 10, 50]) for _ in range(rng.randint(1, 60))]
        loads, expected = [0] * k, {}
        for s in sorted(sizes, reverse=True):
            fold = loads.index(min(loads))
            loads[fold] += s
            expected.setdefault(s, []).append(fold)
        for s, head, cycle in P.lightest_folds([(s, sizes.count(s)) for s in set(sizes)], k):
            assert (head + cycle * 60)[: sizes.count(s)] == expected[s]


def test_diverse_fronts_are_the_greedy_choice(spark):
    from hashlib import sha256

    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], rng.randint(1, 3), rng.choice("xyz"), rng.choice("pq")) for i in range(24)]
    families = spark.createDataFrame(rows, "front_id long, family string, size long, condition string, source string")
    quotas = spark.createDataFrame([("a", 4), ("b", 2)], "family string, quota long")
    expected = set()
    for family, n in (("a", 4), ("b", 2)):
        left, chosen = [r for r in rows if r[1] == family], []
        for turn in range(1, n + 1):
            score = lambda r: sum(p * (r[c] not in {x[c] for x in chosen}) for c, p in ((2, 8), (3, 4), (4, 2)))  # noqa: B023, E731
            best = min(left, key=lambda r: (-score(r), sha256(f"42:{r[0]}".encode()).hexdigest()[:16], r[0]))
            chosen.append(best)
            left.remove(best)
            expected.add((best[0], family, turn))
    assert {tuple(r) for r in P.diverse_test_fronts(families, quotas).collect()} == expected
    for fraction in (0.0, 1.0):
        with pytest.raises(ValueError):
            P.audited_split(families, fraction)


def test_communities_of_a_ring_of_cliques(spark):
    edges = [(0, f"c{k}{a}", f"c{k}{b}", 1.0) for k in range(5) for a in "abc" for b in "abc" if a < b]
    edges += [(0, f"c{k}a", f"c{(k + 1) % 5}b", 0.1) for k in range(5)]
    g = spark.createDataFrame(edges, "net_id long, src string, dst string, w double")
    parts = {r["node"]: r["part"] for r in N.communities(g).collect()}
    assert len(parts) == 15 and len(set(parts.values())) == 5 and all(len({parts[f"c{k}{a}"] for a in "abc"}) == 1 for k in range(5))


def test_built_data_keeps_candidates_without_a_network(spark):
    candidates = spark.createDataFrame([(1, 10), (2, 11)], "front_id long, net_id long")
    weights = spark.createDataFrame([(10, "A", 2.0), (10, "B", 1.0), (11, "A", 0.0)], "net_id long, technique string, weight double")
    edges = spark.createDataFrame([("A", "x", "y", 0.75), ("B", "y", "x", 0.6)], "technique string, src string, dst string, w double")
    expression = spark.createDataFrame([(1, 0.5)], "front_id long, expr_global_mean double")
    got = {r["net_id"]: r for r in N.build_data(candidates, weights, edges, expression).collect()}
    assert got[10]["grn_n_edges"] == 2 and got[10]["grn_total_w"] == pytest.approx(0.7) and got[10]["expr_global_mean"] == 0.5
    assert got[11]["grn_n_edges"] is None and list(got[10].asDict())[2:] == sorted(list(got[10].asDict())[2:])


def test_tables_are_cleaned_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "shared_dir", lambda _: f"{tmp_path}/shared")
    df = T.materialized(spark.range(3), "some")
    assert df.count() == 3 and list((tmp_path / "shared/frontrank").iterdir())
    T.clean_up(spark)
    assert not (tmp_path / "shared/frontrank").exists()
