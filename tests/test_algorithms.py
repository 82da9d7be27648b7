"""Algorithms against plain loops: inversions, tiles, Gram sums, components, paths, triangles, quotas, diverse fronts, and the life of tables."""

import random
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from frontrank.operators import expression as E
from frontrank.operators import labels as L
from frontrank.operators import ltr as R
from frontrank.operators import metrics as M
from frontrank.operators import networks as N
from frontrank.operators import splits as P
from frontrank.operators import stats as S
from frontrank.sources import tables as T

EDGE = "net_id long, src string, dst string, w double"


def test_inversions_of_groups():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 30, 1, 64, 33]
    group, values = np.repeat(np.arange(len(sizes)), sizes), rng.integers(0, 9, sum(sizes))
    want = [sum(values[j] > values[i] for j in range(i) if group[j] == group[i]) for i in range(len(values))]
    assert M.inversions(group, values).tolist() == want
    assert not len(M.inversions(np.zeros(0, int), np.zeros(0)))


def test_tau_of_fronts(spark):
    rng = random.Random(4)
    rows = [(f, i, rng.choice([0.0, 0.5, 1.0, rng.random()]), rng.choice([0.1, 0.2, rng.random()])) for f in range(12) for i in range(1 if f == 3 else 5 * f + 2)]
    rows += [(50, i, 1.0, float(i)) for i in range(4)] + [(51, 0, None, 1.0), (51, 1, 1.0, None), (52, 0, 1.0, 1.0), (52, 1, 2.0, 2.0), (52, 2, None, 5.0)]
    got = {r["front_id"]: r["kendall"] for r in M.kendall(spark.createDataFrame(rows, "front_id long, item_id long, score double, target double").repartition(3)).collect()}
    want = {}
    for f in {r[0] for r in rows}:
        own = [(r[2], r[3]) for r in rows if r[0] == f]
        known = [p for p in own if None not in p]
        s = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for i, a in enumerate(known) for b in known[:i]]
        apart = (sum(x != 0 for x, _ in s) * sum(y != 0 for _, y in s)) ** 0.5
        if len(own) > 1:
            want[f] = sum(x * y for x, y in s) / apart if apart else 0.0
    assert got == pytest.approx(want)


def test_tau_of_a_long_front(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("front_id"), F.col("id").alias("item_id"), F.col("id").cast("double").alias("score"), (F.col("id") - F.when(F.col("id") % 2 == 1, 2).otherwise(0)).cast("double").alias("target"))
    # 0 -1 2 1 4 3: neighbours change places, n / 2 pairs of all disagree
    assert M.kendall(df).first()["kendall"] == pytest.approx(1 - 4 * (n / 2) / (n * (n - 1)), abs=1e-9)


def test_pair_counts_equal_the_pairs(spark):
    df = spark.createDataFrame([(f, i, float(i * f % 4)) for f in range(5) for i in range(f + 1)], "front_id long, item_id long, score double")
    pairs = L.item_pairs(df, "score").groupBy("front_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("score_a") == F.col("score_b")).alias("tied"))
    assert sorted(map(tuple, L.pair_counts(df, "score").collect())) == sorted(map(tuple, pairs.collect()))


def _matrix(spark, genes, conds, seed, missing=0.2):
    rng = np.random.default_rng(seed)
    rows = [(f, f"g{g:04d}", c, None if rng.random() < missing else float(1e4 * f + rng.normal())) for f in range(2) for g in range(genes) for c in range(conds)]
    rows += [(0, "flat", c, 2.0) for c in range(conds)] + [(0, "lone", 0, 1.0)]
    return spark.createDataFrame(rows, "front_id long, gene string, cond long, value double")


def _plain(cells):
    rows = {}
    for r in cells.collect():
        if r["value"] is not None:
            rows.setdefault((r["front_id"], r["gene"]), {})[r["cond"]] = r["value"]
    out = {}
    for (f, a), x in rows.items():
        for (g, b), y in rows.items():
            both = sorted(set(x) & set(y))
            if f == g and a < b and len(both) >= 2:
                p, q = np.array([x[c] for c in both]), np.array([y[c] for c in both])
                if p.std() > 1e-9 and q.std() > 1e-9:
                    out[f, a, b] = float(np.corrcoef(p, q)[0, 1])
    return out


def test_tiles_give_all_correlations(spark, monkeypatch):
    cells = _matrix(spark, 23, 17, 1)
    want = _plain(cells)
    got = {(r["front_id"], r["a"], r["b"]): r["r"] for r in E.correlations(cells).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_many_tiles(spark):
    cells = _matrix(spark, 300, 6, 2).filter("front_id = 0 AND gene NOT IN ('flat', 'lone')")
    got = {(r["a"], r["b"]): r["r"] for r in E.correlations(cells).collect()}
    want = {k[1:]: v for k, v in _plain(cells).items()}
    assert len(got) == len(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_drawn_pairs_come_before_cells(spark):
    cells = _matrix(spark, 23, 17, 3)
    every = {(r["front_id"], r["a"], r["b"]): r["r"] for r in E.correlations(cells).collect()}
    some = {(r["front_id"], r["a"], r["b"]): r["r"] for r in E.correlations(cells, sample=40).collect()}
    assert all(some[k] == pytest.approx(every[k], abs=1e-6) for k in some) and 60 <= len(some) <= 80
    assert len(E.correlations(cells, sample=10_000).collect()) == len(every)
    names = spark.createDataFrame([(0, f"g{i}") for i in range(30)], "front_id long, gene string")
    drawn = [(r["i"], r["j"]) for r in E._drawn_pairs(names, 400, 5).collect()]
    assert len(set(drawn)) == 400 and all(0 <= i < j < 30 for i, j in drawn)


def test_gram_sums_give_the_spectrum(spark):
    cells = _matrix(spark, 40, 7, 4)
    got = {}
    for r in E.spectrum(cells.repartition(5)).collect():
        got.setdefault(r["front_id"], []).append((r["place"], r["eigenvalue"]))
    for f in (0, 1):
        own = [r for r in cells.collect() if r["front_id"] == f]
        genes = sorted({r["gene"] for r in own})
        m = np.full((len(genes), 7), np.nan)
        for r in own:
            m[genes.index(r["gene"]), r["cond"]] = np.nan if r["value"] is None else r["value"]
        m = np.nan_to_num(m - np.nanmean(m, axis=0))
        assert [v for _, v in sorted(got[f])] == pytest.approx(sorted(np.linalg.eigvalsh(m.T @ m), reverse=True), rel=1e-6, abs=1e-6)


def _turns(monkeypatch):
    seen, turn = Counter(), T.Scratch.turn
    monkeypatch.setattr(T.Scratch, "turn", lambda self, df, name: (seen.update([name]), turn(self, df, name))[1])
    return seen


def test_chain_and_cycle_take_few_rounds(spark, monkeypatch):
    rng = random.Random(1)
    names = [f"n{i:05d}" for i in range(10_000)]
    rng.shuffle(names)
    edges = [(1, a, b, 1.0) for a, b in zip(names, names[1:], strict=False)] + [(2, f"c{i:03d}", f"c{(i + 1) % 300:03d}", 1.0) for i in range(300)]
    seen = _turns(monkeypatch)
    parts = N.strong_components(spark.createDataFrame(edges, EDGE))
    size = {(r["net_id"], r["n"]) for r in parts.groupBy("net_id", "component").agg(F.count("*").alias("n")).collect()}
    assert size == {(1, 1), (2, 300)} and parts.count() == 10_300
    assert seen["hanging"] < 40 and seen["ahead"] < 40 and seen["behind"] < 40


def test_components_of_random_networks(spark):
    rng = random.Random(3)
    edges = {(n, f"v{rng.randrange(18):02d}", f"v{rng.randrange(18):02d}") for n in range(4) for _ in range(14 + 6 * n)}
    got = {(r["net_id"], r["node"]): r["component"] for r in N.strong_components(spark.createDataFrame([(*e, 1.0) for e in edges], EDGE)).collect()}
    for n in range(4):
        nodes = {v for e in edges if e[0] == n for v in e[1:]}
        reach = {v: {v} for v in nodes}
        for _ in nodes:
            for _, a, b in (e for e in edges if e[0] == n):
                for v in nodes:
                    if a in reach[v]:
                        reach[v].add(b)
        for v in nodes:
            assert got[n, v] == min(u for u in nodes if u in reach[v] and v in reach[u])
    assert len(got) == len({(e[0], v) for e in edges for v in e[1:]})


def test_paths_are_exact(spark):
    rng = random.Random(5)
    edges = {(f"v{rng.randrange(12):02d}", f"v{rng.randrange(12):02d}"): rng.choice([0.0, rng.random(), 1.0]) for _ in range(40)}
    got = {(r["src"], r["dst"]): r["d"] for r in N.shortest_paths(spark.createDataFrame([(0, *e, w) for e, w in edges.items()], EDGE)).collect()}
    d = {e: 1 / (w + 1e-9) for e, w in edges.items() if e[0] != e[1]}
    for k in sorted({v for e in d for v in e}):
        for (a, m), x in list(d.items()):
            for (m2, b), y in list(d.items()):
                if m == m2 == k and a != b and x + y < d.get((a, b), float("inf")):
                    d[a, b] = x + y
    assert got == pytest.approx(d, rel=1e-12)


def test_a_star_makes_no_wedge(spark):
    n = 100_000
    star = spark.range(n).select(F.lit(0).cast("long").alias("net_id"), F.lit("hub").alias("src"), F.concat(F.lit("leaf"), "id").alias("dst"), F.lit(1.0).alias("w"))
    triangle = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "c", "a", 0.125)], EDGE)
    got = {r["net_id"]: r["clustering"] for r in N.clustering(star.unionByName(triangle)).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.5})


# Fronts and test quotas of each family in the shipped split.
SHIPPED = {"BioGrid": (32, 6), "GRNdb": (11, 2), "InSilico": (15, 3), "RegNetwork": (2, 1), "TFLink": (4, 1), "dream4": (10, 2), "eipo-modular": (12, 2), "gnw": (1, 0), "rogers": (1, 0), "scale-free": (12, 2), "switch": (2, 1), "syntren": (2, 1)}


def _quotas(counts, fraction):
    total = sum(counts.values())
    want = min(round(total * fraction), max(total - 1, 0))
    share = {f: n * want / max(total, 1) for f, n in counts.items()}
    low, high = {f: int(n > 1) for f, n in counts.items()}, {f: n - 1 for f, n in counts.items()}
    quota = {f: min(max(int(share[f]), low[f]), high[f]) for f in counts}
    rest = {f: share[f] - int(share[f]) for f in counts}
    tie = {f: int(sha256(f"0:{f}".encode()).hexdigest()[:16], 16) for f in counts}
    for step, most, order in ((1, high, lambda f: (-rest[f], tie[f])), (-1, low, lambda f: (rest[f], -tie[f]))):
        while (want - sum(quota.values())) * step > 0 and (open_ := [f for f in counts if quota[f] != most[f]]):
            quota[min(open_, key=order)] += step
    return quota


def test_quotas_of_the_shipped_split_and_of_random_tables(spark):
    rng = random.Random(8)
    tables = [({f: n for f, (n, _) in SHIPPED.items()}, 0.2)] + [({f"f{i}": rng.choice([1, 1, 2, 3, 7, 20]) for i in range(rng.randrange(1, 9))}, rng.choice([0.05, 0.2, 0.5, 0.9])) for _ in range(12)]
    for counts, fraction in tables:
        rows = [(f,) for f, n in counts.items() for _ in range(n)]
        got = {r["family"]: r["quota"] for r in P.test_quotas(spark.createDataFrame(rows, "family string"), fraction).collect()}
        assert got == _quotas(counts, fraction), (counts, fraction)
    assert _quotas(*tables[0]) == {f: q for f, (_, q) in SHIPPED.items()}


def test_diverse_fronts_equal_plain_greedy(spark):
    rng = random.Random(3)
    rows = [(i, f"name{i % 70}", rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.choice([None, "unknown", "x", "y"]), rng.choice("pq")) for i in range(90)]
    df = spark.createDataFrame(rows, "front_id long, front_name string, family string, size long, condition string, source string")
    quotas = P.test_quotas(df, 0.6)
    want = set()
    for q in quotas.collect():
        left, seen = [r for r in rows if r[2] == q["family"]], [set(), set(), set()]
        text = lambda v: "unknown" if v is None else str(v)
        for turn in range(1, q["quota"] + 1):
            key = lambda r: (-sum(p * (text(v) not in s) for p, v, s in zip((8, 4, 2), r[3:], seen, strict=True)), sha256(f"42:{r[1]}".encode()).hexdigest()[:16], r[0])  # noqa: B023, E731
            best = min(left, key=key)
            left.remove(best)
            for s, v in zip(seen, best[3:], strict=True):
                s.add(text(v))
            want.add((best[0], q["family"], turn))
    assert {tuple(r) for r in P.diverse_test_fronts(df, quotas, name="front_name").collect()} == want


def test_phase_summary_names_what_lacks(spark):
    rows = spark.createDataFrame([("a", "Regret@5", 0.1), ("a", "Hit@5", 0.5), ("b", "Hit@5", 0.4)], "method string, metric string, mean double")
    assert {tuple(r) for r in S.phase_summary(rows.filter("method = 'a'"), ["Regret@5", "Hit@5"]).collect()} == {("a", 2, 0.1)}
    with pytest.raises(ValueError, match="b lacks Regret@5"):
        S.phase_summary(rows, ["Regret@5", "Hit@5"])
    with pytest.raises(ValueError, match="c lacks its report"):
        S.phase_summary(rows.filter("method = 'a'"), ["Regret@5"], spark.createDataFrame([("a",), ("c",)], "method string"))


def test_a_missing_base_network_is_an_error(spark, tmp_path):
    edges = spark.createDataFrame([("A", "x", "y", 0.5), ("B", "y", "x", 1.0)], "technique string, src string, dst string, w double")
    T.write_edge_folder(edges, f"{tmp_path}/nets")
    assert T.read_edge_folder(spark, f"{tmp_path}/nets", ["A", "B"]).count() == 2
    with pytest.raises(ValueError, match="no file for: C"):
        T.read_edge_folder(spark, f"{tmp_path}/nets", ["A", "B", "C"])
    used = spark.createDataFrame([("A",), ("C",)], "technique string")
    assert [r[0] for r in T.missing_techniques(spark, f"{tmp_path}/nets", used).collect()] == ["C"]


def test_all_blocks_side_by_side(spark):
    net = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "a", 0.5), (1, "a", "b", 1.0)], EDGE)
    got = {r["net_id"]: r for r in N.network_features(net).collect()}
    assert set(got) == {0, 1} and got[0]["grn_path_mean"] == pytest.approx(1.5, rel=1e-6) and got[1]["grn_path_mean"] is None and got[0]["grn_communities"] >= 1
    cells = _matrix(spark, 6, 5, 6)
    assert {"expr_pca_top_share", "expr_gene_r_gene_r_mean", "expr_cond_r_cond_r_mean", "expr_time_auto_mean"} <= set(E.expression_features(cells).columns)


def test_loops_drop_their_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "shared_dir", lambda _: f"{tmp_path}/shared")
    left = lambda: len(list(Path(f"{tmp_path}/shared/frontrank").iterdir()))
    edges = spark.createDataFrame([(0, f"v{i}", f"v{(i * 3 + 1) % 9}", 1.0) for i in range(9)] + [(0, "v0", "v5", 1.0)], EDGE)
    assert N.communities(edges).count() == 9 and left() == 1
    assert N.shortest_paths(edges).count() > 0 and left() == 2
    fronts = spark.createDataFrame([(f, i, (i * 7 + f) % 5 / 5.0) for f in range(4) for i in range(6)], "front_id long, item_id long, a double").withColumn("target", F.col("a"))
    before = left()
    R.fit(L.build_labels(fronts, "continuous"), "listwise", ["a"], {"rounds": 3})
    assert left() == before
