"""Learning to rank on MLlib with one contract: features, intra-front labels and groups in, scores out.

Three families: `listwise` boosts trees on lambda gradients weighted by the change of NDCG, `pairwise` is a logistic
regression on pair differences (pairs.py), `pointwise` boosts trees on min-max labels. Pairs are made inside fronts only.

Screening, tuning and ablation have many fits; they grow together in one job (boosting.py), with its three families.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontrank.operators import boosting as B
from frontrank.operators import labels as L
from frontrank.operators import metrics as M
from frontrank.operators import pairs as W
from frontrank.operators import splits as P
from frontrank.sources.tables import Scratch, aligned, materialized, require

KINDS = ("listwise", "pairwise", "pointwise")
KEYS = ["front_id", "item_id"]
DEFAULTS: dict[str, dict] = {"listwise": {"rounds": 10, "depth": 4, "rate": 0.3}, "pairwise": {"reg": 0.01}, "pointwise": {"rounds": 10, "depth": 4}}
# Settings that tuning tries for each family, 27, 36 and 36; depths 5, 6 and 7 have 32, 64 and 128 leaves at most.
GRID: dict[str, list[dict]] = {
    "listwise": [{"depth": d, "least_rows": n, "rate": r} for d in (5, 6, 7) for n in (30, 50, 100) for r in (0.03, 0.05, 0.1)],
    "pairwise": [{"depth": d, "share": s, "least_weight": w, "rate": r} for d in (4, 6, 8) for s in (0.8, 1.0) for w in (1, 5, 10) for r in (0.03, 0.05)],
    "sampled": [{"depth": d, "l2": x, "rate": r} for d in (4, 6, 8) for x in (3, 5, 7, 10) for r in (0.03, 0.05, 0.1)],
}
TAGS = {"depth": "d", "least_rows": "mcs", "share": "ss", "least_weight": "mcw", "rate": "lr"}


@dataclass
class Ranker:
    """A fitted ranker: score() adds the column `score`. order is the order of its features."""

    kind: str
    order: list[str]
    models: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        vectors = VectorAssembler(inputCols=self.order, outputCol="__x", handleInvalid="keep").transform(require(df, self.order))
        if self.kind == "pairwise":
            values = vector_to_array("__x")
            total = reduce(lambda a, b: a + b, [F.lit(w) * values[i] for i, w in enumerate(self.weights)])
            return vectors.withColumn("score", total).drop("__x")
        total = F.lit(0.0)
        for i, (model, w) in enumerate(zip(self.models, self.weights, strict=True)):
            vectors = model.setPredictionCol(f"__p{i}").setFeaturesCol("__x").transform(vectors)
            total = total + w * F.col(f"__p{i}")
        return vectors.withColumn("score", total).drop("__x", *[f"__p{i}" for i in range(len(self.models))])

    def save(self, path: str) -> None:
        """Models as MLlib saves them, the order of features and the weights as one-row tables beside them."""
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.kind, self.order, self.weights)], "kind string, order array<string>, weights array<double>").write.mode("overwrite").parquet(f"{path}/contract")
        PipelineModel(self.models).write().overwrite().save(f"{path}/models")


def load(spark: SparkSession, path: str) -> Ranker:
    kind, order, weights = spark.read.parquet(f"{path}/contract").first()
    return Ranker(kind, list(order), list(PipelineModel.load(f"{path}/models").stages), list(weights))


#: Places by score or by label that count as the head of a front: pairs have one side there.
HEAD = 10


def _pairs(df: DataFrame, carry: Sequence[str] = (), head: int = HEAD) -> DataFrame:
    """Pairs of one front with the better item as a, and the change of NDCG if they swapped places by score.

    One side stands among the first `head` places by score or by label, so a front of n items has 2 x head x n pairs at
    most; swaps further down change NDCG at the places that are reported by nothing. carry: columns that come along, as
    <name>_a and <name>_b.
    """
    at = F.row_number().over(Window.partitionBy("front_id").orderBy(F.desc("score"), "item_id"))
    ideal = F.row_number().over(Window.partitionBy("front_id").orderBy(F.desc("label"), "item_id"))
    placed = df.select(*KEYS, "label", "score", *carry, at.alias("at"), ideal.alias("ideal"))
    placed = placed.withColumn("best", F.sum(F.col("label") / F.log2(F.col("ideal") + 1.0)).over(Window.partitionBy("front_id")))
    first = (F.col("at") <= head) | (F.col("ideal") <= head)
    own = F.struct("item_id", "label", "score", "at", *[F.col(c).alias(f"carry_{c}") for c in carry])
    x = placed.filter(first).select("front_id", "best", own.alias("x"))
    y = placed.select("front_id", own.alias("y"), first.alias("y_first"))
    met = x.join(y, "front_id").filter("x.label <> y.label AND (NOT y_first OR x.item_id < y.item_id)")  # two heads meet once
    better = F.col("x.label") > F.col("y.label")
    met = met.select("front_id", "best", F.when(better, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(better, F.col("y")).otherwise(F.col("x")).alias("q"))
    out = met.select("front_id", "best", *[F.col(f"{s}.{c}").alias(n) for s, names in (("p", ("a", "la", "sa", "pa")), ("q", ("b", "lb", "sb", "pb"))) for c, n in zip(("item_id", "label", "score", "at"), names, strict=True)], *[F.col(f"{s}.carry_{c}").alias(f"{c}_{n}") for c in carry for s, n in (("p", "a"), ("q", "b"))])
    change = F.abs((F.col("la") - F.col("lb")) * (1 / F.log2(F.col("pa") + 1.0) - 1 / F.log2(F.col("pb") + 1.0)))
    return out.withColumn("delta", F.coalesce(F.try_divide(change, F.col("best")), F.lit(0.0)))


def lambdas(df: DataFrame) -> DataFrame:
    """(front, item, gradient): what LambdaRank asks each item's score to do."""
    push = _pairs(df).withColumn("g", F.col("delta") / (1 + F.exp(F.col("sa") - F.col("sb"))))
    both = push.select("front_id", F.explode(F.array(F.struct(F.col("a").alias("item_id"), F.col("g").alias("g")), F.struct(F.col("b").alias("item_id"), (-F.col("g")).alias("g")))).alias("x"))
    return both.groupBy("front_id", F.col("x.item_id").alias("item_id")).agg(F.sum("x.g").alias("gradient"))


def fit(df: DataFrame, kind: str, order: Sequence[str], params: Mapping | None = None, seed: int = 42) -> Ranker:
    """A ranker of one family from rows (front_id, item_id, features, label)."""
    if kind not in KINDS:
        raise ValueError(f"unknown ranker {kind}; one of {KINDS}")
    p = DEFAULTS[kind] | dict(params or {})
    order = list(order)
    if kind == "pairwise":
        return Ranker(kind, order, [], W.weights(require(df, order), order, p["reg"], HEAD))
    vectors = VectorAssembler(inputCols=order, outputCol="features", handleInvalid="keep").transform(require(df, order).withColumn("label", F.col("label").cast("double")))
    if kind == "pointwise":
        model = GBTRegressor(featuresCol="features", labelCol="label", maxIter=p["rounds"], maxDepth=p["depth"], subsamplingRate=0.8, seed=seed).fit(vectors)
        return Ranker(kind, order, [model], [1.0])
    models, x = [], vectors.select(*KEYS, "features")
    with Scratch(df.sparkSession) as scratch:
        state = scratch.turn(vectors.select(*KEYS, "label", F.lit(0.0).alias("score")), "scores")
        for turn in range(p["rounds"]):
            step = x.join(lambdas(state), KEYS, "left").withColumn("gradient", F.coalesce("gradient", F.lit(0.0)))
            model = DecisionTreeRegressor(featuresCol="features", labelCol="gradient", predictionCol="step", maxDepth=p["depth"], seed=seed + turn).fit(step)
            models.append(model)
            moved = state.join(model.transform(x).select(*KEYS, "step"), KEYS).select(*KEYS, "label", (F.col("score") + p["rate"] * F.col("step")).alias("score"))
            state = scratch.turn(moved, "scores")
    return Ranker(kind, order, models, [p["rate"]] * len(models))


def rank_fronts(df: DataFrame, ranker: Ranker, seed: int = 42) -> DataFrame:
    """Scores and ranks of new fronts."""
    scored = ranker.score(aligned(df, ranker.order, [*KEYS, *[c for c in ("target",) if c in df.columns]]))
    return L.rank_in_front(scored, seed)


def cross_validate(df: DataFrame, kind: str, order: Sequence[str], mode: str = "continuous", params: Mapping | None = None, k: int = 3, seed: int = 42) -> DataFrame:
    """Out-of-fold scores and ranks of all rows; fronts stay whole. Fold f is ranked with tie seed + f."""
    folds = materialized(P.balanced_folds(df, k).select("front_id", "fold"), "folds")
    labelled = L.build_labels(df, mode, seed=seed).join(folds, "front_id")  # not written: where df lies by front, it stays there
    out = []
    for f in range(k):
        ranker = fit(labelled.filter(F.col("fold") != f), kind, order, params, seed + f)
        out.append(rank_fronts(labelled.filter(F.col("fold") == f), ranker, seed + f).withColumn("fold", F.lit(f)))
    return reduce(DataFrame.unionByName, out)


def cv_metrics(ranked: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """(fold, front_id, metric, value) of a cross-validated ranking."""
    return M.long_metrics(ranked, ks, over=["fold"])


#: Scores that a part of the table of judged scores holds; parts are by front, a row each, so that metrics neither shuffle nor sort.
ROWS = 1 << 20


def _measured(df: DataFrame, order: Sequence[str], runs: Sequence[B.Run], judged: Mapping[int, Sequence[int]], label: str, seed: int = 42) -> DataFrame:
    """(method, fold, front_id, metric, value) of all runs, fitted in one job; judged: the runs whose scores count on each fold."""
    with Scratch(df.sparkSession) as scratch:
        _, state = B.boosted(df, order, runs, scratch, seed)
        names = F.broadcast(df.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(runs)], "run int, method string"))  # a row for each run
        parts = max(1, -(-df.count() * max(map(len, judged.values())) // ROWS))
        scores = scratch.bucketed(B.judged_of(state, runs, judged).repartition(parts, "front_id"), "scores", "front_id", parts)
        scores = scores.dropDuplicates(["front_id"])  # fronts come once; grouped by the bucket's key, each part stays a task of its own
        found = M.long_metrics(B.fronts_of(scores, judged), (1, 5), over=["run", "fold"]).join(names, "run").select("method", "fold", "front_id", "metric", "value")
        return materialized(found, label)


def _cross_validated(df: DataFrame, order: Sequence[str], fits: Sequence[B.Run], k: int, label: str) -> DataFrame:
    """Out-of-fold metrics (method, front_id, metric, value) of fits, each over the same k folds."""
    runs = [replace(r, without=(f,)) for r in fits for f in range(k)]
    folded = df.join(P.balanced_folds(df, k).select("front_id", F.col("fold").cast("int").alias("fold")), "front_id")
    return _measured(folded, order, runs, {f: range(f, len(runs), k) for f in range(k)}, label).drop("fold")


def ranked_by(df: DataFrame, order: Sequence[str], kind: str, mode: str = "continuous", params: Mapping | None = None, seed: int = 42) -> DataFrame:
    """df's fronts scored and ranked by one run of a boosted family that learns from all of them."""
    run = B.Run(kind, kind, mode, setting=setting(params))
    with Scratch(df.sparkSession) as scratch:
        _, state = B.boosted(df.withColumn("fold", F.lit(0)), order, [run], scratch, seed)
        return L.rank_in_front(materialized(B.scores_of(state, [run], {0: [0]}).drop("run", "fold"), "ranked"), seed)


def setting(params: Mapping | None) -> tuple[tuple[str, float], ...]:
    return tuple((params or {}).items())


def screening_runs(kinds: Sequence[str] = B.FAMILIES, modes: Sequence[str] = L.MODES, params: Mapping[str, Mapping] | None = None) -> list[B.Run]:
    """Every family with every label mode, as <family>__<mode>."""
    return [B.Run(f"{kind}__{mode}", kind, mode, setting=setting((params or {}).get(kind))) for kind in kinds for mode in modes]


def screening(df: DataFrame, order: Sequence[str], kinds: Sequence[str] = B.FAMILIES, modes: Sequence[str] = L.MODES, k: int = 3, params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Long metrics (method, front_id, metric, value) of every family and label mode; all fits of all folds grow in one job."""
    return _cross_validated(df, order, screening_runs(kinds, modes, params), k, "screened")


def tag(params: Mapping) -> str:
    return "_".join(f"{TAGS.get(name, name)}{value}".replace(".", "") for name, value in params.items())


def tuning_runs(shortlist: Sequence[tuple[str, str]], grid: Mapping[str, Sequence[Mapping]] = GRID) -> list[B.Run]:
    """Each setting of each shortlisted (family, mode), as <family>__<mode>__<tag>; a name that comes twice is an error."""
    runs = [B.Run(f"{kind}__{mode}__{tag(params)}", kind, mode, setting=setting(params)) for kind, mode in shortlist for params in grid[kind]]
    for name, times in Counter(r.name for r in runs).items():
        if times > 1:
            raise ValueError(f"{name} is listed twice")
    if not runs:
        raise ValueError("the grid is empty")
    return runs


def tuning(df: DataFrame, order: Sequence[str], shortlist: Sequence[tuple[str, str]], grid: Mapping[str, Sequence[Mapping]] = GRID, k: int = 3) -> DataFrame:
    """Long metrics of each setting of each shortlisted (family, mode); all fits of all folds grow in one job."""
    return _cross_validated(df, order, tuning_runs(shortlist, grid), k, "tuned")


def held_out(df: DataFrame, splits: DataFrame, kind: str, order: Sequence[str], mode: str = "continuous", params: Mapping | None = None) -> DataFrame:
    """Fit on development fronts, rank test fronts once."""
    rows = P.with_split(df, splits)
    ranker = fit(L.build_labels(rows.filter("split = 'development'"), mode), kind, order, params)
    return rank_fronts(rows.filter("split = 'test'"), ranker)


def ablation(df: DataFrame, splits: DataFrame, sets: Mapping[str, Sequence[str]], kind: str = "listwise", mode: str = "continuous", params: Mapping | None = None, k: int = 3) -> DataFrame:
    """Metrics (method, split, front_id, metric, value) of each feature set: out of fold on development fronts, and held out on test fronts.

    All sets share the folds, and all fits grow in one job. No fit sees a test front.
    """
    order = sorted({c for own in sets.values() for c in own})
    rows = P.with_split(df, splits)
    folds = P.balanced_folds(rows.filter("split = 'development'"), k).select("front_id", F.col("fold").cast("int").alias("own"))
    folded = rows.join(folds, "front_id", "left").withColumn("fold", F.coalesce("own", F.lit(B.TEST_FOLD))).drop("own")
    runs, judged = [], {f: [] for f in (*range(k), B.TEST_FOLD)}
    for name, own in sets.items():
        for f in judged:
            judged[f].append(len(runs))
            runs.append(B.Run(name, kind, mode, (f, B.TEST_FOLD) if f != B.TEST_FOLD else (f,), tuple(order.index(c) for c in own), setting(params)))
    found = _measured(folded, order, runs, judged, "ablated")
    return found.select("method", F.when(F.col("fold") == B.TEST_FOLD, "test").otherwise("development").alias("split"), "front_id", "metric", "value")


def with_learned(rule_scores: DataFrame, ranked: DataFrame, name: str = "learned") -> DataFrame:
    """A learned ranking as one more rule beside decision rules."""
    return rule_scores.unionByName(ranked.select("front_id", "item_id", "target", F.lit(name).alias("rule"), "score"))
