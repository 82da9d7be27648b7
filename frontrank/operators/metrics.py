"""Ranking metrics of each front, with ties treated as all their orders being equally likely.

Everything is windows over fronts plus one small explode over ks; subsets of tie blocks are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import KS, average_rank, comb_ratio, exact_mean, pearson
from frontrank.operators.labels import FRONT, SCORE, TARGET


def _keys(df: DataFrame, over: Sequence[str]) -> list[str]:
    return [*over, FRONT] if FRONT not in over else list(over)


def tie_blocks(df: DataFrame, ks: Sequence[int] = KS, over: Sequence[str] = ()) -> DataFrame:
    """A row for each item and k <= front size whose tie block begins before place k.

    start: places before the block; b: its size; r: how many of it the top k takes; j: the item's place in the block by
    target; bests: how many of the block are best in the front; floor: the best target of the places before the block.
    """
    keys = _keys(df, over)
    front, block = Window.partitionBy(*keys), Window.partitionBy(*keys, "__none", "__down")
    # the score turned round, so that windows share sorts (front, score from the top, target); no score comes last
    turned = {"__none": F.col(SCORE).isNull(), "__down": F.when(~F.isnan(F.col(SCORE).cast("double")), -F.col(SCORE))}
    base = df.select(*keys, SCORE, TARGET).withColumns(turned)
    placed = front.orderBy("__none", "__down", TARGET)
    earlier = F.max(TARGET).over(placed.rowsBetween(Window.unboundedPreceding, -1))
    base = base.withColumns({"__p": F.row_number().over(placed), "__before": earlier})
    base = base.withColumns({"n": F.count("*").over(front), "best": F.max(TARGET).over(front)})
    near = F.abs(F.col(TARGET) - F.col("best")) <= 1e-8 + 1e-5 * F.abs("best")
    base = base.withColumns({"start": F.min("__p").over(block) - 1, "b": F.count("*").over(block), "bests": F.sum(near.cast("int")).over(block)})
    base = base.withColumn("j", F.col("__p") - F.col("start"))
    base = base.withColumn("floor", F.max(F.when(F.col("j") == 1, F.col("__before"))).over(block)).drop("__none", "__down", "__p", "__before")
    wide = base.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("k <= n AND start < k")
    return wide.withColumn("r", F.least(F.col("k") - F.col("start"), F.col("b")))


def top_k(df: DataFrame, ks: Sequence[int] = KS, over: Sequence[str] = ()) -> DataFrame:
    """front, k, best_target, hit, regret, and the probabilities behind them."""
    keys = _keys(df, over)
    blocks = tie_blocks(df, ks, over)
    whole = F.col("r") == F.col("b")
    value = F.when(F.col("floor").isNull(), F.col(TARGET)).otherwise(F.greatest(TARGET, "floor"))
    share = comb_ratio(F.col("j"), F.col("r"), F.col("b")) - comb_ratio(F.col("j") - 1, F.col("r"), F.col("b"))
    part = F.when(~whole, value * share)
    missed = F.when(whole, F.when(F.col("bests") > 0, 0.0).otherwise(1.0)).otherwise(comb_ratio(F.col("b") - F.col("bests"), F.col("r"), F.col("b")))
    out = blocks.groupBy(*keys, "k").agg(F.coalesce(F.sum(part), F.max(F.when(whole, F.col(TARGET)))).alias("best_target"), (1 - F.min(missed)).alias("hit"), F.max("best").alias("best"))
    return out.withColumn("regret", F.greatest(F.col("best") - F.col("best_target"), F.lit(0.0)))


def ndcg(df: DataFrame, ks: Sequence[int] = KS, over: Sequence[str] = ()) -> DataFrame:
    """front, k, ndcg with linear gains; tied items share the mean of their gains. Null for fronts of one item."""
    keys = _keys(df, over)
    front = Window.partitionBy(*keys)
    placed = df.select(*keys, SCORE, TARGET).withColumns(
        {
            "n": F.count("*").over(front),
            "gain": F.avg(TARGET).over(Window.partitionBy(*keys, SCORE)),
            "at": F.row_number().over(front.orderBy(F.desc(SCORE), F.desc(TARGET))),
            "ideal": F.row_number().over(front.orderBy(F.desc(TARGET))),
        }
    )
    wide = placed.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("k <= n AND (at <= k OR ideal <= k)")

    def total(gain: str, at: str) -> Column:
        return F.sum(F.when(F.col(at) <= F.col("k"), F.col(gain) / F.log2(F.col(at) + 1.0)).otherwise(0.0))

    out = wide.groupBy(*keys, "k", "n").agg(total("gain", "at").alias("dcg"), total(TARGET, "ideal").alias("idcg"))
    return out.select(*keys, "k", F.when(F.col("n") > 1, F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0))).alias("ndcg"))


def spearman(df: DataFrame, over: Sequence[str] = ()) -> DataFrame:
    keys = _keys(df, over)
    ranked = df.select(*keys, average_rank(keys, F.asc(SCORE), [SCORE]).alias("x"), average_rank(keys, F.asc(TARGET), [TARGET]).alias("y"))
    return ranked.groupBy(*keys).agg(F.coalesce(pearson(F.col("x"), F.col("y")), F.lit(0.0)).alias("spearman"))


def inversions(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place, how many earlier places of its group hold a larger value; groups lie on end.

    Merges from the bottom up, all groups at once: in each round, blocks of twice the width are put in order, and a place
    of a right half counts those of the left half that come behind it.
    """
    n = len(values)
    out = np.zeros(n, np.int64)
    begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, sizes)
    rank = np.unique(values, return_inverse=True)[1]
    order, width, longest = np.arange(n), 1, sizes.max() if n else 0
    while width < longest:
        block = place[order] // (2 * width)
        order = order[np.lexsort((place[order], rank[order], block, group[order]))]
        left = (place[order] // width) % 2 == 0
        key = group[order].astype(np.int64) * (longest + 1) + place[order] // (2 * width)
        heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        seen = np.cumsum(left)
        before = np.repeat(seen[heads] - left[heads], np.diff(np.append(heads, n)))
        whole = np.repeat(np.append(seen[heads[1:] - 1], seen[-1]) - (seen[heads] - left[heads]), np.diff(np.append(heads, n)))
        late = ~left
        out[order[late]] += (whole - (seen - before))[late]
        width *= 2
    return out


def _tied(group: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """For each group, pairs of places that are equal in all values."""
    order = np.lexsort((*values, group))
    new = np.diff(group[order], prepend=-1) != 0
    for v in values:
        new |= np.diff(v[order], prepend=np.nan) != 0
    heads = np.flatnonzero(new)
    t = np.diff(np.append(heads, len(order)))
    return np.bincount(group[order][heads], t * (t - 1) // 2, group.max() + 1 if len(group) else 0)


def kendall(df: DataFrame) -> DataFrame:
    """tau-b of each front of two items or more; 0 where a side is constant. Items without score or target don't count.

    By inversion counts: with items in order of score, then target, pairs that disagree are those whose targets fall.
    n items cost n log n; a front's scores and targets are two arrays of a row.
    """
    pair = F.when(F.col(SCORE).isNotNull() & F.col(TARGET).isNotNull(), F.struct(F.col(SCORE).cast("double").alias("x"), F.col(TARGET).cast("double").alias("y")))
    fronts = df.groupBy(FRONT).agg(F.count("*").alias("n"), F.collect_list(pair).alias("p")).filter("n >= 2").select(FRONT, "p.x", "p.y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths(), np.int64)
            group = np.repeat(np.arange(len(sizes)), sizes)
            x, y = (np.asarray(batch.column(c).flatten(), np.float64) for c in (1, 2))
            tau = np.zeros(len(sizes))
            if len(group):
                order = np.lexsort((y, x, group))
                against = np.bincount(group, inversions(group, y[order]), len(sizes))
                pad = lambda t: np.pad(t, (0, len(sizes) - len(t)))  # noqa: B023, E731
                pairs, by_x, by_y, both = sizes * (sizes - 1) // 2, pad(_tied(group, x)), pad(_tied(group, y)), pad(_tied(group, x, y))
                apart = np.sqrt((pairs - by_x) * (pairs - by_y))
                tau = np.where(apart > 0, (pairs - by_x - by_y + both - 2 * against) / np.where(apart > 0, apart, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tau)], [FRONT, "kendall"])

    return fronts.mapInArrow(run, f"{FRONT} {dict(df.dtypes)[FRONT]}, kendall double")


def _ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the block of each place begins, and the place behind it. new: whether a place begins a block (rows x places)."""
    place, last = np.arange(new.shape[1]), np.ones_like(new)
    last[:, :-1] = new[:, 1:]
    return np.maximum.accumulate(np.where(new, place, 0), 1), np.minimum.accumulate(np.where(last, place + 1, len(place))[:, ::-1], 1)[:, ::-1]


def _begins(x: np.ndarray) -> np.ndarray:
    """Whether a place of sorted rows differs from the one before; NaN equals NaN."""
    new = np.ones(x.shape, bool)
    new[:, 1:] = (x[:, 1:] != x[:, :-1]) & ~(np.isnan(x[:, 1:]) & np.isnan(x[:, :-1]))
    return new


def _comb_ratios(a: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """comb_ratio of whole numbers from 0."""
    out = np.ones(np.broadcast_shapes(a.shape, r.shape))
    for i in range(int(r.max(initial=0))):
        out = np.where(i < r, out * (a - i) / np.maximum(n - i, 1), out)
    return out


def of_fronts(score: np.ndarray, target: np.ndarray, ks: Sequence[int]) -> dict[str, np.ndarray]:
    """The long metrics of fronts of one size, a row each (fronts x items), without nulls: no windows, all fronts at once."""
    n = score.shape[1]
    place, by = np.arange(n), np.argsort(target, 1, kind="stable")
    up, own = (np.take_along_axis(x, by, 1) for x in (target, score))
    at = np.argsort(-own, 1, kind="stable")
    own, goal, best = np.take_along_axis(own, at, 1), np.take_along_axis(up, at, 1), up[:, -1:]
    start, end = _ends(_begins(own))
    near = (np.abs(goal - best) <= 1e-8 + 1e-5 * np.abs(best)) | np.isnan(best)
    most, bests = np.maximum.accumulate(goal, 1), np.cumsum(near, 1)
    total = np.concatenate([np.zeros((len(goal), 1)), np.cumsum(goal, 1)], 1)
    gain = (np.take_along_axis(total, end, 1) - np.take_along_axis(total, start, 1)) / (end - start)
    dcg, ideal = (np.cumsum(x / np.log2(place + 2.0), 1) for x in (gain, up[:, ::-1]))
    out = {}
    for k in (k for k in ks if k <= n):
        value, hit = most[:, k - 1].copy(), (bests[:, k - 1] > 0).astype(float)
        cut = np.flatnonzero(end[:, k - 1] > k)  # fronts whose place k lies inside a block
        if len(cut):
            a, b = start[cut, k - 1][:, None], (end - start)[cut, k - 1][:, None]
            r, j = k - a, np.clip(place - a + 1, 0, b)
            share = _comb_ratios(j, r, b) - _comb_ratios(np.maximum(j - 1, 0), r, b)
            before = np.maximum(a - 1, 0)
            floor = np.where(a > 0, np.take_along_axis(most[cut], before, 1), -np.inf)
            value[cut] = np.where((place >= a) & (place < a + b), np.maximum(goal[cut], floor) * share, 0.0).sum(1)
            known = np.where(a > 0, np.take_along_axis(bests[cut], before, 1), 0)
            mine = np.take_along_axis(bests[cut], a + b - 1, 1) - known
            hit[cut] = 1 - np.where(known > 0, 0.0, _comb_ratios(b - mine, r, b))[:, 0]
        out |= {f"Regret@{k}": np.maximum(best[:, 0] - value, 0.0), f"BestTarget@{k}": value, f"Hit@{k}": hit}
        if n > 1:
            out[f"NDCG@{k}"] = np.where(ideal[:, k - 1] == 0, 0.0, dcg[:, k - 1] / np.where(ideal[:, k - 1] == 0, 1.0, ideal[:, k - 1]))
    x = n - (start + end + 1) / 2 + 1 - (n + 1) / 2
    first, behind = _ends(_begins(up))
    y = np.take_along_axis((first + behind + 1) / 2, at, 1) - (n + 1) / 2
    spread = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return out | {"Spearman": np.where(spread > 0, (x * y).sum(1) / np.where(spread > 0, spread, 1), 0.0)}


def _packed_metrics(df: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """long_metrics of fronts that come as rows with arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys)), batch.column(len(keys) + 1)
            sizes = np.asarray(lists[0].value_lengths(), np.int64)
            begin = np.cumsum(sizes) - sizes
            score, target = (np.asarray(x.flatten(), np.float64) for x in lists)
            for n in np.unique(sizes[sizes > 0]):
                same = np.flatnonzero(sizes == n)
                for some in np.array_split(same, -(-len(same) * n // PLACES)):
                    at = begin[some][:, None] + np.arange(n)
                    found = of_fronts(score[at], target[at], ks)
                    own = [batch.column(i).take(pa.array(np.tile(some, len(found)))) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(list(found), len(some))), pa.array(np.concatenate(list(found.values())))], [*keys, "metric", "value"])

    types = dict(df.dtypes)
    return df.select(*keys, SCORE, TARGET).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", metric string, value double")


#: Places of fronts that are worked at once in a task.
PLACES = 1 << 16


def long_metrics(df: DataFrame, ks: Sequence[int] = KS, over: Sequence[str] = ()) -> DataFrame:
    """front, metric, value for Regret@k, BestTarget@k, Hit@k, NDCG@k and Spearman; absent where k exceeds the front.

    Where score and target are arrays, a row is a whole front, and there is nothing to group or sort. Such arrays hold no nulls.
    """
    keys = _keys(df, over)
    if dict(df.dtypes)[SCORE].startswith("array"):
        return _packed_metrics(df, keys, ks)
    name = lambda text: F.concat(F.lit(f"{text}@"), F.col("k").cast("string"))
    three = F.array(*[F.struct(name(label).alias("metric"), F.col(c).alias("value")) for label, c in (("Regret", "regret"), ("BestTarget", "best_target"), ("Hit", "hit"))])
    top = top_k(df, ks, over).select(*keys, F.explode(three).alias("m")).select(*keys, "m.metric", "m.value")
    gains = ndcg(df, ks, over).select(*keys, name("NDCG").alias("metric"), F.col("ndcg").alias("value")).filter("value IS NOT NULL")
    ranks = spearman(df, over).select(*keys, F.lit("Spearman").alias("metric"), F.col("spearman").alias("value"))
    return top.unionByName(gains).unionByName(ranks)


def front_mean(metrics: DataFrame, over: Sequence[str] = ()) -> DataFrame:
    """Plain mean over fronts that have the metric: fronts count alike, whatever their size."""
    return metrics.groupBy(*over, "metric").agg(exact_mean("value").alias("value"), F.count("value").alias("n_fronts"))


def evaluate(ranked: DataFrame, ks: Sequence[int] = KS, over: Sequence[str] = ()) -> DataFrame:
    """Checks a ranked table, then gives the mean of every metric; Regret@5 must be among them."""
    if 5 not in ks:
        raise ValueError("Regret@5 is the primary metric: ks must hold 5")
    return front_mean(long_metrics(ranked, ks, over), over)
