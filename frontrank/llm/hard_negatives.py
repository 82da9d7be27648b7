"""Hard negatives by an inverted multi-index over integer vectors.

A vector's two halves have a codebook each, fitted by k-means to a bounded sample (SAMPLE rows, chosen by a hash of the id);
a pair of codes is a cell. Every row is indexed. Each code knows the largest distance of a member's half from its centre,
so for an anchor's half q a member scores at most q.c + r|q| and at least q.c - r|q|, and a cell's bound is the sum of its
halves' bounds. A multi-sequence heap visits the cells of an anchor by falling bound. It stops where the bound is certified:
nothing beyond can reach the score that is wanted. So the results are exact, and recall is 1.

Positives and negatives are found by the same two visits. The first takes cells in order until PROBE rows are covered; their
best scores give a floor; the second goes on in the same order until the bound is under that floor. For negatives the
windows of an anchor's positives are also bounded from above: cells whose lower bound is over all windows are left out.

Cells are stored as blocks of at most about PART rows, and anchors come to them in groups of at most GROUP, so work on a
hot cell (one vector many times) is split, and each joined row is a product of two small matrices. Only bounds, counts of
cells (at most CODES x CODES) and the sample pass through the driver.

Rows without id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are filled with
zeros. Scores are exact below 2**53; components that could pass it are an error. Rows that repeat are rows of their own, an anchor's other rows included; equal scores go by the smaller vec_id. Anchors
without positives, and windows without rows (all windows of negative scores), give nothing. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontrank.llm.common import read, small_batches, written

#: Rows that the codebooks are fitted to, at most twice that; codes of a half; steps of k-means.
SAMPLE, CODES, STEPS = 8192, 256, 8
#: Rows of a block, anchors of a group, rows that a first visit covers.
PART, GROUP, PROBE = 512, 256, 2048
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_ROW = "row long, vec_id long, label long, vec binary, i int, j int, far_i double, far_j double"


def fitted(half: np.ndarray, codes: int) -> np.ndarray:
    """Centres of k-means on the rows of half."""
    rng = np.random.default_rng(7)
    centres = half[rng.choice(len(half), min(codes, len(half)), replace=False)]
    for _ in range(STEPS):
        near = nearest(half, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, half)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * half @ centres.T, axis=1)


@dataclass
class Index:
    """Codebooks of both halves with radii, the rows of each cell, and how vectors are stored."""

    dims: int
    kind: str
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    counts: np.ndarray | None = None

    def matrix(self, data: bytes, rows: int) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(rows, self.dims).astype(np.float64)

    def parts(self) -> np.ndarray:
        return -(-self.counts // PART)

    def bounds(self, vec: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the upper and lower bounds of its codes, with room for rounding."""
        upper, lower, at = [], [], self.dims // 2
        for half, book, radius in zip((vec[:at], vec[at:]), self.books, self.radii, strict=True):
            middle, length = book @ half, np.sqrt(half @ half)
            slack = radius * length * (1 + 1e-9) + 1e-9 * (np.abs(middle) + length) + 1e-6
            upper.append(middle + slack), lower.append(middle - slack)
        return upper, lower

    def visit(self, vec: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """Upper bound, lower bound and codes of each cell that has rows, by falling upper bound."""
        (up_i, up_j), (low_i, low_j) = self.bounds(vec)
        by_i, by_j = np.argsort(-up_i), np.argsort(-up_j)
        heap = [(-(up_i[by_i[0]] + up_j[by_j[0]]), 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = by_i[a], by_j[b]
            if self.counts[i, j]:
                yield -bound, low_i[i] + low_j[j], int(i), int(j)
            if b + 1 < len(by_j):
                heapq.heappush(heap, (-(up_i[i] + up_j[by_j[b + 1]]), a, b + 1))
            if b == 0 and a + 1 < len(by_i):
                heapq.heappush(heap, (-(up_i[by_i[a + 1]] + up_j[j]), a + 1, 0))


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    picked = rows.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    return picked.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").filter(~F.exists("vec", odd))


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Components as floor(256 x), shorter vectors filled with zeros."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(256 * np.asarray(column.flatten(), np.float64))
    return out


def assigned(rows: DataFrame, index: Index) -> DataFrame:
    """Each row with its number, its cell, and how far its halves are from their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId() << 33, index.dims // 2
        for batch in batches:
            vec = vectors(batch.column(2), index.dims)
            codes, far = [], []
            for half, book in zip((vec[:, :at], vec[:, at:]), index.books, strict=True):
                codes.append(nearest(half, book))
                far.append(np.sqrt(((half - book[codes[-1]]) ** 2).sum(1)))
            n = len(vec)
            stored = [v.tobytes() for v in vec.astype(index.kind)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), batch.column(0), batch.column(1), pa.array(stored, pa.binary()), *(pa.array(c, pa.int32()) for c in codes), *map(pa.array, far)], ["row", "vec_id", "label", "vec", "i", "j", "far_i", "far_j"])
            number += n

    return small_batches(rows).mapInArrow(run, _ROW)


def built(rows: DataFrame) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index of usable rows, its rows, and its blocks; None without rows."""
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(F.lit(256) * x))))).first()
    if not n:
        return None
    most = (most or 0.0) + 1
    if dims * most * most >= 2**53:
        raise ValueError("components are too large for exact scores")
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < SAMPLE).limit(2 * SAMPLE)
    if n <= 2 * SAMPLE:
        some = rows
    found = some.select("vec").toArrow().column(0).combine_chunks()
    sample = vectors(found, dims) if len(found) else np.zeros((1, dims))
    codes = int(np.clip(round(n**0.25), 4, CODES))
    index = Index(dims, kind, (fitted(sample[:, : dims // 2], codes), fitted(sample[:, dims // 2 :], codes)))
    table = written(assigned(rows, index), "hard-negatives")
    cells = table.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("far_i").alias("far_i"), F.max("far_j").alias("far_j")).collect()  # at most CODES x CODES
    index.counts = np.zeros((len(index.books[0]), len(index.books[1])), np.int64)
    index.radii = (np.zeros(len(index.books[0])), np.zeros(len(index.books[1])))
    for c in cells:
        index.counts[c["i"], c["j"]] = c["n"]
        index.radii[0][c["i"]] = max(index.radii[0][c["i"]], c["far_i"])
        index.radii[1][c["j"]] = max(index.radii[1][c["j"]], c["far_j"])
    return index, table, written(blocks(table, index), "hard-negative-blocks")


def blocks(table: DataFrame, index: Index) -> DataFrame:
    """i, j, part and the rows of each block on end."""
    spark = table.sparkSession
    many = [(int(i), int(j), int(index.parts()[i, j])) for i, j in np.argwhere(index.counts > 0)]
    parts = F.broadcast(spark.createDataFrame(many, "i int, j int, parts int"))  # a row for each cell

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        one = lambda c: np.asarray(rows.column(c), np.int64).tobytes()
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int32()), "rows": [one("row")], "ids": [one("vec_id")], "labels": [one("label")], "vecs": [b"".join(rows.column("vec").to_pylist())]})

    dealt = table.join(parts, ["i", "j"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return dealt.select("i", "j", "part", "row", "vec_id", "label", "vec").groupBy("i", "j", "part").applyInArrow(run, "i int, j int, part int, rows binary, ids binary, labels binary, vecs binary")


def visits(anchors: DataFrame, index: Index, first: bool) -> DataFrame:
    """Groups of anchors for each block that they visit: the first visit up to PROBE rows, else from there to the certified stop.

    anchors: row, label, vec and arrays floors, lows, highs; a cell matters to an anchor if its bounds reach into one of the
    windows from floors to highs. lows are the windows' own lower ends, which the first visit reckons with.
    """

    def wanted(vec: np.ndarray, floors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, int]]:
        covered = 0
        for upper, lower, i, j in index.visit(vec):
            if upper < (lows if covered < PROBE else floors).min():
                return
            if covered < PROBE:
                if first and (lower <= highs).any():
                    yield i, j
            elif first:
                return
            elif ((upper >= floors) & (lower <= highs)).any():
                yield i, j
            if (lower <= highs).any():
                covered += index.counts[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = index.parts()
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                group = batch.slice(k, GROUP)
                vec = group.column(2).to_pylist()
                windows = [[np.array(x) for x in group.column(c).to_pylist()] for c in (3, 4, 5)]
                of: dict[tuple[int, int], list[int]] = defaultdict(list)
                for a, v in enumerate(vec):
                    if len(windows[0][a]):
                        for cell in wanted(index.matrix(v, 1)[0], windows[0][a], windows[1][a], windows[2][a]):
                            of[cell].append(a)
                for (i, j), own in of.items():
                    picked = group.take(pa.array(own))
                    n = int(parts[i, j])
                    whole = [np.asarray(picked.column(c), np.int64).tobytes() for c in (0, 1)]
                    width = max(len(windows[0][a]) for a in own)
                    ends = [np.array([np.pad(w[a], (0, width - len(w[a])), constant_values=odd) for a in own]).tobytes() for w, odd in ((windows[0], np.inf), (windows[2], -np.inf))]
                    one = [*whole, b"".join(vec[a] for a in own), *ends]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), pa.array(np.full(n, j), pa.int32()), pa.array(np.arange(n), pa.int32()), *(pa.array([x] * n, pa.binary()) for x in one)], ["i", "j", "part", "anchors", "own", "points", "floors", "highs"])

    return anchors.select("row", "label", "vec", "floors", "lows", "highs").mapInArrow(run, "i int, j int, part int, anchors binary, own binary, points binary, floors binary, highs binary")


def scored(pairs: DataFrame, index: Index, same: bool, most: int) -> DataFrame:
    """anchor, window, score, vec_id: of each pair of group and block the best rows of each window, with the anchor's label or others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for *numbers, points, vecs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchors", "own", "rows", "ids", "labels", "floors", "highs", "points", "vecs")), strict=True):
                anchors, own, rows, ids, labels = (np.frombuffer(x, np.int64) for x in numbers[:5])
                floors, highs = (np.frombuffer(x, np.float64).reshape(len(anchors), -1) for x in numbers[5:])
                a, b = index.matrix(points, len(anchors)), index.matrix(vecs, len(rows))
                scores = a @ b.T
                fits = (own[:, None] == labels) == same
                fits &= anchors[:, None] != rows
                fits &= scores >= floors.min(1)[:, None]
                for k in np.flatnonzero(fits.any(1)):
                    at = np.flatnonzero(fits[k])
                    at = at[np.lexsort((ids[at], -scores[k, at]))]
                    s = scores[k, at]
                    for w in range(floors.shape[1]):
                        best = np.flatnonzero((s >= floors[k, w]) & (s <= highs[k, w]))[:most]
                        out.append((np.full(len(best), anchors[k]), np.full(len(best), w), s[best].astype(np.int64), ids[at[best]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "window", "score", "vec_id"])

    return pairs.mapInArrow(run, "anchor long, window int, score long, vec_id long")


def best_rows(anchors: DataFrame, index: Index, stored: DataFrame, same: bool, most: int, label: str) -> DataFrame:
    """anchor, window, nth, score, vec_id: the best `most` rows of each window of anchors (row, label, vec, lows, highs), exactly."""

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)

    def visited(asking: DataFrame, first: bool) -> DataFrame:
        return scored(visits(asking, index, first).join(stored, ["i", "j", "part"]), index, same, most)

    probe = written(ranked(visited(anchors.withColumn("floors", F.col("lows")), True)), label)
    full = probe.filter(F.col("nth") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("reached"))  # a row for each window
    floors = F.transform("lows", lambda low, w: F.coalesce(F.try_element_at("reached", w), low))
    rest = anchors.join(full, anchors["row"] == full["anchor"], "left").withColumn("floors", F.when(F.col("reached").isNull(), F.col("lows")).otherwise(floors))
    return ranked(probe.drop("nth").unionByName(visited(rest, False)))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each row where `anchor` holds and each of its first positives, the first rows of other labels that score from low to high per cent of it.

    rows: vec_id, label and vec, as `usable` gives them.
    """
    found = built(rows)
    if not found:
        return rows.sparkSession.createDataFrame([], _RESULT)
    index, table, stored = found
    asking = table.filter(anchor).select("row", "vec_id", "label", "vec")
    asking = asking.repartition(max(1, -(-asking.count() // GROUP)), F.xxhash64("row"))
    anywhere = [F.array(F.lit(x)).alias(name) for name, x in (("lows", float("-inf")), ("highs", float("inf")))]
    first = best_rows(asking.select("row", "label", "vec", *anywhere), index, stored, True, positives, "hard-positives")
    first = written(first.select("anchor", "nth", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "hard-positives")
    window = lambda name, end: F.transform("found", lambda x: end(x["positive_score"])).alias(name)
    lowest, highest = (lambda s: F.ceil(low * s / F.lit(100.0)).cast("double")), (lambda s: F.floor(high * s / F.lit(100.0)).cast("double"))
    windows = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("found"))  # a few positives each
    second = asking.join(windows, asking["row"] == windows["anchor"]).select("row", "label", "vec", window("lows", lowest), window("highs", highest))
    second = best_rows(second, index, stored, False, negatives, "hard-windows")
    ids = asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = second.select("anchor", (F.col("window") + 1).alias("nth"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["anchor", "nth"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100; where it is divisible by 7, the label first becomes (label + 1) % 10."""
    label: Callable[[], Column] = lambda: F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(read(spark, sf_dir, "embeddings"), label()), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
