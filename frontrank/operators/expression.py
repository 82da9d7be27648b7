"""Features of expression-style matrices in long form (front_id, gene, cond, value), all matrices in the same jobs."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import EPS_EXPRESSION, bias_corrected_kurtosis, bias_corrected_skew, pearson
from frontrank.sources.tables import materialized

FRONT = "front_id"


def complete(cells: DataFrame) -> DataFrame:
    """Every gene and condition of a matrix, with null where no cell is given."""
    genes, conds = (cells.select(FRONT, c).distinct() for c in ("gene", "cond"))
    return genes.join(conds, FRONT).join(cells, [FRONT, "gene", "cond"], "left")


def global_features(cells: DataFrame) -> DataFrame:
    """Genes, conditions, mean, population std, min, max, missing and zero share, corrected skew and kurtosis."""
    v = F.col("value")
    n = F.count(v).cast("double")
    all_ = F.count("*")
    return cells.groupBy(FRONT).agg(
        F.count_distinct("gene").alias("n_genes"), F.count_distinct("cond").alias("n_conditions"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.count_if(v.isNull()) / all_).alias("missing"), (F.count_if(v == 0) / all_).alias("zeros"), bias_corrected_skew(v, n).alias("skew"), bias_corrected_kurtosis(v, n).alias("kurtosis"),
    )


def _five(c: str) -> list[Column]:
    return [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), *[F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}") for p in (10, 50, 90)]]


def _per(cells: DataFrame, key: str) -> DataFrame:
    v = F.col("value")
    each = cells.groupBy(FRONT, key).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.count_if(v == 0) / F.count("*")).alias("zeros"), (F.count_if(v.isNull()) / F.count("*")).alias("missing"))
    return each.withColumn("cv", F.col("std") / (F.nullif("mean", F.lit(0.0)) + EPS_EXPRESSION))


def gene_features(cells: DataFrame) -> DataFrame:
    """Mean, std and variation of each gene, summed up over genes."""
    each = _per(cells, "gene")
    return each.groupBy(FRONT).agg(*[x for c in ("mean", "std", "cv", "zeros", "missing") for x in _five(c)])


def condition_features(cells: DataFrame) -> DataFrame:
    """The same over conditions, and the largest |z| of a condition's mean."""
    w = Window.partitionBy(FRONT)
    each = _per(cells, "cond").withColumn("z", F.abs(F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_pop("mean").over(w))))
    return each.groupBy(FRONT).agg(*[x for c in ("mean", "std", "cv", "zeros", "missing") for x in _five(c)], F.max("z").alias("max_z"))


#: Vectors of a tile, and values of each that a tile holds.
TILE, SPAN = 256, 512
#: Tiles of a side that meet in one task at most, where all places are one span and where sums must wait for further spans; and
#: into how many groups a front's tiles are dealt at least. A tile is sent once for each group.
SIDE, WAITING, GROUPS = 16, 4, 8


def _numbered(cells: DataFrame, key: str) -> DataFrame:
    """(front, key, at): the keys of each front counted from 0."""
    return cells.select(FRONT, key).distinct().withColumn("at", F.row_number().over(Window.partitionBy(FRONT).orderBy(key)) - 1)


def _pair_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared cells, sums, sums of squares and of products for each row of x with each row of y; NaN is no value."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y, mx, my = np.nan_to_num(x), np.nan_to_num(y), mx.astype(float), my.astype(float)
    return np.stack([mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T])


def _pair_rows(front: int, a: int, b: int, sums: np.ndarray) -> pa.RecordBatch:
    """Pairs of two tiles whose first vectors are a and b."""
    n, x, y, xx, yy, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
        flat = (vx <= 1e-13 * (xx / n)) | (vy <= 1e-13 * (yy / n))
        r = np.where(flat, np.nan, (xy / n - x / n * y / n) / np.sqrt(vx * vy))
    i, j = np.nonzero((n >= 2) & ~np.isnan(r) & ((a < b) | (np.arange(n.shape[0])[:, None] < np.arange(n.shape[1]))))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), front), pa.int64()), pa.array(a + i, pa.int64()), pa.array(b + j, pa.int64()), pa.array(r[i, j])], [FRONT, "i", "j", "r"])


def _tile_pairs(cells: DataFrame, key: str, other: str) -> DataFrame:
    """(front, i, j, r) of all pairs of numbered keys. What is shuffled are tiles, once for each group of tiles that they meet.

    A tile holds TILE vectors over SPAN places of the other side, each vector less its mean. Two groups of tiles come to one
    task, span by span in order, and sums of each two tiles are added up there.
    """
    left, right = _numbered(cells, key), _numbered(cells, other)
    mean = F.avg("value").over(Window.partitionBy(FRONT, key))  # a vector
    placed = cells.withColumn("value", F.col("value") - mean).join(left.withColumnRenamed("at", "row"), [FRONT, key]).join(right.withColumnRenamed("at", "col"), [FRONT, other])
    cell = F.struct((F.col("row") % TILE).cast("int").alias("r"), (F.col("col") % SPAN).cast("int").alias("c"), F.col("value").alias("v"))
    tiles = placed.groupBy(FRONT, F.floor(F.col("row") / TILE).alias("tile"), F.floor(F.col("col") / SPAN).alias("span")).agg(F.collect_list(cell).alias("cells"))  # TILE x SPAN cells at most
    counts = left.groupBy(FRONT).agg(F.ceil(F.count("*") / TILE).alias("tiles")).join(right.groupBy(FRONT).agg(F.ceil(F.count("*") / SPAN).alias("spans")), FRONT)
    most = F.when(F.col("spans") > 1, WAITING).otherwise(SIDE)
    counts = counts.withColumn("size", F.greatest(F.lit(1), F.least(most, F.floor(F.col("tiles") / GROUPS))))
    met = tiles.join(counts, FRONT).withColumns({"own": F.floor(F.col("tile") / F.col("size")), "with": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tiles") - 1) / F.col("size"))))})
    sides = F.when(F.col("own") == F.col("with"), F.array(F.lit(0), F.lit(1))).when(F.col("own") < F.col("with"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    sent = met.select(FRONT, F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "span", F.explode(sides).alias("side"), "tile", "spans", F.col("cells.r").alias("r"), F.col("cells.c").alias("c"), F.col("cells.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, ({}, {}), {}

        def met() -> Iterator[pa.RecordBatch]:
            front, spans = now[0], now[4]
            for a, x in held[0].items():
                for b, y in held[1].items():
                    if a <= b:
                        wide = min(x.shape[1], y.shape[1])  # no value behind it is shared
                        more = _pair_sums(x[:, :wide], y[:, :wide])
                        if spans == 1:
                            yield _pair_rows(front, a * TILE, b * TILE, more)
                        else:
                            sums[a, b] = sums[a, b] + more if (a, b) in sums else more

        def rest() -> Iterator[pa.RecordBatch]:
            for (a, b), x in sums.items():
                yield _pair_rows(now[0], a * TILE, b * TILE, x)
            sums.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                front, a, b, span, side, tile, spans = (batch.column(c)[k].as_py() for c in range(7))
                at = front, a, b, span, spans
                if now != at:
                    if now is not None:
                        yield from met()
                        if now[:3] != at[:3]:
                            yield from rest()
                    now, held = at, ({}, {})
                rows, places = (np.asarray(batch.column(c)[k].values) for c in (7, 8))
                vectors = np.full((TILE, places.max() + 1), np.nan)
                vectors[rows, places] = np.asarray(batch.column(9)[k].values.to_numpy(zero_copy_only=False), float)
                held[side][tile] = vectors
        if now is not None:
            yield from met()
            yield from rest()

    return sent.repartition(FRONT, "a", "b").sortWithinPartitions(FRONT, "a", "b", "span", "side", "tile").mapInArrow(run, f"{FRONT} long, i long, j long, r double")


def _drawn_pairs(numbered: DataFrame, sample: int, seed: int) -> DataFrame:
    """(front, i, j): `sample` different pairs of each front's numbers, all where there are fewer; drawn before any cell is met.

    Pairs have numbers from 0 to total - 1; every step-th of them, step prime to total, comes in turn.
    """
    rng = random.Random(seed)
    start, stride = rng.random(), rng.randrange(1 << 40)
    n = numbered.groupBy(FRONT).agg(F.count("*").alias("n")).withColumn("total", F.expr("n * (n - 1) div 2")).filter("total > 0")

    def draw(front: pd.Series, n: pd.Series, total: pd.Series) -> pd.DataFrame:
        out = []
        for f, size, all_ in zip(front, n, total, strict=True):
            size, all_ = int(size), int(all_)
            step = stride % all_ or 1
            while gcd(step, all_) > 1:
                step = step % all_ + 1
            p = (int(start * all_) + step * np.arange(min(sample, all_), dtype=object)) % all_
            p = p.astype(np.int64)
            j = ((1 + np.sqrt(1 + 8.0 * p)) // 2).astype(np.int64)
            j = np.where(j * (j - 1) // 2 > p, j - 1, j)
            j = np.where((j + 1) * j // 2 <= p, j + 1, j)
            out.append(pd.DataFrame({FRONT: f, "i": p - j * (j - 1) // 2, "j": j}))
        return pd.concat(out)

    return n.select(FRONT, "n", "total").mapInPandas(lambda frames: (draw(x[FRONT], x["n"], x["total"]) for x in frames if len(x)), f"{FRONT} long, i long, j long")


def _numbered_pairs(cells: DataFrame, key: str, sample: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(front, i, j, r) of pairs, and (front, key, at): what the numbers stand for."""
    other = "cond" if key == "gene" else "gene"
    known = cells.filter("value IS NOT NULL").select(FRONT, "gene", "cond", F.col("value").cast("double").alias("value"))
    names = _numbered(known, key)
    if sample is None:
        r = _tile_pairs(known, key, other)
    else:
        row = known.join(names, [FRONT, key])
        x, y = (row.select(FRONT, F.col("at").cast("long").alias(side), other, F.col("value").alias(v)) for side, v in (("i", "x"), ("j", "y")))
        joined = _drawn_pairs(names, sample, seed).join(x, [FRONT, "i"]).join(y, [FRONT, "j", other])
        r = joined.groupBy(FRONT, "i", "j").agg(F.count("*").alias("n"), pearson(F.col("x"), F.col("y")).alias("r")).filter("n >= 2 AND r IS NOT NULL")
    return r, names


def correlations(cells: DataFrame, key: str = "gene", sample: int | None = None, seed: int = 0) -> DataFrame:
    """(front, a, b, r) for pairs of genes over shared conditions (or the reverse), two shared cells at least.

    All pairs go by tiles; with sample, that many pairs of each front are drawn first, and only their cells are joined.
    """
    r, names = _numbered_pairs(cells, key, sample, seed)
    a, b = (names.select(FRONT, F.col("at").cast("long").alias(at), F.col(key).alias(name)) for at, name in (("i", "a"), ("j", "b")))
    return r.join(a, [FRONT, "i"]).join(b, [FRONT, "j"]).select(FRONT, "a", "b", "r")


def correlation_features(cells: DataFrame, key: str = "gene", sample: int | None = None) -> DataFrame:
    r = _numbered_pairs(cells, key, sample)[0].withColumn("m", F.abs("r"))
    plain = r.groupBy(FRONT).agg(F.avg("r").alias(f"{key}_r_mean"), F.stddev_pop("r").alias(f"{key}_r_std"), F.avg("m").alias(f"{key}_r_abs_mean"))
    return plain.join(bounded_percentile(r, "m", 0.9, f"{key}_r_abs_p90"), FRONT, "left")


#: Bins of the values 0 to 1 that a percentile of many rows is sought in.
FINE = 1 << 16
#: Rows that are broadcast at most.
FEW = 1 << 16


def bounded_percentile(df: DataFrame, c: str, p: float, name: str) -> DataFrame:
    """(front, name): the exact percentile of values in 0 to 1, in two passes over df; no group holds all values of a front.

    The first pass, run at once, counts rows of FINE bins; the second counts the values of the one or two bins where the percentile lies.
    """
    binned = df.select(FRONT, F.col(c).alias("m"), F.floor(F.col(c) * FINE).alias("bin"))
    whole, upward = Window.partitionBy(FRONT), Window.partitionBy(FRONT).orderBy("bin")  # FINE rows of a front at most
    bins = binned.groupBy(FRONT, "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumns({"before": F.sum("n").over(upward) - F.col("n"), "at": (F.sum("n").over(whole) - 1) * F.lit(p)})
    bins = bins.withColumns({"lo": F.floor("at"), "hi": F.ceil("at")}).filter("before <= hi AND before + n > lo")
    bins = materialized(bins, "bins")  # one or two rows of a front: beside them no row of df needs to move
    values = binned.join(F.broadcast(bins) if bins.count() <= FEW else bins, [FRONT, "bin"]).groupBy(FRONT, "bin", "before", "at", "lo", "hi", "m").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(FRONT, "bin").orderBy("m")))
    ends = [F.coalesce(F.min(F.when(F.col("upto") > F.col(x), F.col("m"))), F.max("m")).alias(f"at_{x}") for x in ("lo", "hi")]
    found = values.groupBy(FRONT, "at", "lo", "hi").agg(*ends)
    between = (F.col("hi") - F.col("at")) * F.col("at_lo") + (F.col("at") - F.col("lo")) * F.col("at_hi")
    return found.select(FRONT, F.when(F.col("lo") == F.col("hi"), F.col("at_lo")).otherwise(between).alias(name))


#: Numbers of Gram matrices that a task holds before it hands them on.
HELD = 1 << 22


def _gram(cells: DataFrame, center: str, other: str) -> DataFrame:
    """(front, size, gram): partial Gram matrices over `center`, one for each front and task, of the centered cells."""
    means = cells.groupBy(FRONT, center).agg(F.avg("value").alias("mean"))
    at = F.row_number().over(Window.partitionBy(FRONT).orderBy(center)) - 1  # a row for each place of the matrix
    means = means.withColumns({"at": at, "size": F.count("*").over(Window.partitionBy(FRONT))})
    centered = cells.join(means, [FRONT, center]).select(FRONT, other, "size", F.struct("at", (F.col("value") - F.col("mean")).alias("v")).alias("x")).filter("x.v IS NOT NULL")
    rows = centered.groupBy(FRONT, other).agg(F.first("size").alias("size"), F.collect_list("x").alias("x")).select(FRONT, "size", "x.at", "x.v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([len(g) for g in total.values()], pa.int32()), pa.array([g.tobytes() for g in total.values()], pa.binary())], [FRONT, "size", "gram"])

        for batch in batches:
            front, size = (np.asarray(batch.column(c), np.int64) for c in (0, 1))
            ends = np.asarray(batch.column(2).offsets, np.int64)
            ends, at, v = ends - ends[0], np.asarray(batch.column(2).flatten(), np.int64), np.asarray(batch.column(3).flatten())
            for f in np.unique(front):
                own = np.flatnonzero(front == f)
                step = max(1, HELD // int(size[own[0]]))
                for some in (own[k : k + step] for k in range(0, len(own), step)):
                    m = np.zeros((len(some), int(size[some[0]])))
                    for line, k in enumerate(some):
                        m[line, at[ends[k] : ends[k + 1]]] = v[ends[k] : ends[k + 1]]
                    total[int(f)] = total.get(int(f), 0) + m.T @ m
            if sum(g.size for g in total.values()) > HELD:
                yield out()
                total.clear()
        if total:
            yield out()

    return rows.mapInArrow(run, f"{FRONT} long, size int, gram binary")


def spectrum(cells: DataFrame, center: str = "cond") -> DataFrame:
    """(front, place, eigenvalue) of the centered matrix's Gram matrix over conditions, missing cells 0 after centering.

    Tasks add up outer products of the rows they have; only such partial sums meet, for each front in one task. A front
    whose cells are all missing has none.
    """

    def solve(table: pa.Table) -> pa.Table:
        n = table.column("size")[0].as_py()
        gram = np.sum([np.frombuffer(x).reshape(n, n) for x in table.column("gram").to_pylist()], axis=0)
        values = np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)
        return pa.table({FRONT: pa.array([table.column(FRONT)[0].as_py()] * n, pa.int64()), "place": pa.array(range(1, n + 1), pa.int32()), "eigenvalue": values})

    return _gram(cells, center, "gene" if center == "cond" else "cond").groupBy(FRONT).applyInArrow(solve, f"{FRONT} long, place int, eigenvalue double")


def effective_rank(values: DataFrame, value: str = "eigenvalue") -> DataFrame:
    """exp of the entropy of the shares."""
    p = values.withColumn("p", F.try_divide(value, F.sum(value).over(Window.partitionBy(FRONT))))
    return p.groupBy(FRONT).agg(F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("effective_rank"))


def pca_features(cells: DataFrame, top: int = 5, center: str = "cond") -> DataFrame:
    """Variance share of the first axes, effective rank, and condition number (stable for full-rank input only)."""
    s = spectrum(cells, center)
    out = s.groupBy(FRONT).agg(F.try_divide(F.sum(F.when(F.col("place") <= top, F.col("eigenvalue")).otherwise(0.0)), F.sum("eigenvalue")).alias("top_share"), F.sqrt(F.try_divide(F.max("eigenvalue"), F.nullif(F.min("eigenvalue"), F.lit(0.0)))).alias("condition_number"))
    return out.join(effective_rank(s), FRONT)


def autocorrelation(cells: DataFrame, lag: int = 1) -> DataFrame:
    """(front, gene, r) with the value `lag` places before, among cells that aren't missing."""
    w = Window.partitionBy(FRONT, "gene").orderBy("cond")
    known = cells.filter("value IS NOT NULL").withColumn("y", F.lag("value", lag).over(w)).filter("y IS NOT NULL")
    x, y = F.col("value"), F.col("y")
    r = F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y) + EPS_EXPRESSION)
    return known.groupBy(FRONT, "gene").agg(F.count("*").alias("n"), r.alias("r")).filter("n >= 2").drop("n")


def trends(cells: DataFrame) -> DataFrame:
    """(front, gene, slope, r2) of a line over the places of cells that aren't missing."""
    w = Window.partitionBy(FRONT, "gene").orderBy("cond")
    known = cells.filter("value IS NOT NULL").withColumn("t", (F.row_number().over(w) - 1).cast("double"))
    slope = F.regr_slope("value", "t")
    s = known.groupBy(FRONT, "gene").agg(F.count("*").alias("n"), slope.alias("slope"), F.regr_syy("value", "t").alias("tot"), F.regr_sxx("value", "t").alias("sxx"))
    rest = F.col("tot") - F.col("slope") * F.col("slope") * F.col("sxx")
    return s.filter("n >= 2").select(FRONT, "gene", "slope", (1 - rest / (F.col("tot") + EPS_EXPRESSION)).alias("r2"))


def time_features(cells: DataFrame, lag: int = 1) -> DataFrame:
    """Over genes: autocorrelation mean and median, slope mean and p90, mean R2, share of all genes that rise."""
    genes = cells.select(FRONT, "gene").distinct()
    both = genes.join(autocorrelation(cells, lag), [FRONT, "gene"], "left").join(trends(cells), [FRONT, "gene"], "left")
    return both.groupBy(FRONT).agg(
        F.avg("r").alias("auto_mean"), F.percentile("r", F.lit(0.5)).alias("auto_median"), F.avg("slope").alias("slope_mean"), F.percentile("slope", F.lit(0.9)).alias("slope_p90"), F.avg("r2").alias("r2_mean"), (F.count_if(F.col("slope") > 0) / F.count("*")).alias("rising")
    )


BLOCKS = {"global": global_features, "gene": gene_features, "condition": condition_features, "gene_r": correlation_features, "cond_r": lambda c: correlation_features(c, "cond"), "pca": pca_features, "time": time_features}


def expression_features(cells: DataFrame, blocks: Sequence[str] = tuple(BLOCKS)) -> DataFrame:
    """The chosen blocks side by side, a row for each matrix; columns get the prefix expr_<block>_."""

    def named(b: str) -> DataFrame:
        df = BLOCKS[b](cells)
        return df.select(FRONT, *[F.col(c).alias(f"expr_{b}_{c}") for c in df.columns if c != FRONT])

    return reduce(lambda a, b: a.join(b, FRONT, "left"), [named(b) for b in blocks], cells.select(FRONT).distinct())


def exploded_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors as cells of one matrix."""
    return df.select(F.lit(0).cast("long").alias(FRONT), F.col(key).alias("gene"), F.posexplode(vector).alias("cond", "value")).withColumn("value", F.col("value").cast("double"))


