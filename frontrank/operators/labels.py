"""Intra-front labels and ranks. Windows run over fronts (tens to thousands of rows), never over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import average_rank, md5_hash, quantized, ratio, tie_hash

FRONT, ITEM, TARGET, SCORE = "front_id", "item_id", "target", "score"
MODES = ("rank_dense", "rank_avg", "quantiles", "continuous", "reversed", "shuffled")


def repeated_items(df: DataFrame) -> DataFrame:
    """Items that a front lists more than once."""
    return df.groupBy(FRONT, ITEM).count().filter("count > 1")


def rank_in_front(df: DataFrame, seed: int = 42, hashed: str = "crc32") -> DataFrame:
    """rank_in_front 1..n: score first, then a hash of seed, front and item, so the order of rows never matters."""
    tie = (tie_hash if hashed == "crc32" else md5_hash)(seed, FRONT, ITEM)
    return df.withColumn("rank_in_front", F.row_number().over(Window.partitionBy(FRONT).orderBy(F.desc(SCORE), tie, ITEM)))


def _front() -> Window:
    return Window.partitionBy(FRONT)


def rank_dense() -> Column:
    """Count less dense rank: the best gets n - 1, ties share."""
    t = F.col(TARGET)
    return F.count(t).over(_front()) - F.dense_rank().over(_front().orderBy(F.desc(TARGET)))


def rank_avg() -> Column:
    """Count less average rank, rounded half to even."""
    return F.bround(F.count(TARGET).over(_front()) - average_rank([FRONT], F.desc(TARGET), [TARGET])).cast("long")


def continuous() -> Column:
    """Min-max inside the front; a constant front gives 0."""
    low, high = F.min(TARGET).over(_front()), F.max(TARGET).over(_front())
    return F.coalesce(ratio(F.col(TARGET) - low, high - low), F.lit(0.0))


def with_quantiles(df: DataFrame, quantiles: int = 10) -> DataFrame:
    """Right-closed bins from 0, by linearly interpolated edges of min(quantiles, distinct) bins without repeats.

    A front's targets are one sorted array beside its items, so there is one exchange and no join back.
    """

    def edges(v: Column) -> Column:
        q = F.least(F.lit(quantiles), F.size(F.array_distinct(v)))

        def edge(i: Column) -> Column:
            at = i * (F.size(v) - 1) / q
            low = F.get(v, F.floor(at).cast("int"))
            high = F.get(v, F.least(F.floor(at).cast("int") + 1, F.size(v) - 1))
            return low + (high - low) * (at - F.floor(at))

        return F.array_distinct(F.transform(F.sequence(F.lit(0), q), edge))

    rows = df.groupBy(FRONT).agg(F.collect_list(F.struct(*df.columns)).alias("rows"), F.sort_array(F.collect_list(TARGET)).alias("v"))
    cut = rows.select(FRONT, "rows", edges(F.col("v")).alias("edges")).select(FRONT, "edges", F.explode("rows").alias("row"))
    below = F.size(F.filter("edges", lambda e: e < F.col(f"row.{TARGET}")))
    return cut.select(*_unpacked(df, "row"), F.greatest(below - 1, F.lit(0)).alias("label"))


def _unpacked(df: DataFrame, row: str) -> list[Column]:
    """df's columns from a struct. The front stays the grouped column, so that the planner knows that its rows lie together."""
    return [F.col(FRONT) if c == FRONT else F.col(f"{row}.`{c}`").alias(c) for c in df.columns]


def with_shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """The continuous labels of a front dealt to its items in an order that a hash of seed and item decides.

    A front's rows by item are an array beside its labels by hash, so there is no join back.
    """
    drawn = F.struct(F.xxhash64(F.lit(seed), FRONT, ITEM).alias("hash"), ITEM, "__label")
    arrays = F.sort_array(F.collect_list(F.struct(ITEM, F.struct(*df.columns).alias("row")))).alias("rows"), F.sort_array(F.collect_list(drawn)).alias("drawn")
    dealt = df.withColumn("__label", continuous()).groupBy(FRONT).agg(*arrays).select(FRONT, F.explode(F.arrays_zip("rows.row", "drawn.__label")).alias("x"))
    return dealt.select(*_unpacked(df, "x.row"), F.col("x.__label").alias("label"))


def build_labels(df: DataFrame, mode: str, quantiles: int = 10, seed: int = 42) -> DataFrame:
    """df with the column `label` for one of MODES; quantiles5 is quantiles with 5 bins."""
    if mode.startswith("quantiles") and mode[9:].isdigit():
        return with_quantiles(df, int(mode[9:]))
    if mode == "quantiles":
        return with_quantiles(df, quantiles)
    if mode == "shuffled":
        return with_shuffled(df, seed)
    plain = {"rank_dense": rank_dense, "rank_avg": rank_avg, "continuous": continuous, "reversed": lambda: 1.0 - continuous()}
    if mode not in plain:
        raise ValueError(f"unknown label mode {mode}; one of {MODES}")
    return df.withColumn("label", plain[mode]())


def integer_gains(df: DataFrame) -> DataFrame:
    return df.withColumn("gain", quantized(F.col("label")))


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(FRONT).agg(F.count("*").alias("n_items"))


def contiguous(df: DataFrame) -> DataFrame:
    """Rows of a front side by side in one partition, as rankers want groups."""
    return df.repartition(FRONT).sortWithinPartitions(FRONT, ITEM)


def item_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Pairs of items of one front, smaller item first; quadratic in the front, not in the table."""
    left = df.select(FRONT, F.col(ITEM).alias("item_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = df.select(FRONT, F.col(ITEM).alias("item_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, FRONT).filter("item_a < item_b")


def pair_counts(df: DataFrame, column: str) -> DataFrame:
    """(front, pairs, tied): pairs of items of each front of two or more, and those equal in column, from the sizes of its blocks."""
    block = df.groupBy(FRONT, column).agg(F.count("*").alias("t"))
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    tied = F.when(F.col(column).isNotNull(), pairs("t")).otherwise(0)
    return block.groupBy(FRONT).agg(F.sum("t").alias("n"), F.sum(tied).alias("tied")).filter("n > 1").select(FRONT, pairs("n").alias("pairs"), "tied")


def position_ids(df: DataFrame, by: list[str]) -> DataFrame:
    """item_id 1..n in each front by an explicit order, for tables without an id."""
    return df.withColumn(ITEM, F.row_number().over(Window.partitionBy(FRONT).orderBy(*by)))
