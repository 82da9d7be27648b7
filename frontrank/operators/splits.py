"""Splits of fronts into development and test, folds, front names, contracts and catalogs."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import split_key
from frontrank.sources.tables import materialized

DEVELOPMENT, TEST = "development", "test"

# Patterns of front names (after a final _exp is cut) with their groups for size, source and condition.
SIZED = r"^InSilicoSize(\d+)-([A-Za-z]+\d+)-(.+)$"
NUMBERED = r"^dream4_(\d+)_(\d+)$"
NAMED = r"^(gnw|rogers|syntren)(\d+)$"
SWITCH = r"^switch-(.+)$"
SIMULATED = r"^sim_(.+?)_(mixed|knockdown|knockout|overexpression)$"
SIMULATED_PREFIXES = ["BioGrid", "GRNdb", "RegNetwork", "TFLink"]
SIMULATED_WHOLE = ["eipo-modular", "scale-free"]


def parsed_names(df: DataFrame, name: str = "front_name") -> DataFrame:
    """family, source, size (null if there is none) and condition, as a front's name tells them."""
    clean = F.regexp_replace(name, "_exp$", "")
    part = lambda pattern, i: F.regexp_extract(clean, pattern, i)
    body, unknown, none = part(SIMULATED, 1), F.lit("unknown"), F.lit(None).cast("string")
    family, source = F.split_part(body, F.lit("_"), F.lit(1)), body
    for p in SIMULATED_WHOLE:
        family, source = F.when(body.startswith(p), p).otherwise(family), F.when(body.startswith(p), p).otherwise(source)
    for p in SIMULATED_PREFIXES:
        own = body.startswith(f"{p}_")
        family, source = F.when(own, p).otherwise(family), F.when(own, F.substring(body, len(p) + 2, 10_000)).otherwise(source)
    cases = [
        (SIZED, F.lit("InSilico"), part(SIZED, 2), part(SIZED, 1), part(SIZED, 3)),
        (NUMBERED, F.lit("dream4"), F.concat(F.lit("dream4_"), part(NUMBERED, 2)), part(NUMBERED, 1), unknown),
        (NAMED, part(NAMED, 1), part(NAMED, 1), part(NAMED, 2), unknown),
        (SWITCH, F.lit("switch"), F.lit("switch"), none, part(SWITCH, 1)),
        (SIMULATED, family, source, F.regexp_extract(body, r"_size-(\d+)", 1), part(SIMULATED, 2)),
    ]
    found = [F.split_part(F.split_part(clean, F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1)), clean, none, unknown]
    for pattern, *values in reversed(cases):
        found = [F.when(clean.rlike(pattern), v).otherwise(f) for v, f in zip(values, found, strict=True)]
    return df.withColumns({"family": found[0], "source": found[1], "size": found[2].try_cast("int"), "condition": found[3]})


def lightest_folds(counts: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[int]]]:
    """Folds for fronts of each size, largest first, each to the lightest fold: (size, the first folds, then a cycle of k).

    counts: (size, fronts). Once loads differ by less than one front's size, equal fronts go round in one order.
    """
    loads, out = [0] * k, []
    for size, n in sorted(counts, reverse=True):
        head: list[int] = []
        while len(head) < n and max(loads) - min(loads) >= size:
            fold = loads.index(min(loads))
            loads[fold] += size
            head.append(fold)
        cycle = sorted(range(k), key=lambda f: (loads[f], f))
        rest = n - len(head)
        for i, fold in enumerate(cycle):
            loads[fold] += size * (rest // k + (i < rest % k))
        out.append((size, head, cycle))
    return out


def balanced_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """(front_id, n_items, fold): the largest front goes to the lightest fold, and so on; equal fronts by hash.

    The driver sees how many fronts there are of each size (a row for each size). Places among fronts of one size come
    from counts by the first digits of their hashes and a window inside each, so no window runs over all fronts.
    """
    sizes = df.groupBy("front_id").agg(F.count("*").alias("n_items")).withColumn("hash", split_key(0, F.col("front_id")))
    sizes = materialized(sizes.withColumn("part", F.substring("hash", 1, 3)), "sizes")
    per = sizes.groupBy("n_items", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_items").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("n_items", "part").orderBy("hash", "front_id"))
    placed = sizes.withColumn("own", own).join(per.select("n_items", "part", before.alias("before")), ["n_items", "part"]).withColumn("i", F.col("before") + F.col("own") - 1)
    counts = [tuple(r) for r in sizes.groupBy("n_items").count().collect()]
    folds = df.sparkSession.createDataFrame(lightest_folds(counts, k), "n_items long, head array<int>, cycle array<int>")
    late = F.col("i") - F.size("head")
    fold = F.when(late < 0, F.get("head", F.col("i").cast("int"))).otherwise(F.get("cycle", F.pmod(late, F.lit(k)).cast("int")))
    return placed.join(folds, "n_items").select("front_id", "n_items", fold.alias("fold"))


def _sum_before(df: DataFrame, value: Column, steps: Column, order: Sequence[Column], over: Sequence[str] = ()) -> DataFrame:
    """df with __before: the sum of value over the rows that come first by (steps, order), inside each `over`.

    steps has a bounded number of values, and order follows it: so no window holds all rows.
    """
    df = df.withColumns({"__value": value, "__step": steps})
    per = df.groupBy(*over, "__step").agg(F.sum("__value").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(*over).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1))  # a row for each step
    own = F.sum("__value").over(Window.partitionBy(*over, "__step").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = df.join(per.select(*over, "__step", F.coalesce(earlier, F.lit(0)).alias("__earlier")), [*over, "__step"])
    return joined.withColumn("__before", F.col("__earlier") + F.coalesce(own, F.lit(0))).drop("__value", "__step", "__earlier")


STEPS = 1024


def test_quotas(families: DataFrame, fraction: float = 0.2) -> DataFrame:
    """(family, n, quota): each family's share of the test fronts.

    There are round-half-even(all x fraction) test fronts, at most all but one. A family gets the whole part of its share,
    at least 1 where it has more than one front, at most n - 1. What lacks goes to the families with the largest remainder,
    each up to its maximum; what is too much is taken from the smallest remainders, down to the minimum. Equal remainders go
    by a hash of the family.
    """
    size = families.groupBy("family").agg(F.count("*").alias("n"))
    every = size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    every = every.select("all", F.least(F.bround(F.col("all") * fraction).cast("long"), F.greatest(F.col("all") - 1, F.lit(0))).alias("want"))
    low, high = F.when(F.col("n") > 1, 1).otherwise(0), F.greatest(F.col("n") - 1, F.lit(0))
    base = size.join(F.broadcast(every), F.lit(True)).withColumns({"low": low, "high": high, "share": F.col("n") * F.col("want") / F.greatest(F.col("all"), F.lit(1))})  # one row
    base = base.withColumns({"quota": F.least(F.greatest(F.floor("share"), F.col("low")), F.col("high")), "rest": F.col("share") - F.floor("share"), "tie": split_key(0, F.col("family"))})
    base = base.join(F.broadcast(base.agg(F.sum("quota").alias("have"))), F.lit(True))  # one row
    lack, room, spare = F.col("want") - F.col("have"), F.col("high") - F.col("quota"), F.col("quota") - F.col("low")
    base = _sum_before(base, room, F.floor((1 - F.col("rest")) * STEPS), [F.desc("rest"), F.asc("tie"), F.asc("family")]).withColumnRenamed("__before", "filled")
    base = _sum_before(base, spare, F.floor(F.col("rest") * STEPS), [F.asc("rest"), F.desc("tie"), F.asc("family")]).withColumnRenamed("__before", "drained")
    more = F.greatest(F.least(lack - F.col("filled"), room), F.lit(0))
    less = F.greatest(F.least(-lack - F.col("drained"), spare), F.lit(0))
    return base.withColumn("given", F.when(lack >= 0, more).otherwise(-less)).select("family", "n", (F.col("quota") + F.col("given")).cast("long").alias("quota"))


NOVELTY = {"size": 8, "condition": 4, "source": 2}


def _novel(combinations: pa.Table) -> pa.Table:
    """Greedy choice of one family among its combinations: front_id and turn while something new is left.

    A lazy heap: what a combination adds only falls as values are seen, so the top is right once its own count is fresh.
    """
    rows = combinations.select([*NOVELTY, "key", "front_id"]).to_pylist()
    quota, points, seen = combinations.column("quota")[0].as_py(), tuple(NOVELTY.values()), [set() for _ in NOVELTY]
    values = [tuple(r[c] for c in NOVELTY) for r in rows]
    heap = [(-sum(points), r["key"], r["front_id"], i) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    picked: list[int] = []
    while heap and len(picked) < quota:
        score, key, front, i = heapq.heappop(heap)
        fresh = -sum(p for p, known, v in zip(points, seen, values[i], strict=True) if v not in known)
        if fresh == score:
            picked.append(front)
            for known, v in zip(seen, values[i], strict=True):
                known.add(v)
        elif fresh:
            heapq.heappush(heap, (fresh, key, front, i))
    return pa.table({"family": pa.array([combinations.column("family")[0].as_py()] * len(picked), pa.string()), "front_id": pa.array(picked, pa.int64()), "turn": pa.array(range(1, len(picked) + 1), pa.int64())})


def diverse_test_fronts(families: DataFrame, quotas: DataFrame, seed: int = 42, name: str = "front_id") -> DataFrame:
    """(front_id, family, turn): greedy choice of each family's test fronts, as many as its quota.

    A front scores 8 for a size that the family's choice doesn't have yet, 4 for a condition, 2 for a source; null is the
    value unknown. Equal scores go by a hash of `name`, then by front_id. Only the first front of each combination of values
    can be chosen while something new is left; these go through a heap for each family. Then the order is the hash's alone,
    placed by counts of the hash's first digits.
    """
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in NOVELTY}
    rows = families.select(F.col("front_id").cast("long").alias("front_id"), F.col("family").cast("string").alias("family"), *[v.alias(c) for c, v in known.items()], split_key(seed, F.col(name)).alias("key"))
    rows = rows.join(quotas.filter("quota > 0").select("family", "quota"), "family")
    first = rows.groupBy("family", *NOVELTY).agg(F.min(F.struct("key", "front_id")).alias("x"), F.first("quota").alias("quota"))
    novel = materialized(first.select("family", *NOVELTY, "x.key", "x.front_id", "quota").groupBy("family").applyInArrow(_novel, "family string, front_id long, turn long"), "novel")
    done = novel.groupBy("family").agg(F.count("*").alias("done"))
    rest = rows.join(novel.select("family", "front_id"), ["family", "front_id"], "left_anti").join(done, "family", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    placed = _sum_before(rest.filter("done < quota"), F.lit(1), F.substring("key", 1, 3), [F.asc("key"), F.asc("front_id")], ["family"])
    late = placed.withColumn("turn", F.col("done") + F.col("__before") + 1).filter("turn <= quota")
    return novel.select("front_id", "family", "turn").unionByName(late.select("front_id", "family", "turn"))


def audited_split(families: DataFrame, fraction: float = 0.2, seed: int = 42, name: str = "front_id") -> DataFrame:
    """families with the split of quotas and diverse test fronts; the fraction must lie between 0 and 1."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("the test fraction must be between 0 and 1")
    return assigned(families, diverse_test_fronts(families, test_quotas(families, fraction), seed, name))


def assigned(families: DataFrame, chosen: DataFrame) -> DataFrame:
    return families.join(chosen.select("front_id", F.lit(TEST).alias("split")), "front_id", "left").withColumn("split", F.coalesce("split", F.lit(DEVELOPMENT)))


def with_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """df with its front's split; fronts without one are an error when the rows are read."""
    joined = df.join(splits.select("front_id", "split"), "front_id", "left")
    return joined.withColumn("split", F.when(F.col("split").isNull(), F.raise_error(F.lit("a front has no split"))).otherwise(F.col("split")))


def unmatched_fronts(df: DataFrame, splits: DataFrame) -> DataFrame:
    """(front_id, side): fronts only in the data, or only in the manifest."""
    a, b = df.select("front_id").distinct(), splits.select("front_id").distinct()
    return a.join(b, "front_id", "left_anti").withColumn("side", F.lit("data")).unionByName(b.join(a, "front_id", "left_anti").withColumn("side", F.lit("manifest")))


def moved_fronts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fronts of two manifests whose splits differ, or that one of them lacks."""
    joined = a.select("front_name", F.col("split").alias("split_a")).join(b.select("front_name", F.col("split").alias("split_b")), "front_name", "full")
    return joined.filter(~F.col("split_a").eqNullSafe(F.col("split_b")))


def split_summary(df: DataFrame) -> DataFrame:
    """Fronts and items by family and split, and the total of each split as family __TOTAL__."""
    totals = df.groupingSets([("family", "split"), ("split",)], "family", "split").agg(F.count("*").alias("fronts"), F.sum("n_items").alias("items"), F.grouping("family").alias("g"))
    return totals.select(F.when(F.col("g") == 1, "__TOTAL__").otherwise(F.col("family")).alias("family"), "split", "fronts", "items")


def split_crosstab(df: DataFrame) -> DataFrame:
    return df.groupBy("family").pivot("split", [DEVELOPMENT, TEST]).count().na.fill(0)


# ---- catalogs and contracts


# Prefixes of feature columns by kind.
PREFIXES = {"technique_weights": ["GRN_"], "expression": ["expr_", "exp_", "ts_"], "network": ["grn_", "net_", "entropy_"]}


def catalog(df: DataFrame) -> DataFrame:
    """(column, position, n_values, n_numbers) of each column: values that are there, and those that are numbers."""
    of = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.count(c).alias("n_values"), F.count(F.col(c).cast("string").try_cast("double")).alias("n_numbers")) for i, c in enumerate(df.columns)]
    return df.agg(F.array(*of).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def classified(columns: DataFrame, control: Sequence[str] = ("front_id", "item_id"), target: str = "AUPR") -> DataFrame:
    """kind of each column name: control, target, one of PREFIXES, or objective_or_metadata."""
    c = F.col("column")
    kind = F.when(c.isin(*control), "control").when(c == target, "target")
    for name, prefixes in PREFIXES.items():
        for prefix in prefixes:
            kind = kind.when(c.startswith(prefix), name)
    return columns.withColumn("kind", kind.otherwise("objective_or_metadata"))


def resolved_blocks(columns: DataFrame, rules: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """(block, column, position): columns that a rule (block, column or prefix) names, without the excluded ones."""
    c = columns.filter(~F.col("column").isin(*excluded)) if excluded else columns
    r = rules.select("block", F.col("column").alias("exact"), "prefix")
    hit = c.join(F.broadcast(r), (F.col("column") == F.col("exact")) | F.col("column").startswith(F.col("prefix")))  # a contract has a few rules
    return hit.select("block", "column", "position").distinct()


def resolved_sets(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(feature_set, columns): the columns of a set's blocks in the table's order."""
    joined = blocks.join(sets, "block").select("feature_set", "position", "column").distinct()
    return joined.groupBy("feature_set").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"))


def ordered_sets(sets: DataFrame, default: Sequence[str]) -> DataFrame:
    """Sets in ablation order: the default ones first, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, default)), F.col("feature_set"))
    return sets.select("feature_set").distinct().withColumn("order", F.when(place > 0, place).otherwise(F.lit(len(default) + 1)))


def shared_columns(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("column").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_set("block")).alias("blocks")).filter("n_blocks > 1")


def contract_faults(df: DataFrame, expected: Sequence[str], forbidden: Sequence[str], assigned_: Sequence[str]) -> DataFrame:
    """(column, fault): missing, forbidden, unassigned, not numeric, null or constant columns; one pass over the table."""
    kinds = dict(df.dtypes)
    known = [(c, "missing") for c in expected if c not in kinds] + [(c, "forbidden") for c in forbidden if c in kinds] + [(c, "unassigned") for c in kinds if c not in assigned_]
    numeric = [c for c in expected if c in kinds]
    checks = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias("text"), F.count_if(F.col(c).isNull()).alias("nulls"), (F.min(c).eqNullSafe(F.max(c))).alias("constant")) for c in numeric]
    per = df.agg(F.array(*checks).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    faults = F.array_compact(F.array(F.when(F.col("text") > 0, "not numeric"), F.when(F.col("nulls") > 0, "null"), F.when(F.col("constant"), "constant")))
    found = per.select("column", F.explode(faults).alias("fault"))
    return found.unionByName(df.sparkSession.createDataFrame(known, "column string, fault string")) if known else found


def small_fronts(df: DataFrame, least: int) -> DataFrame:
    return df.groupBy("front_id").agg(F.count("*").alias("n_items")).filter(F.col("n_items") < least)


