"""Tables, reports and edge lists on shared storage. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frontrank.functions import lenient, no_nan

EDGE_SCHEMA = "src string, dst string, confidence string"
REPORT_SCHEMA = "fold int, agg map<string,double>, groups array<map<string,string>>, label_mode string, part int"
TABLES = "frontrank_"
#: Numbers of fronts that a row of a report holds, as a rule.
PART = 1 << 13
MODES = {"force": "overwrite", "skip": "ignore", "default": "errorifexists"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/frontrank-shared"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/frontrank/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and executors may be lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """df as a table of n buckets by key in the shared folder: windows, groups and joins whose keys hold it need no further shuffle.

    A table of the session's catalog knows the buckets; its files lie where `materialized` puts them.
    """
    return _bucketed(df, fresh_path(df.sparkSession, label), key, n)


def _table_name(path: str) -> str:
    return f"{TABLES}{path.rsplit('/', 1)[1].replace('-', '_')}"


def _bucketed(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    df.write.bucketBy(n, key).option("path", path).saveAsTable(_table_name(path), format="parquet")
    return df.sparkSession.table(_table_name(path))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(df: DataFrame) -> bool:
    """Whether the files that df reads are still there; true for what reads none."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return True


class Scratch:
    """The tables of an iterative job, under a name each. A table lives until the next of its name is written, or the scope ends.

    What a job returns unread must be written under a name that it keeps: `keep` hands it over to the caller.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, {}, []

    def turn(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder; the table that had this name goes, so df is its last reader."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        if name in self.paths:
            _delete(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """df as a table of n buckets by key; it goes when the scope ends."""
        self.paths[name] = fresh_path(self.spark, name)
        self.tables.append(_table_name(self.paths[name]))
        return _bucketed(df, self.paths[name], key, n)

    def keep(self, name: str) -> None:
        self.paths.pop(name, None)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        for path in self.paths.values():
            _delete(self.spark, path)
        self.paths = {}


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that jobs have left in the shared folder; for when none of their results is read any more."""
    for t in spark.catalog.listTables(pattern=f"{TABLES}*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    _delete(spark, f"{shared_dir(spark)}/frontrank")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has all columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def features(df: DataFrame, drop: Sequence[str] = (), control: Sequence[str] = ("front_id", "item_id", "target")) -> DataFrame:
    """All columns but control and dropped ones, as doubles without NaN; an error if none is left."""
    names = [c for c in df.columns if c not in control and c not in drop]
    if not names:
        raise ValueError("no feature column is left")
    return df.select(*[c for c in control if c in df.columns], *[no_nan(F.col(f"`{c}`")).alias(c) for c in names])


def strict_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Casts that raise on text that isn't a number."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def aligned(df: DataFrame, order: Sequence[str], control: Sequence[str] = ("front_id", "item_id")) -> DataFrame:
    """Features in the stored order of a model; a missing one is an error."""
    return require(df, order).select(*[c for c in control if c in df.columns], *[F.col(f"`{c}`").cast("double").alias(c) for c in order])


def read_fronts(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_expression(spark: SparkSession, path: str, conditions: Sequence[str]) -> DataFrame:
    """(gene, cond, value): first column dropped, text that isn't a number missing, empty genes then conditions dropped."""
    schema = T.StructType([T.StructField("gene", T.StringType())] + [T.StructField(c, T.StringType()) for c in conditions])
    wide = spark.read.schema(schema).csv(path, header=True)
    return expression_cells(wide.unpivot(["gene"], list(conditions), "cond", "value"))


def expression_cells(cells: DataFrame) -> DataFrame:
    cells = cells.withColumn("value", no_nan(lenient(F.col("value").cast("string"))))
    genes = cells.groupBy("gene").agg(F.count("value").alias("n")).filter("n > 0").select("gene")
    cells = cells.join(genes, "gene", "left_semi")
    conds = cells.groupBy("cond").agg(F.count("value").alias("n")).filter("n > 0").select("cond")
    return cells.join(conds, "cond", "left_semi")


def cleaned_edges(raw: DataFrame) -> DataFrame:
    """Trimmed endpoints, a confidence that isn't a number as 0, rows without an endpoint dropped."""
    return raw.filter("src IS NOT NULL AND dst IS NOT NULL").withColumns({"src": F.trim("src"), "dst": F.trim("dst"), "w": F.coalesce(lenient("confidence"), F.lit(0.0))}).drop("confidence")


def read_edge_folder(spark: SparkSession, folder: str, techniques: Sequence[str] | None = None) -> DataFrame:
    """All base networks of a folder in one scan; the file's or folder's name is the technique. Missing ones are errors."""
    raw = spark.read.schema(EDGE_SCHEMA).option("recursiveFileLookup", "true").csv(folder)
    edges = cleaned_edges(raw.withColumn("technique", F.regexp_extract(F.input_file_name(), r"technique=([^/]+)", 1)))
    if techniques is not None:
        have = {r[0] for r in edges.select("technique").distinct().limit(len(techniques) + 1000).collect()}
        if missing := sorted(set(techniques) - have):
            raise ValueError(f"no file for: {', '.join(missing)}")
    return edges


def missing_techniques(spark: SparkSession, folder: str, used: DataFrame) -> DataFrame:
    """Rows of used (technique, ...) whose base network has no file in the folder. Only the files' names are read, not their rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"technique=([^/]+)", 1).alias("technique")).distinct()
    return used.join(files, "technique", "left_anti")


def write_edge_folder(edges: DataFrame, folder: str) -> None:
    edges.select("src", "dst", "w", "technique").write.partitionBy("technique").csv(folder)


def write_table(df: DataFrame, path: str, existing: str = "default", kind: str = "parquet") -> None:
    """existing: force overwrites, skip leaves what is there, default raises."""
    writer = df.write.mode(MODES[existing])
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def read_figure_table(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """A rank, metric or test table for figures from CSV with a header: required columns must be there, others that are absent are null.

    Only the header line is looked at for names; the schema has the types.
    """
    text = require(spark.read.csv(path, header=True), required)
    wanted = spark.createDataFrame([], schema).schema
    return text.select(*[(F.col(f"`{f.name}`") if f.name in text.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def ranked_faults(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nulls, texts) of a ranked table's columns: missing values, and values that aren't numbers."""
    of = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c).isNotNull() & lenient(F.col(c).cast("string")).isNull()).alias("texts")) for c in require(df, columns).select(*columns).columns]
    return df.agg(F.array(*of).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def checked_ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if its columns are there without nulls and hold numbers only; else an error that names the faults."""
    faults = ranked_faults(df, columns).filter("nulls > 0 OR texts > 0").collect()  # a row for each named column at most
    if faults:
        raise ValueError("; ".join(f"{r['column']}: {r['nulls']} nulls, {r['texts']} texts" for r in faults))
    return df


def json_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns as null."""
    return df.withColumns({c: no_nan(F.col(c)) for c, kind in df.dtypes if kind == "double"})


def reports(metrics: DataFrame) -> DataFrame:
    """Reports from long metrics (model, fold, front_id, metric, value), nested: a row for each model, fold and part.

    A part holds about PART numbers, so no row grows with the table. Part 0 has agg; a report of few fronts is part 0 only.
    """
    some = metrics.filter("value IS NOT NULL")
    per = some.groupBy("model", "fold", "front_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.col("value").cast("string"))))).alias("g"))
    per = per.withColumn("g", F.map_concat("g", F.create_map(F.lit("front_id"), F.col("front_id").cast("string"))))
    sizes = some.groupBy("model", "fold").agg(F.ceil(F.count("*") / PART).alias("parts"))
    # a row for each model and fold: a sort-merge join would send all of a model's fronts to one task
    per = per.join(F.broadcast(sizes), ["model", "fold"]).withColumn("part", F.pmod(F.xxhash64("front_id"), "parts").cast("int"))
    groups = per.groupBy("model", "fold", "part").agg(F.array_sort(F.collect_list(F.map_entries("g"))).alias("e")).select("model", "fold", "part", F.transform("e", F.map_from_entries).alias("groups"))
    mean = metrics.groupBy("model", "fold", "metric").agg(F.avg("value").alias("value")).groupBy("model", "fold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("agg"), F.count("value").alias("known"))
    first = mean.filter("known > 0").select("model", "fold", F.lit(0).alias("part"), "agg")
    return first.join(groups, ["model", "fold", "part"], "full")


def write_reports(metrics: DataFrame, path: str) -> None:
    reports(metrics).write.partitionBy("model").json(path)


def run_name(path: Column) -> Column:
    """The folder that holds a report, without a partition's key."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^[^=]*=", "")


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """model, fold, agg, groups, part of many report files in one scan; fold must be there, and agg but for further parts."""
    raw = spark.read.schema(REPORT_SCHEMA).option("recursiveFileLookup", "true").json(path)
    return raw.withColumn("model", run_name(F.input_file_name())).filter("fold IS NOT NULL AND (agg IS NOT NULL OR part > 0)")


def fold_metrics(found: DataFrame) -> DataFrame:
    """(model, fold, metric, value) from the fold level."""
    return found.select("model", "fold", F.explode("agg").alias("metric", "value"))


def group_metrics(found: DataFrame) -> DataFrame:
    """(model, fold, front_id, metric, value) from the front level, numbers only."""
    each = found.select("model", "fold", F.explode("groups").alias("g")).select("model", "fold", F.col("g")["front_id"].cast("long").alias("front_id"), F.explode("g").alias("metric", "text"))
    return each.filter("metric <> 'front_id'").select("model", "fold", "front_id", "metric", lenient("text").alias("value")).filter("value IS NOT NULL")


def averaged_groups(found: DataFrame, parts: int | None = None) -> DataFrame:
    """Fronts that several folds report, averaged. parts: how many partitions by front there are to be."""
    each = group_metrics(found)
    return (each.repartition(parts, "front_id") if parts else each).groupBy("model", "front_id", "metric").agg(F.avg("value").alias("value"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A value of the whole table that the order of rows doesn't change: count and sum of the leading hex of each row's md5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in df.columns])
    part = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).alias("fingerprint"))


def split_faults(splits: DataFrame) -> DataFrame:
    """Fronts with an unknown split, several splits, or several rows."""
    per = splits.groupBy("front_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_if(~F.col("split").isin("development", "test") | F.col("split").isNull()).alias("odd"))
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("splits") > 1, "several splits"), F.when(F.col("odd") > 0, "unknown split")))
    return per.select("front_id", F.explode(faults).alias("fault"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__i = 1").drop("__i")
