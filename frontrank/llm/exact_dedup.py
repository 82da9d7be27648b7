"""Exact dedup: a tree-merge of sorted digest runs.

Each partition sorts its digests into a run. In every round the runs of FAN neighbouring partitions meet
(run number // FAN, shard by shard), are merged in digest order and keep, for each text, the winning id and the
number of rows so far. After ceil(log_FAN(partitions)) rounds one run is left for each shard of the digest space,
so no task ever holds more than its shard, and a text that a third of all rows share is one row per run. The runs that
meet are brought in order by Spark's sort, which merges sorted spills, and collapsed in one pass over that order.

Texts are equal when SHA-256, byte length and a second, independent 64-bit hash all agree; this is checked at
every level, because the three together are the merge key. Of equal texts the largest doc_id stays.

Null text counts as empty. A null doc_id loses against any id. Of rows that repeat id and text one stays.
An empty table gives an empty result. Extra columns are passed through by `deduplicated` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import read, without_ids, written

FAN, SHARDS = 8, 4096
_NO_ID = -(2**63)
_RUN = "shard int, run long, sha binary, bytes long, check long, keep long, uid long, n long"


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row number uid, SHA-256, byte length and second hash of every text: all that is exchanged."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.unhex(F.sha2(_text(), 256)).alias("sha"), F.octet_length(_text()).cast("long").alias("bytes"), F.xxhash64(_text()).alias("check"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted stream: one row for each text, with the largest (keep, uid) and the sum of n."""
    last: tuple | None = None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        names = ["shard", "run", "sha", "bytes", "check", "keep", "uid", "n"]
        types = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        sha = c["sha"].to_pylist()
        rest = {k: np.asarray(c[k]) for k in ("shard", "run", "bytes", "check", "keep", "uid", "n")}
        new = np.ones(len(sha), bool)
        new[1:] = [a != b for a, b in zip(sha, sha[1:], strict=False)]
        for k in ("bytes", "check"):
            new[1:] |= rest[k][1:] != rest[k][:-1]
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(sha)) - 1  # sorted by (keep, uid): the last row of a text wins
        counts = np.add.reduceat(rest["n"], begins)
        found = [(int(rest["shard"][e]), int(rest["run"][e]), sha[e], int(rest["bytes"][e]), int(rest["check"][e]), int(rest["keep"][e]), int(rest["uid"][e]), int(n)) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        if last is not None:
            if last[2:5] == found[0][2:5]:
                found[0] = (*found[0][:7], found[0][7] + last[7])
            else:
                found.insert(0, last)
        last = found.pop()
        if found:
            yield rows(found)
    if last is not None:
        yield rows([last])


def _run(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("shard", "sha", "bytes", "check", "keep", "uid").mapInArrow(_collapse, _RUN)


def tree_merged(rows: DataFrame) -> DataFrame:
    """One row for each text of a digests() table: sha, bytes, check, keep, uid of the winner, n rows."""
    runs = max(1, rows.rdd.getNumPartitions())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = _run(rows.select(F.conv(F.substring(F.hex("sha"), 1, 3), 16, 10).cast("int").alias("shard"), F.spark_partition_id().cast("long").alias("run"), "sha", "bytes", "check", F.coalesce("doc_id", F.lit(_NO_ID)).alias("keep"), "uid", F.lit(1).cast("long").alias("n")))
    while True:
        runs = -(-runs // FAN)
        level = _run(level.withColumn("run", F.expr(f"run div {FAN}")).repartition(parts, "shard", "run"))
        if runs == 1:
            return level.drop("shard", "run")


def decided(rows: DataFrame) -> DataFrame:
    """Every row of a digests() table with its winner."""
    best = tree_merged(rows).withColumnRenamed("uid", "best")
    out = rows.join(best, ["sha", "bytes", "check"])
    return out.select("doc_id", F.when(F.col("keep") != _NO_ID, F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bytes", "check")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    return decided(written(digests(docs), "digests")).drop("bytes", "check")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without its exact copies; all columns stay."""
    found = written(decided(written(digests(docs), "digests")).filter(~F.col("kept") | F.col("doc_id").isNull()), "copies")
    # A row that repeats a kept row's id and text can't be told from it by key: such rows are collapsed.
    twice = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    names = {"__fr_id": F.coalesce("doc_id", F.lit(_NO_ID)), "__fr_sha": F.sha2(_text(), 256)}
    keyed = docs.withColumns(names)
    out = without_ids(keyed, ids := _keys(found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))), ids.count(), ["__fr_id", "__fr_sha"])
    if not twice.isEmpty():
        out = out.dropDuplicates(["__fr_id", "__fr_sha"])
    return out.drop(*names)


def _keys(found: DataFrame) -> DataFrame:
    return found.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__fr_id"), F.col("text_sha256").alias("__fr_sha")).distinct()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
