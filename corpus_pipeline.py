"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and gives a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last give the columns of documents.

1. quality       documents that the byte-level convolutional network rejects go; the network is fitted to labels
2. exact         of equal texts the row with the largest doc_id stays
3. near          one document of each near-duplicate class stays, the one with the smallest doc_id
4. decontaminate documents that hold a passage of a benchmark item go
5. pack          the rest is tokenised and packed into sequences of at most 4096 tokens
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frontrank.llm import decontamination, exact_dedup, near_dedup, packing, quality_cnn
from frontrank.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.accepted(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, packing.tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: No SQL: fitted scores, signatures and placing can't be said in it; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
