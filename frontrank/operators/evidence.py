"""External evidence for network edges, and how many of a network's best edges it supports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.functions import lenient, symbol

COLUMNS = ["source", "target", "resource", "evidence_type", "confidence", "raw_fields"]


def universe(genes: DataFrame, column: str = "gene_symbol") -> DataFrame:
    """Normalised symbols, no blanks, once each."""
    return genes.select(symbol(column).alias("symbol")).filter("symbol <> ''").distinct()


# What a source string holds, and the resource it stands for.
RESOURCES = {"COLLECTRI": "OmniPath_CollecTRI", "DOROTHEA": "OmniPath_DoRothEA"}


def resources(c: Column, known: Mapping[str, str] = RESOURCES) -> Column:
    """Which of the known resources a source string names."""
    return F.array_compact(F.array(*[F.when(F.contains(F.upper(c), F.lit(k.upper())), tag) for k, tag in known.items()]))


def interactions(raw: DataFrame, known: Mapping[str, str] = RESOURCES) -> DataFrame:
    """Interaction rows (source_genesymbol, target_genesymbol, sources) without complexes, one row a named resource."""
    plain = raw.filter(~F.contains("source_genesymbol", F.lit("_")) & ~F.contains("target_genesymbol", F.lit("_")))
    named = plain.withColumn("resource", F.explode(resources(F.col("sources"), known)))
    return named.select(symbol("source_genesymbol").alias("source"), symbol("target_genesymbol").alias("target"), "resource", F.lit("interaction").alias("evidence_type"), F.lit(None).cast("string").alias("confidence"), F.to_json(F.struct("sources")).alias("raw_fields"))


def curated(raw: DataFrame, resource: str) -> DataFrame:
    """Curated pairs (source, target, mode, pmid)."""
    return raw.select(symbol("source").alias("source"), symbol("target").alias("target"), F.lit(resource).alias("resource"), F.lit("curated").alias("evidence_type"), F.lit(None).cast("string").alias("confidence"), F.to_json(F.struct("mode", "pmid")).alias("raw_fields"))


def term_factors(term: Column) -> Column:
    """Factors that the first word of a gene-set term names: parts at / and ::, up to a bracket; PWM_... is PWM."""
    word = F.split_part(F.trim(term), F.lit(" "), F.lit(1))
    word = F.when(F.upper(word).startswith("PWM_"), F.split_part(word, F.lit("_"), F.lit(1))).otherwise(word)
    clean = F.transform(F.split(F.regexp_replace(word, "/", "::"), "::"), lambda x: symbol(F.split_part(x, F.lit("("), F.lit(1))))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def gene_sets(lines: DataFrame, genes: DataFrame, resource: str) -> DataFrame:
    """Lines (value) of term, description, targets by tabs: every factor with every target in the universe, no self pair."""
    parts = F.split("value", "\t")
    rows = lines.filter(F.size(parts) >= 3).select(parts[0].alias("term"), F.slice(parts, 3, F.size(parts)).alias("targets"))
    pairs = rows.select("term", F.explode(term_factors(F.col("term"))).alias("source"), "targets").select("term", "source", F.explode("targets").alias("t")).select("term", "source", symbol("t").alias("target"))
    known = genes.select("symbol")
    kept = pairs.join(known, pairs["source"] == known["symbol"], "left_semi").join(known, pairs["target"] == known["symbol"], "left_semi").filter("source <> target")
    return kept.select("source", "target", F.lit(resource).alias("resource"), F.lit("gene_set").alias("evidence_type"), F.lit(None).cast("string").alias("confidence"), F.to_json(F.struct("term")).alias("raw_fields"))


def factor_scores(rows: DataFrame, resource: str) -> DataFrame:
    """Score rows (factor, target, score_a, score_b): the larger of two scores, positive only."""
    score = F.greatest(lenient("score_a"), lenient("score_b"))
    return rows.withColumn("score", score).filter("score > 0").select(symbol("factor").alias("source"), symbol("target").alias("target"), F.lit(resource).alias("resource"), F.lit("score").alias("evidence_type"), F.col("score").cast("string").alias("confidence"), F.lit(None).cast("string").alias("raw_fields"))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def normalized(tables: Sequence[DataFrame], genes: DataFrame) -> DataFrame:
    """Union of evidence tables: normalised, no blanks or self pairs, both ends in the universe, once for each resource and type."""
    all_ = reduce(DataFrame.unionByName, [t.select(*COLUMNS) for t in tables])
    clean = all_.withColumns({"source": symbol("source"), "target": symbol("target")}).filter("source <> '' AND target <> '' AND source <> target")
    known = genes.select("symbol")
    kept = clean.join(known, clean["source"] == known["symbol"], "left_semi").join(known, clean["target"] == known["symbol"], "left_semi")
    return kept.dropDuplicates(["source", "target", "resource", "evidence_type"])


def support(ranked: DataFrame, evidence: DataFrame, cutoff: int) -> DataFrame:
    """Of the best `cutoff` edges of each method (method, src, dst, edge_rank): pairs and sources with evidence.

    Rates divide by the cutoff, also where a network has fewer edges.
    """
    pairs = evidence.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1).alias("pair")).distinct()
    sources = evidence.select(F.col("source").alias("src"), F.lit(1).alias("known")).distinct()
    top = ranked.filter(F.col("edge_rank") <= cutoff).join(pairs, ["src", "dst"], "left").join(sources, "src", "left")
    counted = top.groupBy("method").agg(F.count("pair").alias("pairs"), F.count("known").alias("sources"), F.count("*").alias("edges"))
    return counted.withColumns({"cutoff": F.lit(cutoff), "pair_rate": F.col("pairs") / cutoff, "source_rate": F.col("sources") / cutoff})


def frequent_sources(ranked: DataFrame, within: int = 5000, most: int = 40) -> DataFrame:
    """The sources that begin most of the best edges: a top-k report."""
    return ranked.filter(F.col("edge_rank") <= within).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(most)
