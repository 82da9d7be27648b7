"""The given tables seen as fronts, networks, matrices and vectors; the same views in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBJECTIVES = {"price": "minimize", "discount": "maximize", "tax": "minimize", "quantity": "maximize"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a task where each of them becomes many rows: sorts of these stay in memory.
TASK = 1 << 16


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many parts lineitem is cut into for such work: they grow in number, not in size."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // TASK))


def fronts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """A front for each part; its line items are the candidates. parts: how many partitions by front there are to be."""
    line = table(spark, sf_dir, "lineitem")
    line = line.repartition(parts, "l_partkey") if parts else line
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return line.select(
        F.col("l_partkey").alias("front_id"),
        F.row_number().over(order).cast("long").alias("item_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 100000).alias("target"),
        F.round(F.col("l_discount") * 10 + F.col("l_tax"), 2).alias("score"),
    )


FRONTS = """fronts AS (SELECT l_partkey AS front_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey,
l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS item_id, l_extendedprice AS price, l_discount AS discount,
l_tax AS tax, l_quantity AS quantity, floor(l_extendedprice * (1 - l_discount)) / 100000 AS target,
round(l_discount * 10 + l_tax, 2) AS score FROM lineitem)"""


def event_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A front for each user; its events are the candidates."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND value IS NOT NULL")
    return e.select(F.col("user_id").alias("front_id"), F.col("event_id").alias("item_id"), F.col("value").alias("target"), F.length("event_type").cast("double").alias("score"))


EVENT_FRONTS = """event_fronts AS (SELECT user_id AS front_id, event_id AS item_id, value AS target,
length(event_type)::DOUBLE AS score FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""


def edge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base networks (technique, src, dst, w): supplier nation to customer nation, one for each return flag."""
    line, supplier, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    joined = (
        line.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    name = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))
    total = joined.groupBy(F.col("l_returnflag").alias("technique"), name("s_nationkey").alias("src"), name("c_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("v"))
    return total.select("technique", "src", "dst", (F.col("v") / F.max("v").over(Window.partitionBy("technique"))).alias("w"))


EDGES = """edge_lists AS (SELECT technique, src, dst, v / max(v) OVER (PARTITION BY technique) AS w FROM (
SELECT l_returnflag AS technique, 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS src,
'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS dst, sum(l_extendedprice) AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression-style matrix (front_id, gene, cond, value): users over days, grouped by the user's last two digits."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND value IS NOT NULL")
    cell = e.groupBy((F.col("user_id") % 5).alias("front_id"), F.col("user_id").alias("gene"), F.dayofmonth("ts").cast("long").alias("cond"))
    return cell.agg(F.round(F.sum("value"), 4).alias("value"))


MATRIX = """matrix AS (SELECT user_id % 5 AS front_id, user_id AS gene, day(ts)::BIGINT AS cond, round(sum(value), 4) AS value
FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""


def candidate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net_id, technique, weight): a candidate for each shipping month, weighted by the mean discount of each flag."""
    line = table(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    return line.groupBy(month.cast("long").alias("net_id"), F.col("l_returnflag").alias("technique")).agg((F.avg("l_discount") * 10).alias("weight"))


WEIGHTS = """candidate_weights AS (SELECT (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS net_id, l_returnflag AS technique,
avg(l_discount) * 10 AS weight FROM lineitem GROUP BY 1, 2)"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(front_id, family, size, condition, source) of parts as front metadata."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("front_id"), F.col("p_brand").alias("family"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("condition"))


FAMILIES = """families AS (SELECT p_partkey AS front_id, p_brand AS family, p_size::BIGINT AS size, p_type AS condition FROM part)"""
