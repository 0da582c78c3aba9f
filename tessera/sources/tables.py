"""Reading the input tables, and the views of them that stand for runs, facts and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of agents: run_id, agent, status, cost, created_at."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("agent"), F.col("event_type").alias("status"), F.col("value").alias("cost"), F.col("ts").alias("created_at"))


RUNS_SQL = "runs AS (SELECT event_id AS run_id, user_id AS agent, event_type AS status, value AS cost, ts AS created_at FROM events)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as bi-temporal facts: supplier -supplies-> part, valid from the ship date until the next one of the same pair.

    edge_id names supplier, relation, part and the fact's place among theirs, so no two facts share one; facts of one pair that
    agree in date, order and line are placed by their other columns.
    """
    from pyspark.sql.window import Window as W

    line = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "src", "l_partkey": "dst", "l_returnflag": "relation", "l_shipdate": "valid_at"})
    by_pair = W.partitionBy("src", "dst", "relation").orderBy("valid_at", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    place = F.row_number().over(by_pair)
    source = F.when(F.col("l_linestatus") == "F", "extracted").otherwise("recorded")
    return line.select(F.concat_ws("-", "src", "relation", "dst", place).alias("edge_id"), "src", "dst", "relation", "valid_at", source.alias("event_time_source"), F.lead("valid_at").over(by_pair).alias("invalid_at"))


FACTS_SQL = """facts AS (SELECT concat_ws('-', l_suppkey, l_returnflag, l_partkey, row_number() OVER pair) AS edge_id, l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, l_shipdate AS valid_at,
  CASE WHEN l_linestatus = 'F' THEN 'extracted' ELSE 'recorded' END AS event_time_source, lead(l_shipdate) OVER pair AS invalid_at FROM lineitem
  WINDOW pair AS (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who trades with whom, undirected and once: customers and suppliers of one order, by nation of the customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    pairs = o.join(line, "o_orderkey").select("o_custkey", "l_suppkey").distinct()  # of numbers: names take twice their room
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))


EDGES_SQL = "edges AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as memories: id, store by role, namespace by conversation, content, access count and last use."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("memory_id"),
        F.when(F.col("role") == "user", "observation").when(F.col("role") == "assistant", "procedure").otherwise("profile").alias("store"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("global")).when(F.col("conv_id") % 3 == 1, F.lit("user")).otherwise(F.concat(F.lit("project:p"), F.col("conv_id") % 7)).alias("namespace"),
        F.col("text").alias("content"),
        F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11)).alias("access_count"),
        F.pmod(F.col("conv_id") + F.col("turn") * 13, F.lit(90)).cast("double").alias("idle_days"),
    )


MEMORIES_SQL = """memories AS (SELECT conv_id * 1000000 + turn AS memory_id, CASE role WHEN 'user' THEN 'observation' WHEN 'assistant' THEN 'procedure' ELSE 'profile' END AS store,
  CASE conv_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'user' ELSE 'project:p' || (conv_id % 7) END AS namespace, text AS content,
  (conv_id * 7 + turn) % 11 AS access_count, ((conv_id + turn * 13) % 90)::DOUBLE AS idle_days FROM conversations)"""
