"""Reasoning views over the shared tables: evidence on a property chain, a class taxonomy, and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli, number, order_key
from ..functions.unions import sound_unions, union_of
from ..operators.ranking import hash_bucket, numbered

CHAIN_END = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of generated graphs: one for each customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, subject, pol (1, -1), idx (chain position 1..8); views and clicks carry no sign and are left out."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select("event_id", "ts", F.col("user_id").alias("subject"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("pol"), (1 + F.get_json_object("props", "$.k").cast("int") % 8).alias("idx"))


def last_edges(signed: DataFrame) -> DataFrame:
    """One edge for each (subject, idx): the last one written wins. Aggregates on the map side."""
    return signed.groupBy("subject", "idx").agg(F.max(F.struct("ts", "event_id", "pol")).alias("e")).select("subject", "idx", "e.ts", "e.event_id", "e.pol")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, idx, pol, event_id and serial 1..n in order of time."""
    edges = last_edges(signed_events(spark, sf_dir))
    return edges.withColumn("serial", F.row_number().over(Window.partitionBy("subject").orderBy("ts", "event_id"))).select("subject", "idx", "pol", "event_id", "serial")


def taxonomy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child to parent: customer and supplier to nation, nation to region, region to the root."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("src"), F.lit("root").alias("dst"), F.lit(1).alias("layer"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit(2).alias("layer"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit(3).alias("layer"))
    s = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit(3).alias("layer"))
    return union_of(r, n, c, s)


def taxonomy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed edges on 60 % of regions, nations and suppliers, with a serial of their own order."""
    nodes = taxonomy_edges(spark, sf_dir).where(~F.col("src").startswith("c")).select(F.col("src").alias("node"), "layer")
    picked = nodes.where(bernoulli(0.6, "bern", "node"))
    signed = picked.withColumn("pol", (number("sign", "node") % 2).cast("int"))
    key = order_key("ser", "node")
    return numbered(signed, hash_bucket(key), [key, "node"], "serial").drop("n_rows")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results: one row for each line of an order."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 20).cast("int").alias("seed"), F.col("o_orderstatus").alias("topology"), F.when(F.col("l_linestatus") == "F", "easy").otherwise("hard").alias("difficulty"), F.col("l_linenumber").cast("int").alias("depth"), (F.col("l_discount") >= 0.04).cast("int").alias("correct"), F.when(F.col("l_returnflag") == "A", "C1").when(F.col("l_returnflag") == "R", "C2").otherwise("C0").alias("cls"), F.col("l_quantity").alias("confidence"), F.col("l_tax").alias("tax"))
