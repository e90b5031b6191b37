"""Lookups in a knowledge base of nodes and edges, and attribute sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import order_key
from ..functions.unions import union_of


def related(nodes: DataFrame, edges: DataFrame, *, up: bool) -> DataFrame:
    """(label, found): distinct labels of sub- or superclasses, matched on the case-folded label. nodes: id, label; edges: parent, child."""
    here, there = ("child", "parent") if up else ("parent", "child")
    a = nodes.select(F.col("id").alias(here), F.lower("label").alias("label"))
    b = nodes.select(F.col("id").alias(there), F.col("label").alias("found"))
    return edges.join(a, here).join(b, there).select("label", "found").distinct()


def matching_properties(properties: DataFrame, subjects: DataFrame) -> DataFrame:
    """property and subject where the domain is equal or the subject's type is allowed: two equi-joins, their union, distinct."""
    by_domain = properties.join(subjects, properties["domain"] == subjects["subject_domain"]).select("property", "subject")
    allowed = properties.select("property", F.explode("allowed").alias("subject_type"))
    return union_of(by_domain, allowed.join(subjects, "subject_type").select("property", "subject")).distinct()


def sample_attributes(pool: DataFrame, wanted: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k attributes for each key: those of its domain first, then the others, both in hash order.

    pool: attribute, domain; wanted: key, domain. A domain needs its own first k; one with fewer needs some of the first 2 k
    of all attributes. So no domain meets the whole pool.
    """
    mark = order_key("attr", "attribute", seed=seed)
    own = pool.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(mark, "attribute"))).where(F.col("rank") <= k).select("domain", "attribute", "rank")
    domains = wanted.select("domain").distinct().join(own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "domain", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    first = pool.select(F.col("attribute"), F.col("domain").alias("other"), mark.alias("mark")).orderBy("mark", "attribute").limit(2 * k)  # of these at most k - 1 are the domain's own
    fill = domains.join(first, domains["domain"] != first["other"]).withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("mark", "attribute")))
    fill = fill.where(F.col("r") <= k - F.col("n")).select("domain", "attribute", (F.col("n") + F.col("r")).cast("int").alias("rank"))
    return wanted.join(union_of(own, fill), "domain").select("key", "attribute", "rank")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of an id wins."""
    return nodes.groupBy("id").agg(F.min_by("label", "ord").alias("label"))


def dedup_properties(properties: DataFrame) -> DataFrame:
    """The first of each (lemma, frame) wins."""
    w = Window.partitionBy("lemma", "frame").orderBy("ord")
    return properties.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def concept_chains(edges: DataFrame, starts: DataFrame, length: int, fillers: list[str], seed: int = 42) -> DataFrame:
    """start, pos 0..length-1, label: a way down from each start of exactly `length` nodes if there is one, else a longest
    one, filled up from fillers and then with nonce_entity_<i>. edges: src (child), dst (parent), acyclic.

    Which way is taken is fixed by hashes: among children from which the way can still be longest, the first by hash. No
    paths are enumerated: heights up to `length` come from length - 1 semi-joins, and each step down is one equi-join.
    """
    spark = edges.sparkSession
    kids = edges.select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct()
    level = kids.select("parent").distinct()  # nodes of height 2 or more
    tall = [level]
    for _ in range(length - 3):
        level = kids.join(level.withColumnRenamed("parent", "child"), "child", "left_semi").select("parent").distinct()
        tall.append(level)
    height = tall[0].withColumn("__h", F.lit(2))
    for n, nodes in enumerate(tall[1:], 3):
        height = union_of(height, nodes.withColumn("__h", F.lit(n)))
    height = height.groupBy("parent").agg(F.max("__h").alias("__h")).withColumnRenamed("parent", "child")
    ranked = kids.join(height, "child", "left").withColumn("__h", F.coalesce("__h", F.lit(1)))
    first = lambda need: F.min_by("child", F.struct(-F.least("__h", F.lit(need)), order_key("step", "parent", "child", seed=seed)))
    ways = starts.select("start", F.array(F.col("start")).alias("way"))
    for i in range(1, length):
        step = ranked.groupBy("parent").agg(first(length - i).alias("__next"))
        ways = ways.withColumn("parent", F.when(F.size("way") == i, F.element_at("way", -1))).join(step, "parent", "left")
        ways = ways.select("start", F.when(F.col("__next").isNotNull(), F.array_append("way", F.col("__next"))).otherwise(F.col("way")).alias("way"))
    pad = F.array(*[F.lit(w) for w in fillers]).cast("array<string>") if fillers else F.array().cast("array<string>")
    i = F.col("pos") - F.size("way")
    rows = ways.select("start", "way", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    label = F.when(i < 0, F.get("way", F.col("pos"))).otherwise(F.coalesce(F.get(pad, i), F.concat(F.lit("nonce_entity_"), i.cast("string"))))
    return rows.select("start", "pos", label.alias("label"))
