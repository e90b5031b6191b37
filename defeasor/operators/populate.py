"""Names for generated graphs, the default property tree, and words from a Markov model; all randomness is hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli, number, order_key
from ..functions.unions import union_of
from .generate import ids_of


def labelled_by_position(nodes: DataFrame, names: DataFrame, fallback: str) -> DataFrame:
    """nodes (graph_id, node, pos from 0) with label: the name at that position (names: pos, name), else fallback_pos.

    A vocabulary is no larger than the largest graph, as positions beyond it are never asked for; the join is left to
    the optimizer, which broadcasts by size.
    """
    joined = nodes.join(names.select("pos", "name"), "pos", "left")
    return joined.select("graph_id", "node", "pos", F.coalesce("name", F.concat(F.lit(f"{fallback}_"), F.col("pos").cast("string"))).alias("label"))


def breadth_first(nodes: DataFrame) -> DataFrame:
    """nodes (graph_id, node, layer) with pos, their place from the root down, by layer and then by id."""
    return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("layer", "node")) - 1)


def padded_sample(wanted: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """(key, i, label) for i in 0..n-1: names of the key's group in hash order; beyond them the same names again as
    "name #i"; entity_i if the group has none. wanted: key, grp, n; pool: grp, name."""
    sized = pool.distinct().withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(order_key("pad", "grp", "name", seed=seed), "name")) - 1)
    sizes = sized.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    slots = wanted.join(sizes, "grp", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("r", F.when(F.col("size") > 0, F.pmod("i", F.col("size")).cast("int")))
    named = slots.join(sized, ["grp", "r"], "left")
    number_of = F.col("i").cast("string")
    label = F.when(F.col("name").isNull(), F.concat(F.lit("entity_"), number_of)).when(F.col("i") < F.col("size"), F.col("name")).otherwise(F.concat("name", F.lit(" #"), number_of))
    return named.select("key", "i", label.alias("label"))


def irrelevant_sample(wanted: DataFrame, pool: DataFrame, allowed: DataFrame, used: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k attributes for each domain (wanted) that are neither allowed for it (domain, attribute) nor used already."""
    rest = wanted.select("domain").distinct().join(pool.select("attribute").distinct(), F.lit(True))  # two fixed vocabularies
    rest = rest.join(allowed, ["domain", "attribute"], "left_anti").join(used, ["domain", "attribute"], "left_anti")
    w = Window.partitionBy("domain").orderBy(order_key("irr", "domain", "attribute", seed=seed), "attribute")
    return rest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grown_trees(spark: SparkSession, n: int | DataFrame, chain: int = 5, most: int = 3, p: float = 0.3, seed: int = 42) -> DataFrame:
    """Property nodes (graph_id, node, parent, layer) of trees that grow node by node under a parent still open.

    A node takes one child, or with probability p up to 2..most. The newest node is always open, so growth never stops.
    The fold over a graph's nodes is one expression; graphs are independent rows.
    """
    cap = lambda i: F.when(bernoulli(p, "wide", "id", i, seed=seed), 2 + number("cap", "id", i, seed=seed) % (most - 1)).otherwise(F.lit(1)).cast("int")
    entry = lambda i, parent, layer: F.struct(i.cast("int").alias("node"), parent.cast("int").alias("parent"), layer.cast("int").alias("layer"), cap(i).alias("left"))

    def grow(nodes: Column, i: Column) -> Column:
        free = F.filter(nodes, lambda x: x["left"] > 0)
        chosen = F.element_at(free, (number("parent", "id", i, seed=seed) % F.size(free) + 1).cast("int"))
        taken = F.transform(nodes, lambda x: F.struct(x["node"].alias("node"), x["parent"].alias("parent"), x["layer"].alias("layer"), F.when(x["node"] == chosen["node"], x["left"] - 1).otherwise(x["left"]).alias("left")))
        return F.concat(taken, F.array(entry(i, chosen["node"], chosen["layer"] + 1)))

    kind = "array<struct<node:int,parent:int,layer:int,left:int>>"
    first = F.array(entry(F.lit(0), F.lit(-1), F.lit(1))).cast(kind)
    rows = ids_of(spark, n).withColumn("nodes", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, chain - 1))), first, lambda acc, i: grow(acc, i).cast(kind)))
    return rows.select(F.col("id").alias("graph_id"), F.explode("nodes").alias("x")).select("graph_id", "x.node", "x.parent", "x.layer").where(F.col("node") < chain)


def tree_target(nodes: DataFrame) -> DataFrame:
    """(graph_id, target): of the leaves the one with the largest layer and then the largest id as a string."""
    inner = nodes.select("graph_id", F.col("parent").alias("node")).distinct()
    leaves = nodes.join(inner, ["graph_id", "node"], "left_anti")
    return leaves.groupBy("graph_id").agg(F.max_by("node", F.struct("layer", F.col("node").cast("string"))).alias("target"))


def object_evidence(nodes: DataFrame, objects: int, sparsity: float = 0.5, seed: int = 42) -> DataFrame:
    """Signed evidence of objects on properties with an outgoing edge below the first layer; one serial runs through a graph
    by layer, property and a hash of the object."""
    inner = nodes.where("layer > 1").join(nodes.select("graph_id", F.col("parent").alias("node")).distinct(), ["graph_id", "node"], "left_semi")
    pairs = inner.withColumn("object", F.explode(F.sequence(F.lit(0), F.lit(objects - 1)))).where(bernoulli(sparsity, "oev", "graph_id", "node", "object", seed=seed))
    w = Window.partitionBy("graph_id").orderBy("layer", "node", order_key("oord", "graph_id", "node", "object", seed=seed), "object")
    return pairs.select("graph_id", "object", "node", "layer", F.when(bernoulli(0.5, "osign", "graph_id", "node", "object", seed=seed), 1).otherwise(-1).alias("pol"), F.row_number().over(w).alias("serial"))


def markov_words(model: DataFrame, n: int, longest: int = 10, order: int = 2, seed: int = 42) -> DataFrame:
    """(id, word): n words drawn from transitions (state, next, n) over ^word$, up to $ or `longest` letters.

    A draw is a whole number below the state's total, looked up in cumulative counts; one join for each letter. States
    are bounded by the alphabet (27**order), whatever the corpus.
    """
    spark = model.sparkSession
    w = Window.partitionBy("state").orderBy("next")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = model.select("state", "next", (upto - F.col("n")).alias("lo"), upto.alias("hi"), F.sum("n").over(Window.partitionBy("state")).alias("total"))
    starts = model.where(F.col("state").startswith("^")).groupBy("state").agg(F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("state").rowsBetween(Window.unboundedPreceding, 0))
    starts = starts.select(F.col("state").alias("w"), (every - F.col("n")).alias("lo"), every.alias("hi"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    drawn = lambda purpose: F.floor(number(purpose, "id", seed=seed) * F.col("total") / F.lit(1 << 28)).cast("bigint")
    words = spark.range(n).join(starts, (drawn("mk0") >= F.col("lo")) & (drawn("mk0") < F.col("hi"))).select("id", "w")
    for at in range(1, longest - order + 2):
        done = words.where(F.col("w").endswith("$"))
        live = words.where(~F.col("w").endswith("$")).withColumn("state", F.substring("w", -order, order))
        u = drawn(f"mk{at}")
        more = live.join(steps, (live["state"] == steps["state"]) & (u >= F.col("lo")) & (u < F.col("hi"))).select("id", F.concat("w", "next").alias("w"))
        words = union_of(done, more)
    return words.select("id", F.initcap(F.regexp_replace("w", r"[\^$]", "")).alias("word"))


def classified(sentence: Column) -> Column:
    """Whether a statement names a superclass or a property."""
    return F.when(sentence.rlike(r"(?i)\b(is a|is an|kind of|type of)\b"), "subclass").otherwise("property")


def blocks_prompt(texts: Column) -> Column:
    """Texts as numbered blocks."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("BLOCK_"), (i + 1).cast("string"), F.lit(":\n"), t)), "\n\n")


def blocks_reply(reply: Column, i: Column, version: int) -> Column:
    """The text of BLOCK_i_Vversion in a tagged reply, up to the next tag; null if it is not there."""
    # Fixed value: the pattern of tagged replies.
    pattern = F.concat(F.lit(r"(?s)BLOCK_"), i.cast("string"), F.lit(rf"_V{version}:\s*(.*?)(?=BLOCK_\d+_V[12]:|$)"))
    return F.nullif(F.regexp_replace(F.call_function("regexp_extract", reply, pattern, F.lit(1)), r"\s+$", ""), F.lit(""))


def tree_layout(nodes: DataFrame, depth: int) -> DataFrame:
    """graph_id, node, x, y: leaves stand side by side in order of their paths, a parent over the mean of its children; y
    falls with the layer. nodes: graph_id, node, parent, layer, no layer beyond depth. One join for each layer."""
    inner = nodes.where("parent is not null").select("graph_id", F.col("parent").alias("node")).distinct()
    w = Window.partitionBy("graph_id").orderBy("node")
    placed = nodes.join(inner, ["graph_id", "node"], "left_anti").withColumn("x", F.row_number().over(w).cast("double"))
    for layer in range(depth - 1, -1, -1):
        means = placed.where(F.col("layer") == layer + 1).groupBy("graph_id", F.col("parent").alias("node")).agg(F.avg("x").alias("x"))
        placed = union_of(placed, nodes.where(F.col("layer") == layer).join(means, ["graph_id", "node"]).select(*placed.columns))
    return placed.select("graph_id", "node", F.round("x", 6).alias("x"), (-F.col("layer")).alias("y"))
