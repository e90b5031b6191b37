"""Graph generators as row generators, keyed by graph_id; all randomness is hashed, so a graph is the same in any run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli, number, order_key, unit
from ..functions.unions import union_of
from .ranking import number_bucket, numbered, running_max

# Shapes of class trees: depth, breadth of the root, least and most children, survival, decay.
TREE_PRESETS = {"jellyfish": (4, 5, 1, 1, 0.4, 1.0), "balanced": (3, 2, 2, 2, 1.0, 1.0), "bushy": (2, 3, 1, 2, 0.7, 1.0)}
CONCEPTS = [("animal", 0.20), ("mammal", 0.15), ("vertebrate", 0.15), ("plant", 0.15), ("insect", 0.15), ("microorganism", 0.10), ("bird", 0.10)]


def ids_of(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """Ids of graphs: the numbers below n, or the column id of a table."""
    return n.select("id") if isinstance(n, DataFrame) else spark.range(n)


def linear_graphs(spark: SparkSession, n: int | DataFrame, shortest: int = 4, longest: int = 6, seed: int = 42) -> DataFrame:
    """Edges (graph_id, src, dst, type, layer, serial) of class chains: Subclass_i inherits from Subclass_(i-1), the root
    has the property, the deepest class is the hypothesis' subject, and some inner classes carry signed evidence."""
    g = ids_of(spark, n).select(F.col("id").alias("graph_id"), (shortest + number("len", "id", seed=seed) % (longest - shortest + 1)).cast("int").alias("depth"))
    cls = lambda i: F.concat(F.lit("Subclass_"), i.cast("string"))
    none = F.lit(None).cast("int")
    steps = g.select("graph_id", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("i"))
    backbone = steps.select("graph_id", cls(F.col("i")).alias("src"), cls(F.col("i") - 1).alias("dst"), F.lit("inheritance").alias("type"), F.col("i").alias("layer"), none.alias("serial"))
    top = g.select("graph_id", F.lit("Subclass_0"), F.lit("Property"), F.lit("has_property"), F.lit(0), none)
    hyp = g.select("graph_id", cls(F.col("depth")), F.lit("Property"), F.lit("hypothesis_edge"), F.col("depth"), none)
    least = F.greatest(F.lit(1), F.floor(F.col("depth") / 2))
    wanted = F.least(F.col("depth") - 1, least + number("n", "graph_id", seed=seed) % (F.col("depth") - least + 1))
    inner = steps.where("i < depth").withColumn("wanted", wanted).withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy(order_key("pick", "graph_id", "i", seed=seed))))
    signed = inner.where("r <= wanted").withColumn("serial", F.row_number().over(Window.partitionBy("graph_id").orderBy("i")))
    sign = F.when(bernoulli(0.5, "sign", "graph_id", "i", seed=seed), "defeasible_has_property").otherwise("defeasible_lacks_property")
    ev = signed.select("graph_id", cls(F.col("i")), F.lit("Property"), sign, F.col("i"), "serial")
    return union_of(backbone, top, hyp, ev)


def tree_nodes(spark: SparkSession, n: int | DataFrame, preset: str = "jellyfish", seed: int = 42) -> DataFrame:
    """Nodes (graph_id, node, parent, layer) of class trees: one explode for each level, ids are paths."""
    depth, breadth, fewest, most, survival, decay = TREE_PRESETS.get(preset, TREE_PRESETS["jellyfish"])
    level = ids_of(spark, n).select(F.col("id").alias("graph_id"), F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("layer"))
    out = level
    for d in range(depth):
        cap = max(fewest, int(most * decay ** max(0, d - 1)))
        k = F.lit(breadth).cast("bigint") if d == 0 else fewest + number("kids", "graph_id", "node", seed=seed) % (cap - fewest + 1)
        alive = level if d == 0 else level.where(unit("live", "graph_id", "node", seed=seed) < F.lit(survival))
        kids = alive.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), k)))
        level = kids.select("graph_id", F.concat("node", F.lit("."), F.col("k").cast("string")).alias("node"), F.col("node").alias("parent"), F.lit(d + 1).alias("layer"))
        out = union_of(out, level)
    return out


def hypothesis_leaf(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """One leaf for each tree: in 80 % one of the deepest, else any."""
    leaves = nodes.join(nodes.select("graph_id", F.col("parent").alias("node")).where("node is not null").distinct(), ["graph_id", "node"], "left_anti")
    deepest = F.max("layer").over(Window.partitionBy("graph_id")) == F.col("layer")
    first = F.when(bernoulli(0.8, "deep", "graph_id", seed=seed) & deepest, 0).otherwise(1)
    w = Window.partitionBy("graph_id").orderBy(F.col("__f"), order_key("leaf", "graph_id", "node", seed=seed))
    return leaves.withColumn("__f", first).withColumn("__r", F.row_number().over(w)).where("__r = 1").select("graph_id", F.col("node").alias("leaf"), "layer")


def tree_evidence(nodes: DataFrame, share: float = 0.6, seed: int = 42) -> DataFrame:
    """Signed evidence on classes below the root other than the hypothesis' leaf, with a shuffled serial."""
    inner = nodes.where("layer > 0").join(hypothesis_leaf(nodes, seed).select("graph_id", F.col("leaf").alias("node")), ["graph_id", "node"], "left_anti")
    kept = inner.where(bernoulli(share, "ev", "graph_id", "node", seed=seed))
    sign = F.when(bernoulli(0.5, "esign", "graph_id", "node", seed=seed), "defeasible_has_property").otherwise("defeasible_lacks_property")
    return kept.select("graph_id", "node", "layer", sign.alias("type"), F.row_number().over(Window.partitionBy("graph_id").orderBy(order_key("eser", "graph_id", "node", seed=seed))).alias("serial"))


def canonical_trees(nodes: DataFrame, depth: int) -> DataFrame:
    """(graph_id, form): the tree written with sorted children, from the leaves up; equal for isomorphic trees."""
    forms = None
    for d in range(depth, -1, -1):
        here = nodes.where(F.col("layer") == d).select("graph_id", "node", "parent")
        if forms is None:
            forms = here.withColumn("form", F.lit("()"))
        else:
            kids = forms.groupBy("graph_id", F.col("parent").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("form")), "").alias("inner"))
            forms = here.join(kids, ["graph_id", "node"], "left").withColumn("form", F.concat(F.lit("("), F.coalesce("inner", F.lit("")), F.lit(")"))).drop("inner")
    return forms.select("graph_id", "form")


def linear_fingerprints(edges: DataFrame) -> DataFrame:
    """(graph_id, fingerprint) from length and the ordered (layer, type) of the evidence."""
    parts = F.when(F.col("type").startswith("defeasible"), F.concat(F.lpad(F.col("layer").cast("string"), 3, "0"), F.lit(":"), "type"))
    return edges.groupBy("graph_id").agg(F.max("layer").alias("length"), F.array_join(F.sort_array(F.collect_list(parts)), ",").alias("ev")).select("graph_id", F.md5(F.concat(F.col("length").cast("string"), F.lit("|"), "ev").cast("binary")).alias("fingerprint"))


def saturation(fingerprints: DataFrame, stop: int) -> DataFrame:
    """graph_id, is_new, run (consecutive duplicates so far) and accepted: new and before the first run of `stop`."""
    first = fingerprints.withColumn("is_new", F.row_number().over(Window.partitionBy("fingerprint").orderBy("graph_id")) == 1)
    bucket = number_bucket(fingerprints, "graph_id")
    seen = numbered(first, bucket, ["graph_id"], "__at")
    seen = running_max(seen, bucket, ["graph_id"], F.when(F.col("is_new"), F.col("__at")), "__last")
    seen = seen.withColumn("run", F.col("__at") - F.col("__last"))
    end = seen.where(F.col("run") >= stop).agg(F.min("__at").alias("__end"))  # one row
    accepted = F.col("is_new") & (F.col("__end").isNull() | (F.col("__at") <= F.col("__end")))
    return seen.join(F.broadcast(end)).select("graph_id", "is_new", "run", accepted.alias("accepted"))


def weighted_choice(rows: DataFrame, key: str, options: list[tuple[str, float]], purpose: str = "w", seed: int = 42) -> DataFrame:
    """rows with choice, drawn by cumulative weights (one CASE, no join)."""
    return rows.withColumn("choice", drawn_choice(key, options, purpose, seed))


def drawn_choice(key: str, options: list[tuple[str, float]], purpose: str = "w", seed: int = 42) -> Column:
    """One of the options by cumulative weights, drawn by the hash of a key."""
    total, out, upto = sum(w for _, w in options), None, 0.0
    u = unit(purpose, key, seed=seed)
    for name, w in options[:-1]:
        upto += w / total
        out = F.when(u < F.lit(upto), name) if out is None else out.when(u < F.lit(upto), name)
    return out.otherwise(options[-1][0]) if out is not None else F.lit(options[-1][0])


def sample_without_replacement(rows: DataFrame, by: str, item: str, k: int, purpose: str = "s", seed: int = 42) -> DataFrame:
    """k rows of each group in hash order."""
    w = Window.partitionBy(by).orderBy(order_key(purpose, by, item, seed=seed), item)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def tree_edges(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Edges (graph_id, src, dst, type, layer, serial) of class trees: children inherit from parents, the root has the
    property, one leaf is the hypothesis' subject, and other classes carry signed evidence."""
    none = F.lit(None).cast("int")
    spine = nodes.where("parent is not null").select("graph_id", F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit("inheritance").alias("type"), "layer", none.alias("serial"))
    top = nodes.where("parent is null").select("graph_id", "node", F.lit("Property"), F.lit("has_property"), "layer", none)
    hyp = hypothesis_leaf(nodes, seed).select("graph_id", "leaf", F.lit("Property"), F.lit("hypothesis_edge"), "layer", none)
    return union_of(spine, top, hyp, tree_evidence(nodes, seed=seed).select("graph_id", "node", F.lit("Property"), "type", "layer", "serial"))
