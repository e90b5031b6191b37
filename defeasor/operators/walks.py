"""Walks over graphs of any depth: what is reached from a root, and the longest way to a node.

Each step is a join whose result is a written table, so the plan of a step does not hold those before it and a lost executor
costs one step at most. The number of steps is the depth of the graph, which the data decide; no constant bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import fresh_path, written
from ..functions.unions import sound_unions

REACHED = "root {0}, node {0}, depth int"


def reached_all(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node that can be reached from each root, at its least depth, the root itself at 0.

    relations: parent, child; roots: root. Cycles, loops and repeated rows add nothing; rows with a null end are no relations and
    null roots none. The frontier of a step meets the relations and drops what has been seen; the walk ends at an empty one.
    """
    spark = relations.sparkSession
    sound_unions(spark)
    step = written(relations.where("parent is not null and child is not null").select(F.col("parent").alias("node"), "child").distinct())
    kind = step.schema["child"].dataType.simpleString()
    schema, folder = REACHED.format(kind), fresh_path(spark, "walk")
    roots.where("root is not null").select(F.col("root").cast(kind).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).write.parquet(f"{folder}/step=0")
    level, d = spark.read.schema(schema).parquet(f"{folder}/step=0"), 0
    while not level.isEmpty():
        d += 1
        seen = spark.read.schema(schema).parquet(*[f"{folder}/step={i}" for i in range(d)]).select("root", "node")
        found = level.join(step, "node").select("root", F.col("child").alias("node")).distinct()
        found.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth")).write.parquet(f"{folder}/step={d}")
        level = spark.read.schema(schema).parquet(f"{folder}/step={d}")
    return spark.read.schema(schema).parquet(*[f"{folder}/step={i}" for i in range(d + 1)])


def longest_depths(relations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth, n_children): the length of the longest way from any node without parents, and the number of children.

    relations: parent, child; nodes: node, where some have no relation. Repeated rows count once. A node takes part in a step
    when all its parents have done so, so its step is its longest way. Nodes on a cycle, or that only a cycle leads to, have
    no longest way: their depth is null, as is that of nodes behind them.
    """
    edges = written(relations.where("parent is not null and child is not null").select("parent", "child").distinct())
    ends = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node")))
    every = ends if nodes is None else ends.unionByName(nodes.where("node is not null").select("node"))
    waits = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    state = written(every.distinct().join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0).cast("bigint")).alias("waits")))
    kids = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    done, d = [], 0
    while True:
        ready = written(state.where("waits = 0").select("node", F.lit(d).alias("depth")))
        if ready.isEmpty():
            break
        done.append(ready)
        met = edges.join(ready, F.col("parent") == F.col("node")).groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        left = state.where("waits > 0").join(met, "node", "left")
        state, d = written(left.select("node", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"))), d + 1
    depths = state.select("node", F.lit(None).cast("int").alias("depth"))
    for ready in done:
        depths = depths.unionByName(ready)
    return depths.join(kids, "node", "left").select("node", "depth", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"))
