"""Class taxonomies: ancestors, distances, and the answer after each reveal.

On generated inheritance graphs the answer is the sign of the deepest revealed evidence on the subject's ancestor path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.unions import union_of


def ancestors(edges: DataFrame, subjects: DataFrame, depth: int) -> DataFrame:
    """(subject, node, dist) with the subject itself at 0. edges: src to its one parent dst; depth bounds the levels.

    Every level is one equi-join. From the second on only inner nodes are asked for their parents: a table without the
    leaves, which Spark broadcasts where its size allows, so that a parent of very many subjects is no hot key.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("parent"))
    inner = step.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    level = subjects.select("subject", F.col("subject").alias("node"), F.lit(0).alias("dist"))
    out = level
    for d in range(depth):
        level = level.join(inner if d else step, "node").select("subject", F.col("parent").alias("node"), (F.col("dist") + 1).alias("dist"))
        out = union_of(out, level)
    return out


def children_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))


def answers(anc: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each subject and reveal: answer and effect. evidence: node, layer, pol (1 or 0), serial.

    Reveals off the path change nothing, so only the subject's own path meets the evidence; every other reveal repeats the
    answer before it. Off-path rows come from the reveal table of all nodes.
    """
    subjects = anc.where("dist = 0").select("subject")
    on = anc.join(evidence, "node").select("subject", "serial", (F.col("layer") * 10 + F.col("pol")).alias("code"))
    w = Window.partitionBy("subject").orderBy("serial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = on.withColumn("best", F.max("code").over(w))
    until = F.coalesce(F.lead("serial").over(Window.partitionBy("subject").orderBy("serial")), F.lit(1 << 30))
    steps = on.select("subject", "serial", until.alias("until"), "best", (F.col("code") % 10).alias("pol"))
    first = subjects.join(on.groupBy("subject").agg(F.min("serial").alias("u")), "subject", "left").select("subject", F.lit(0).alias("serial"), F.coalesce("u", F.lit(1 << 30)).alias("until"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("int").alias("pol"))
    return union_of(first, steps)


def answer_counts(anc: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer, effect and n over all (subject, reveal) pairs, without making the pairs: a step that holds from one serial
    to the next stands for that many reveals."""
    n = evidence.agg(F.count(F.lit(1)).alias("total"))
    steps = answers(anc, evidence).join(F.broadcast(n))  # one row
    says = F.when(F.col("best").isNull() | (F.col("best") % 10 == 1), "yes").otherwise("no")
    own = steps.where("serial > 0").select(says.alias("answer"), F.when(F.col("pol") == 1, "strengthen").otherwise("weaken").alias("effect"), F.lit(1).cast("bigint").alias("n"))
    held = F.least(F.col("until") - 1, F.col("total")) - F.col("serial")
    quiet = steps.select(says.alias("answer"), F.lit("no effect").alias("effect"), held.cast("bigint").alias("n"))
    return union_of(own, quiet).groupBy("answer", "effect").agg(F.sum("n").alias("n")).where("n > 0")


def tree_distance(anc: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with their undirected distance in the tree: by the nearest common ancestor."""
    left = anc.select(F.col("subject").alias("a"), "node", F.col("dist").alias("da"))
    right = anc.select(F.col("subject").alias("b"), "node", F.col("dist").alias("db"))
    met = pairs.join(left, "a").join(right, ["b", "node"])
    return met.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).cast("bigint").alias("distance"))
