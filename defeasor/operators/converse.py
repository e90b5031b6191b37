"""Turns of a conversation from replayed evidence, and their nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chain import mode_a_label

# Fixed value: the question about an update.
EFFECT_QUESTION = "Does this update strengthen, weaken, or have no effect on the support for the hypothesis?"


def turns(replayed: DataFrame) -> DataFrame:
    """Four turns for each update: question, answer, effect question, effect answer."""
    kind = F.when(F.col("pol") == 1, "pos").otherwise("neg")
    says = F.when(F.col("state") == "ENTAILED", "yes").when(F.col("state") == "DEFEATED", "no").otherwise("unknown")
    effect = F.lower(mode_a_label(kind, F.col("state_before"), F.col("state")))
    fact = F.concat(F.lit("Object_"), F.col("subject").cast("string"), F.when(F.col("pol") == 1, " has P").otherwise(" lacks P"), F.col("idx").cast("string"), F.lit("."))
    t = lambda role, content, task, truth: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(task).alias("task_type"), truth.alias("ground_truth"))
    none = F.lit(None).cast("string")
    four = F.array(t("user", fact, "update_answer", says), t("assistant", says, "update_answer", none), t("user", F.lit(EFFECT_QUESTION), "effect_of_update", effect), t("assistant", effect, "effect_of_update", none))
    return replayed.select("subject", "serial", F.posexplode(four).alias("at", "t")).select("subject", ((F.col("serial") - 1) * 4 + F.col("at")).cast("bigint").alias("turn_ord"), "t.role", "t.content", "t.task_type", "t.ground_truth")


def nested(flat: DataFrame) -> DataFrame:
    """One row for each subject with its turns in order, as JSON."""
    rows = F.sort_array(F.collect_list(F.struct("turn_ord", "role", "content", "task_type", "ground_truth")))
    return flat.groupBy("subject").agg(F.to_json(rows).alias("turns"), F.count(F.lit(1)).alias("n_turns"))


def pretext(sentences: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Sentences of a group joined by blanks in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, text)))
    return sentences.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r[text]), " ").alias("pretext"))


def within_budget(updates: DataFrame, cap: int, per_update: int = 4, reserve: int = 2) -> DataFrame:
    """Updates while the turns so far stay below cap - reserve."""
    w = Window.partitionBy("subject").orderBy("serial").rowsBetween(Window.unboundedPreceding, -1)
    emitted = F.coalesce(F.sum(F.lit(per_update)).over(w), F.lit(0))
    return updates.where(F.lit(True)).withColumn("__e", emitted).where(F.col("__e") < cap - reserve).drop("__e")


def role_stats(conversations: DataFrame) -> DataFrame:
    """Turns and role changes of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.withColumn("changed", (F.col("role") != F.lag("role").over(w)).cast("int"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_changes"), F.min_by("role", "turn").alias("first_role"))
