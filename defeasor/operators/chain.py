"""The chain resolver as windows.

With p the largest revealed positive index (0 if none) and q the largest revealed negative index (-1 if none), a chain is
UNDETERMINED if a node has both signs, else ENTAILED if p >= q, else DEFEATED. So an ordered replay is two running maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.hashing import order_key
from ..functions.unions import union_of
from .ranking import hash_bucket, numbered

CLOSED_TO_NOW = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def _running(sign: int, w: WindowSpec, default: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("pol") == sign, F.col("idx"))).over(w), F.lit(default))


def state_of(p: Column, q: Column) -> Column:
    return F.when(p >= q, "ENTAILED").otherwise("DEFEATED")


def replay(evidence: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """evidence with p, q, state and state_before after each reveal, in the given order (serial)."""
    w = Window.partitionBy("subject").orderBy(*(order or ["serial"]))
    now, before = w.rowsBetween(*CLOSED_TO_NOW), w.rowsBetween(*BEFORE)
    out = evidence.withColumns({"p": _running(1, now, 0), "q": _running(-1, now, -1), "p_before": _running(1, before, -1), "q_before": _running(-1, before, -1)})
    out = out.withColumn("state", state_of(F.col("p"), F.col("q")))
    return out.withColumn("state_before", state_of(F.greatest("p_before", F.lit(0)), F.col("q_before")))


def delta_label(before: Column, after: Column) -> Column:
    return F.when(before == after, "NO_EFFECT").when(after == "ENTAILED", "STRENGTHENING").when(before == "ENTAILED", "WEAKENING").when((before == "UNDETERMINED") & (after == "DEFEATED"), "WEAKENING").otherwise("NO_EFFECT")


def mode_a_label(kind: Column, before: Column, after: Column) -> Column:
    return F.when(kind == "safe_irr", "NO_EFFECT").when(kind == "pos", "STRENGTHENING").when(kind.isin("neg", "exception"), "WEAKENING").otherwise(delta_label(before, after))


def shortening_label(replayed: DataFrame) -> Column:
    """Of a positive that leaves the chain entailed: it strengthens if it is viable and no viable one is nearer the end."""
    both = (F.col("state_before") == "ENTAILED") & (F.col("state") == "ENTAILED")
    nearer = F.when(F.col("idx") >= F.greatest("p_before", "q_before"), "STRENGTHENING").otherwise("NO_EFFECT")
    return F.when((F.col("pol") == 1) & both, nearer).otherwise(delta_label(F.col("state_before"), F.col("state")))


def random_order(evidence: DataFrame, seed: int = 42) -> DataFrame:
    """evidence replayed in a hash order of its own, with reveal 1..n."""
    keyed = evidence.withColumn("__k", order_key("reveal", "subject", "idx", seed=seed))
    out = replay(keyed, ["__k", "idx"])
    return out.withColumn("reveal", F.row_number().over(Window.partitionBy("subject").orderBy("__k", "idx"))).drop("__k")


def bypass_fold(final: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """subject, entries (sorted positions from which the chain may start) and state, after an ordered pass over bypass rules.

    final has positives and negatives (arrays of indexes) for each subject. A rule (j, k), k > j, adds k if k is not
    negated and some entry up to j reaches j without a negative in between.
    """
    start = F.array_distinct(F.concat(F.array(F.lit(0)), "positives"))

    def step(entries: Column, rule: Column) -> Column:
        j, k = rule["j"], rule["k"]
        open_at = F.exists(entries, lambda e: (e <= j) & ~F.exists(F.col("negatives"), lambda x: (x > e) & (x <= j)))
        fires = (k > j) & ~F.array_contains(F.col("negatives"), k) & open_at
        return F.when(fires, F.array_union(entries, F.array(k))).otherwise(entries)

    rows = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for j, k in rules])
    out = final.withColumn("entries", F.array_sort(F.aggregate(rows, start, step)))
    conflict = F.size(F.array_intersect("positives", "negatives")) > 0
    entailed = F.exists("entries", lambda e: ~F.exists(F.col("negatives"), lambda x: x > e))
    return out.withColumn("state", F.when(conflict, "UNDETERMINED").when(entailed, "ENTAILED").otherwise("DEFEATED"))


def interleaved(main: DataFrame, extra: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of main (subject, serial) in their order with rows of extra (subject, ord) at random places among them.

    Every row gets a hash; main's hashes are sorted and dealt to its rows in order of serial, so their order is kept.
    """
    keys = main.select("subject", order_key("mix", "subject", F.concat(F.lit("m"), F.col("serial")), seed=seed).alias("k"))
    ranked = keys.withColumn("serial", F.row_number().over(Window.partitionBy("subject").orderBy("k")))
    a = main.join(ranked, ["subject", "serial"]).select("subject", "k", F.lit("main").alias("kind"), F.col("serial").alias("n"))
    b = extra.select("subject", order_key("mix", "subject", F.concat(F.lit("x"), F.col("ord")), seed=seed).alias("k"), F.lit("irrelevant").alias("kind"), F.col("ord").alias("n"))
    return union_of(a, b).withColumn("pos", F.row_number().over(Window.partitionBy("subject").orderBy("k", "kind", "n"))).drop("k")


def exception_groups(evidence: DataFrame) -> DataFrame:
    """Nodes with two or more members of both signs."""
    g = evidence.groupBy("idx").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("pol") == 1).alias("n_pos"), F.count_if(F.col("pol") == -1).alias("n_neg"), F.min("serial").alias("first_serial"))
    return g.where("n_members >= 2 and n_pos > 0 and n_neg > 0")


def partition_subjects(subjects: DataFrame, share: float, cap: int, seed: int = 42) -> DataFrame:
    """subject and section (t4, t12) with n4 = round-half-even(n * share) clamped to 1..n-1, and the caps of the sections."""
    key = order_key("part", "subject", seed=seed)
    ranked = numbered(subjects, hash_bucket(key), [key, "subject"], "__r")
    n = F.col("n_rows")
    ranked = ranked.withColumn("__n4", F.when(n < 2, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * F.lit(share), 0)), n - 1))).drop("n_rows")
    t4 = max(1, cap // 2)
    out = ranked.withColumn("section", F.when(F.col("__r") <= F.col("__n4"), "t4").otherwise("t12"))
    out = out.withColumn("rank_in_section", F.when(F.col("section") == "t4", F.col("__r")).otherwise(F.col("__r") - F.col("__n4")).cast("bigint"))
    return out.where(F.col("rank_in_section") <= F.when(F.col("section") == "t4", t4).otherwise(cap - t4)).drop("__n4", "__r")


def bypass_options(chains: DataFrame) -> DataFrame:
    """(subject, j, k, b_j, b_k) from chains (subject, length): pairs with k >= j + 3, each with the pairs b_k >= b_j + 2
    strictly inside of it. Both are spread inside a chain's row."""
    spans = chains.where("length >= 5").select("subject", "length", F.explode(F.expr("sequence(0, length - 5)")).alias("j"))
    spans = spans.select("subject", "j", F.explode(F.expr("sequence(j + 4, length - 1)")).alias("k"))
    inner = spans.select("subject", "j", "k", F.explode(F.expr("sequence(j + 1, k - 3)")).alias("b_j"))
    return inner.select("subject", "j", "k", "b_j", F.explode(F.expr("sequence(b_j + 2, k - 1)")).alias("b_k"))
