"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a key, a hash of the seed, its id and its text. Within a source, rows are range-sorted by the key: the leading
hex digits give a bucket, the bucket's word counts are summed up, prefix sums over the buckets of a source give each
bucket's start, and a running sum within the bucket completes the distributed prefix sum. A source's budget (its target,
cut to whole words) is then filled in key order: whole epochs first, and the last epoch is cut where the budget ends, in
the middle of a document if need be.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; together they get ``share`` of all words; no
target is above ``cap`` times its source's size, and what is above goes to the others by weight until none is above.
The excess is reshared round by round: each round is one sum over the table of sources.

Edge cases: null texts and texts without words have size 0 and are never taken; the null source is a source of its own;
a source without words has target 0; repeated rows and null ids are rows of their own; an empty table gives an empty result.
Only the named columns are read; ``mix`` keeps all columns, whatever their names.

Scale: texts are read once for their sizes and not shuffled; windows are bounded by a bucket, so a source with a third of
all rows is spread over 16**digits buckets. Equal rows are one row with a count, so a row that a third of the table repeats
fills no bucket; what they take is dealt out among their copies. The sources are numbered in range partitions, so that as
many sources as there are hosts pass through no single task. ``mix`` shuffles the texts once, to meet what they take.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import SPACE, WORD, copied, one_each, packed, row_keys, stash, unpacked, words


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """__id, __source, size, __key and `more`, with the number of such rows, __n. The key needs nothing but id and text: md5
    in hex, the same in any SQL engine."""
    text = F.col(text_col).cast("string")
    of_text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), of_text).cast("binary"))
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.size(words(text)).cast("long").alias("size"), key.alias("__key"), *more)
    return sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("__n"))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(__source, source_size) with __at, the place from 0 in code-point order, null last. Sorted in range partitions, whose
    rows the driver counts."""
    order = [F.col("__source").isNull(), F.col("__source")]
    ranged = stash(sizes.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "sources")
    counts = dict(ranged.groupBy("__part").count().collect())  # a row for each partition
    firsts = list(itertools.accumulate((counts.get(p, 0) for p in range(max(counts, default=0) + 1)), initial=0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.select("__source", "source_size", (F.get(F.array(*[F.lit(n).cast("bigint") for n in firsts]), F.col("__part")) + within).alias("__at"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (__source, source_size): the same with target."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__at", F.lit(len(weights))) + 1).cast("int"))
    s = stash(numbered_sources(sizes).select("__source", "source_size", weight.alias("__w"), (F.col("source_size") * F.lit(float(cap))).alias("__cap")), "weights")
    total, level, full = s.agg(F.sum("source_size")).first()[0] or 0, math.inf, -1
    while True:  # a source that is full stays full, so there are no more rounds than sources; few in practice
        over = F.col("__w") * F.lit(level) >= F.col("__cap") if level < math.inf else F.lit(False)
        n, caps, rest = s.agg(F.count_if(over), F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(over, 0.0).otherwise(F.col("__w")))).first()
        if n == full or not rest:
            break
        full, level = n, (total * float(share) - (caps or 0.0)) / rest
    return s.select("__source", "source_size", F.least(F.col("__cap"), F.col("__w") * F.lit(level)).alias("target"))


def budgets(sized: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, digits: int = 3) -> DataFrame:
    """From with_sizes: its rows with source_size, target, __epochs (in which a row is taken whole) and __last, the words
    that its __n copies together give to the last epoch."""
    rows = stash(sized.withColumn("__bucket", F.substring("__key", 1, digits)), "sizes")
    sums = stash(rows.groupBy("__source", "__bucket").agg(F.sum(F.col("size") * F.col("__n")).alias("__sum")), "sums")
    goal = targets(sums.groupBy("__source").agg(F.sum("__sum").alias("source_size")), weights=weights, share=share, cap=cap)
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("__start", before).drop("__sum").withColumnsRenamed({"__source": "__s", "__bucket": "__b"})
    starts = starts.join(goal.withColumnRenamed("__source", "__g"), F.col("__s").eqNullSafe(F.col("__g"))).drop("__g")
    ties = [c for c in rows.columns if c not in ("__source", "__bucket", "__key", "__n")]
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__all", F.col("size") * F.col("__n")).withColumn("__upto", F.sum("__all").over(within))
    placed = placed.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    start = F.col("__start") + F.col("__upto") - F.col("__all")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("__all"), budget - F.col("__epochs") * F.col("source_size") - start))
    return placed.withColumn("__epochs", epochs).withColumn("__last", last.cast("long")).drop("__start", "__upto", "__bucket", "__all")


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 97, **options) -> DataFrame:
    """Per row: id, size, source_size, target, taken (and __source)."""
    b = stash(budgets(with_sizes(docs, id_col, text_col, source_col, seed), **options), "budgets")
    # of equal rows the first ones give all their words to the last epoch, one the rest
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__last") - F.col("__i") * F.col("size")))
    out = b.where("__n = 1").withColumn("__i", F.lit(0).cast("bigint"))
    if not (several := b.where("__n > 1")).isEmpty():
        out = out.union(copied(several, F.col("__n"), "__i"))
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("__epochs") * F.col("size") + last).cast("long").alias("taken"), "__source")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 97, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; where a budget ends inside a
    document, that copy ends there too (n_chars, if there is such a column, follows)."""
    first, second = row_keys(docs)
    whole = packed(docs, __k1=first, __k2=second)
    b = budgets(with_sizes(docs, id_col, text_col, source_col, seed, first.alias("__k1"), second.alias("__k2")), **options)
    took = stash(b.select("__k1", "__k2", "__n", F.col("size").alias("__size"), (F.col("__epochs") * F.col("size") * F.col("__n") + F.col("__last")).alias("__taken")).where("__taken > 0"), "taken")
    epochs = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__taken") / F.col("__size")).cast("long") - 1)
    one = one_each(whole)
    out = one.join(took.where("__n = 1"), ["__k1", "__k2"]).withColumn("__i", F.explode(epochs))
    if not (several := took.where("__n > 1")).isEmpty():  # one of equal rows, as often as all of them are taken
        out = out.union(copied(one.join(several, ["__k1", "__k2"]), F.ceil(F.col("__taken") / F.col("__size")), "__i"))
    take = F.least(F.col("__size"), F.col("__taken") - F.col("__i") * F.col("__size"))
    text = F.col("__row").getField(text_col)
    out = out.withColumn("__text", F.when(take < F.col("__size"), first_words(text, take)).otherwise(text))
    replaced = {text_col: F.col("__text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs, **replaced)
