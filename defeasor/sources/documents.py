"""A reader for files that hold several JSON documents one after the other, as runs that append to a file leave them.

Text inside JSON strings has no raw line breaks, so every line starts outside of strings, and how far its brackets open and
close is known from the line alone. A file is read in splits; the depth at the start of a line is the sum over the splits and
lines before it, so neither a file nor a split has to be read from its start. Only lines in which a document can end are cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stored import written

PIECES = "array<struct<piece:string,ended:boolean>>"
TOKEN = r'"(?:[^"\\]|\\.)*"?'


def brackets(line: Column) -> Column:
    """The brackets of a line that are not inside a string, in order."""
    return F.regexp_replace(F.regexp_replace(line, TOKEN, ""), r"[^\[\]{}]", "")


def cut_line(line: str, depth: int) -> list[tuple[str, bool]]:
    """The pieces of a line that starts at a depth; a piece is ended if its last bracket closes a document. A bracket that closes
    nothing is an error."""
    pieces, start, quoted, skip = [], 0, False, False
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth < 0:
                raise ValueError("a bracket closes nothing")
            if depth == 0:
                pieces.append((line[start : i + 1], True))
                start = i + 1
    rest = line[start:]
    return pieces + [(rest, False)] if rest.strip() or not pieces else pieces


def _cut(lines: pd.Series, depths: pd.Series) -> pd.Series:
    return pd.Series([[{"piece": p, "ended": e} for p, e in cut_line(line, int(d))] for line, d in zip(lines, depths)])


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (file, split, at, ...) with the sum of `value` over the rows of the file before each: sums of splits first, then those
    inside a split."""
    splits = rows.groupBy("file", "split").agg(F.sum(value).alias("__s"))
    earlier = F.sum("__s").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(value).over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    bases = splits.select("file", "split", F.coalesce(earlier, F.lit(0)).alias("__b"))
    return rows.join(bases, ["file", "split"]).withColumn(name, F.col("__b") + F.coalesce(inside, F.lit(0))).drop("__b")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, text): the documents (objects or lists) of each file by their place from 0.

    Blanks and line breaks around a document are dropped; an empty file has none. An unfinished document at the end of a file,
    as a run that was cut off leaves it, raises an error when the rows are read; a bracket that closes nothing does so at once.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.where(F.trim("line") != "").withColumn("signs", brackets(F.col("line")))
    opened, closed = F.length(F.regexp_replace("signs", r"[\]}]", "")), F.length(F.regexp_replace("signs", r"[\[{]", ""))
    lines = written(lines.select("file", "split", "at", "line", opened.alias("opened"), closed.alias("closed")))
    deep = _before(lines.withColumn("change", F.col("opened") - F.col("closed")), "change", "depth")
    whole = F.array(F.struct(F.col("line").alias("piece"), F.lit(False).alias("ended"))).cast(PIECES)
    may_end = F.col("closed") >= F.greatest(F.col("depth"), F.lit(1))
    # Two branches, so that no other line goes through Python.
    deep = written(deep.select("*", may_end.alias("may_end")))
    pieces = deep.where("not may_end").withColumn("pieces", whole).unionByName(deep.where("may_end").withColumn("pieces", F.pandas_udf(_cut, PIECES)("line", "depth")))
    pieces = pieces.select("file", "split", "at", "pieces", F.size(F.filter("pieces", lambda p: p["ended"])).alias("ends"))
    numbered = _before(written(pieces), "ends", "first")
    each = numbered.select("file", "split", "at", "first", F.posexplode("pieces").alias("i", "p"))
    grouped = each.groupBy("file", (F.col("first") + F.col("i")).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("split", "at", "i", "p.piece", "p.ended"))).alias("p"))
    text = F.trim(F.array_join(F.transform("p", lambda x: x["piece"]), "\n"))
    cut_off = F.when(~F.element_at("p", -1)["ended"] & (text != ""), F.raise_error(F.concat(F.lit("an unfinished document in "), F.col("file"))))
    return grouped.select("file", F.col("doc").cast("bigint").alias("doc"), F.coalesce(cut_off.cast("string"), text).alias("text"))
