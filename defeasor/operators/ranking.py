"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, bucket: Column, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with `name` 1..n in the given order and `n_rows`.

    bucket: a whole number of few thousand values that never falls as the order rises. Rows are counted for each bucket
    (partial aggregation), the counts are summed up over buckets, and rows are numbered inside their bucket, so a task
    holds one bucket. An empty df gives an empty result.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__bucket")  # over the counts: one row for each bucket
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    within = Window.partitionBy("__bucket").orderBy(*order)
    return rows.join(F.broadcast(starts), "__bucket").withColumn(name, F.col("__start") + F.row_number().over(within)).drop("__bucket", "__start")


def hash_bucket(key: Column) -> Column:
    """The first three of the hexadecimal digits that an md5 key is sorted by: 4096 buckets."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def number_bucket(df: DataFrame, col: str, buckets: int = 4096) -> Column:
    """Equal ranges of a whole-number column between its least and greatest value, which are read first."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    return F.width_bucket(F.col(col), F.lit(float(lo or 0)), F.lit(float((hi or 0) + 1)), F.lit(buckets)).cast("int")


def running_max(df: DataFrame, bucket: Column, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with the greatest value up to each row: the maxima of earlier buckets, then a window inside the bucket."""
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    tops = rows.groupBy("__bucket").agg(F.max("__value").alias("__top"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    before = tops.select("__bucket", F.max("__top").over(earlier).alias("__before"))
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(before), "__bucket")
    return joined.withColumn(name, F.greatest("__before", F.max("__value").over(within))).drop("__bucket", "__value", "__before")
