"""Evidence as a stream: the state of each subject after each micro-batch.

The fold is a maximum, so late evidence changes nothing but its own place, and the state is two numbers for a subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chain import state_of


def running_states(stream: DataFrame) -> DataFrame:
    """stream: subject, idx, pol. A streaming aggregation in update or complete mode."""
    g = stream.groupBy("subject").agg(F.coalesce(F.max(F.when(F.col("pol") == 1, F.col("idx"))), F.lit(0)).alias("p"), F.coalesce(F.max(F.when(F.col("pol") == -1, F.col("idx"))), F.lit(-1)).alias("q"))
    return g.withColumn("state", state_of(F.col("p"), F.col("q")))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Signed reveals by window of event time, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "pol").agg(F.count(F.lit(1)).alias("n"))
