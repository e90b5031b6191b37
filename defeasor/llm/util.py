"""Shared pieces: the folder that all executors see, written tables that cut lineage, and column selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unions import sound_unions

#: The white space of the text contracts: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode without the setting (tests) a temporary one; a cluster
    without it is an error, as no folder of one machine is seen by all."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="defeasor-")
    return _own_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation beyond the table."""
    spark = df.sparkSession
    sound_unions(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: so few rows, and so few bytes (or one row), that a batch of long texts fits a Python
    worker. The settings are those of the session; no result depends on them."""
    sound_unions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def packed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Each row as one struct __row beside the given columns: no name of the input can meet theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The rows in __row with the columns of `like` in their order, some of them replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("__row").getField(c)).alias(c) for c in like.columns])


def words(text: Column) -> Column:
    """The words of a text as an array; none for null and for white space only."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+$", ""), rf"[{SPACE}]+")
    return F.when(F.element_at(parts, 1) == "", F.array().cast("array<string>")).otherwise(parts)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns, null and empty apart: rows that agree in both are taken as equal."""
    cols = [F.col(f"`{c}`").cast("string") for c in sorted(df.columns)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(1), nulls, *cols), F.xxhash64(F.lit(2), nulls, *cols)


def one_each(rows: DataFrame) -> DataFrame:
    """One of each group of rows that agree in __k1 and __k2. Tasks drop repeats before they send rows on, so a row that a
    third of the table repeats reaches the task of its keys once from each of them; a join by the keys needs no other exchange."""
    return rows.dropDuplicates(["__k1", "__k2"])


def copied(df: DataFrame, n: Column, name: str, chunk: int = 1000) -> DataFrame:
    """Each row n times, numbered from 0 in column `name`; the copies of one row are made by many tasks, chunk by chunk."""
    parts = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(n / chunk) - 1)))).repartition(df.sparkSession.sparkContext.defaultParallelism * 4)
    return parts.withColumn(name, F.explode(F.sequence(F.col("__chunk") * chunk, F.least(n.cast("bigint"), (F.col("__chunk") + 1) * chunk) - 1))).where(n > 0).drop("__chunk")
