"""Tables in the folder that the driver and all executors share; they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .unions import sound_unions

_own: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str = "step") -> str:
    """A path in the folder of spark.checkpoint.dir (a temporary one for a local session without the setting), deleted when the
    driver's JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="defeasor-")
        folder = _own[app]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a written table."""
    spark = df.sparkSession
    sound_unions(spark)
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
