"""Readers for knowledge files and writers for datasets. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = "struct<examples:array<string>,template:string,object_template:string>"


def read_whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file: its JSON text parsed by the schema as `value`."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """attribute, ex_pos, example, template, object_template."""
    pool = read_whole(spark, path, f"map<string,{ATTRIBUTE}>").select(F.explode("value").alias("attribute", "v"))
    return pool.select("attribute", F.posexplode("v.examples").alias("ex_pos", "example"), "v.template", "v.object_template")


def read_domain_attributes(spark: SparkSession, path: str) -> DataFrame:
    pool = read_whole(spark, path, f"map<string,map<string,{ATTRIBUTE}>>").select(F.explode("value").alias("domain", "m")).select("domain", F.explode("m").alias("attribute", "v"))
    return pool.select("domain", "attribute", F.posexplode("v.examples").alias("ex_pos", "example"), "v.template", "v.object_template")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """domain, attribute; the last entry of a name wins."""
    d = read_whole(spark, path, "array<struct<domain_name:string,allowed_attributes:array<string>>>").select(F.posexplode("value").alias("ord", "v")).where("v.domain_name is not null")
    return d.groupBy("v.domain_name").agg(F.max_by("v.allowed_attributes", "ord").alias("a")).select(F.col("domain_name").alias("domain"), F.explode("a").alias("attribute"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sample of a dataset file: its id and its turns."""
    turn = "struct<role:string,content:string,task_type:string,ground_truth:string>"
    s = read_whole(spark, path, f"struct<samples:array<struct<id:string,conversations:array<struct<id:string,turns:array<{turn}>>>>>>").select(F.explode("value.samples").alias("s"))
    return s.select(F.col("s.id").alias("sample_id"), F.explode("s.conversations").alias("c")).select("sample_id", F.col("c.id").alias("conv_id"), F.posexplode("c.turns").alias("turn_ord", "t")).select("sample_id", "conv_id", "turn_ord", "t.*")


def write_dataset(turns: DataFrame, path: str, by: list[str]) -> None:
    turns.write.mode("overwrite").partitionBy(*by).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_versions(samples: DataFrame, path: str, versions: tuple[str, ...] = ("para1", "para2")) -> None:
    samples.withColumn("version", F.explode(F.array(*map(F.lit, versions)))).write.mode("overwrite").partitionBy("version").json(path)
