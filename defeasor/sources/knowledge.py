"""Readers for knowledge bases, word banks, stored replies of web services, and a data source for SQLite files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.unions import union_of
from ..operators.text import phonotactic_words
from .files import read_whole

NODE = "struct<kind:string,kb_source:string,kb_id:string,canonical_label:string,surface:struct<singular:string,plural:string,indef_article:string>,semantic_type:string,domain:string,aliases:array<string>,mask_label:string>"
GRAPH = f"struct<nodes:map<string,{NODE}>,edges:array<struct<source:string,target:string,relation:string,context:string>>>"
PROPERTY = "struct<property_family:string,frame_type:string,predicate_lemma:string,positive_realization:string,negative_realization:string,positive_plural_realization:string,negative_plural_realization:string,allowed_subject_types:array<string>,domain:string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_whole, but a missing file or JSON that does not parse raises an error when the rows are read."""
    text = spark.read.text(path, wholetext=True)
    value = F.from_json("value", schema)
    broken = F.try_parse_json("value").isNull()
    return text.select(F.when(broken, F.raise_error(F.lit(f"no valid JSON in {path}"))).otherwise(value).alias("value"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an ontology; a missing relation is subclass."""
    g = read_strict(spark, path, GRAPH)
    nodes = g.select(F.explode("value.nodes").alias("node_id", "n")).select("node_id", "n.*")
    edges = g.select(F.posexplode("value.edges").alias("ord", "e")).select("ord", "e.source", "e.target", F.coalesce("e.relation", F.lit("subclass")).alias("relation"), "e.context")
    return nodes, edges


def label_index(nodes: DataFrame) -> DataFrame:
    """(label, node_ids): the ids of each label, whatever its case."""
    return nodes.groupBy(F.lower("canonical_label").alias("label")).agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))  # homonyms


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Properties with their nine fields, from a file or a stored structured reply {"properties": [...]}."""
    return read_whole(spark, path, f"struct<properties:array<{PROPERTY}>>").select(F.explode("value.properties").alias("p")).select("p.*")


def read_banks(spark: SparkSession, path: str) -> DataFrame:
    """(domain, word) of a bank of invented words; no rows if the file is missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], "domain string, word string")
    return read_whole(spark, path, "map<string,array<string>>").select(F.explode("value").alias("domain", "words")).select("domain", F.explode("words").alias("word"))


def read_premises(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV file with a header."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return table.select(F.col(f"`{table.columns[0]}`").alias("premise"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed_index, seed) of a seed manifest."""
    return read_whole(spark, path, "struct<seeds:array<int>,seed_rng_seed:int,fixed_seed_0:int>").select(F.posexplode("value.seeds").alias("seed_index", "seed"))


def read_hyponyms(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, lemmas, definition, domain) of an exported word net."""
    return spark.read.schema("parent string, child string, lemmas array<string>, definition string, domain string").parquet(path)


def read_entity_hits(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, description): the first hit of each stored reply of an entity search."""
    hit = "struct<id:string,label:string,description:string>"
    return read_whole(spark, path, f"struct<search:array<{hit}>>").select(F.get("value.search", F.lit(0)).alias("h")).where("h is not null").select("h.*")


def read_bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The bindings of stored query results, a column for each name (null where it is not bound)."""
    cell = "struct<type:string,value:string>"
    b = read_whole(spark, path, f"struct<results:struct<bindings:array<map<string,{cell}>>>>").select(F.explode("value.results.bindings").alias("b"))
    return b.select(*[F.try_element_at("b", F.lit(n))["value"].alias(n) for n in names])


def read_lexical(spark: SparkSession, path: str) -> DataFrame:
    """(word, relation, found) of stored replies of a word service, one directory a query: relation=<r>/word=<w>/*.json. A
    broken reply gives no rows."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("f"))
    part = lambda k: F.regexp_extract("f", f"{k}=([^/]+)", 1)
    items = F.explode(F.from_json("value", "array<struct<word:string,score:bigint>>"))
    return files.select(part("word").alias("word"), part("relation").alias("relation"), items.alias("i")).select("word", "relation", F.col("i.word").alias("found"))


def json_words(json: str = "value") -> "F.Column":
    """All words in the string values of a JSON text at any depth, letters only; keys are no words."""
    strings = F.regexp_extract_all(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"\s*:', " "), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(strings, lambda s: F.regexp_replace(s, r"\\[ntrbf]", " "))
    words = F.flatten(F.transform(plain, lambda s: F.split(F.trim(s), r"\s+")))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w != "")


def reference_words(spark: SparkSession, path: str | None, *, key: str | None = None, field: str | None = None, default: list[str] | None = None) -> DataFrame:
    """Words under a key of a JSON object (instead of the defaults, if there are any), or in a field of the objects of a JSON
    list (after the defaults); the defaults alone if there is no file."""
    start = spark.createDataFrame([(w,) for w in default or []], "word string")
    if not path or not exists(spark, path):
        return start
    text = spark.read.text(path, wholetext=True)
    if key:
        found = text.select(F.explode(json_words(F.get_json_object("value", f"$.{key}"))).alias("word"))
        return start if found.isEmpty() else found
    items = text.select(F.explode(F.from_json("value", "array<string>")).alias("o")).select(F.get_json_object("o", f"$.{field}").alias("v")).where("v is not null")
    return union_of(start, items.select(F.explode(json_words(F.concat(F.lit('["'), F.replace("v", F.lit('"'), F.lit(" ")), F.lit('"]')))).alias("word")))


def root_words(lexical: DataFrame, words: list[str], size: int) -> DataFrame:
    """The corpus of some root words: at most `size` words of each, letters only, in their order."""
    from ..operators.pools import word_corpus

    spark = lexical.sparkSession
    from pyspark.sql.window import Window

    roots = spark.createDataFrame([(w,) for w in words], "word string")
    ranked = word_corpus(lexical, roots).withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("found")))
    return ranked.where(F.col("r") <= size).select(F.col("found").alias("word")).distinct()


#: Corpora by kind; each takes (spark, **options) and returns a frame with a column word.
CORPORA: dict[str, Callable[..., DataFrame]] = {
    "phonotactic": lambda spark, size=3000, **_: phonotactic_words(spark, size).select("word"),
    "reference": lambda spark, path=None, key=None, field=None, words=(), **_: reference_words(spark, path, key=key, field=field, default=list(words)),
    "rootword": lambda spark, lexical=None, words=(), size=100, **_: root_words(lexical, list(words), size) if lexical is not None else reference_words(spark, None, default=list(words)),
}


def corpus(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in CORPORA:
        raise ValueError(f"no corpus of the kind {kind}")
    return CORPORA[kind](spark, **options)


def appended(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A graph with another's nodes and edges added: ids and (source, target) pairs that are there stay as they are."""
    first = lambda a, b, keys: a.unionByName(b.join(a.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)
    return first(old[0], new[0], ["node_id"]), first(old[1], new[1], ["source", "target"])


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    """Ranges of row numbers, one a partition; the file must be on a path that all executors see."""

    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{os.path.abspath(self.path)}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        lo, hi = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()  # noqa: S608  names come from the caller's schema
        con.close()
        if lo is None:
            return [Rows(0, 0)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [Rows(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        con, names = self._open(), ", ".join(f'"{c}"' for c in self.columns)
        yield from con.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.lo, partition.hi))  # noqa: S608
        con.close()


class Sqlite(DataSource):
    """spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...).load(), read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema of the table")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("partitions", "8")))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(Sqlite)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).load()


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(start, relation, end, weight) of a concept graph in SQLite tables edge_norm, node_norm and rel_norm."""
    from ..operators.pools import concept_edges

    return concept_edges(read_sqlite(spark, path, "edge_norm", "start_fk bigint, end_fk bigint, rel_fk bigint, weight double"), read_sqlite(spark, path, "node_norm", "node_pk bigint, node_url string"), read_sqlite(spark, path, "rel_norm", "rel_pk bigint, rel_url string", 1))
