"""Generation until enough distinct graphs: rounds of candidates against a store of accepted fingerprints.

Candidates are tried in the order of their ids. One whose fingerprint is neither in the store nor that of an earlier one is
accepted; after ``stop`` duplicates in a row the search ends. A round makes a range of candidates, marks what is new by an
anti-join with the store and the first of each fingerprint, and finds by running counts over the round where it ends: at the
last graph wanted, or at the first run that is too long, with the run that the round before ended in carried on. Accepted
rows are appended to the store, so a later search over the same store, by any session, makes none of them again.

Rounds double in size, so their number is the logarithm of the candidates; each collects one row of counts. A search that is
cut off between a round's rows and its log finds these rows as duplicates when it is repeated; none is made twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from ..functions.stored import written
from .ranking import number_bucket, numbered, running_max

STORE = "fingerprint string, graph_id bigint"


@dataclass(frozen=True)
class Report:
    """What a search did: how many graphs were wanted, accepted and tried, and whether it ended in duplicates."""

    requested: int | None
    accepted: int
    attempts: int
    duplicates: int
    saturated: bool

    @property
    def duplicate_rate(self) -> float:
        return self.duplicates / self.attempts if self.attempts else 0.0


def stored(spark: SparkSession, store: str) -> DataFrame:
    """Fingerprints accepted so far; none if the store is not there yet."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], STORE)


def _marked(candidates: DataFrame, known: DataFrame, run: int) -> DataFrame:
    """(graph_id, fingerprint, at, is_new, rank, run): places in order, ranks of new ones, and duplicates in a row so far."""
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("graph_id")) == 1
    fresh = candidates.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti").select("graph_id", first.alias("is_new")).where("is_new")
    rows = candidates.join(fresh, "graph_id", "left").select("graph_id", "fingerprint", F.coalesce("is_new", F.lit(False)).alias("is_new"))
    rows = written(rows)
    bucket = number_bucket(rows, "graph_id")
    placed = numbered(rows, bucket, ["graph_id"], "at").drop("n_rows")
    ranks = numbered(placed.where("is_new"), bucket, ["graph_id"], "rank").select("graph_id", "rank")
    placed = running_max(placed, bucket, ["graph_id"], F.when(F.col("is_new"), F.col("at")), "last")
    return written(placed.join(ranks, "graph_id", "left").select("graph_id", "fingerprint", "at", "is_new", "rank", (F.col("at") - F.coalesce("last", F.lit(-run))).alias("run")))


def search(ids: DataFrame, fingerprints: Callable[[DataFrame], DataFrame], store: str, *, wanted: int | None = None, stop: int = 15, first_round: int = 1024) -> tuple[DataFrame, Report]:
    """(graph_id, fingerprint) of the accepted candidates, and the report.

    ids: column id, distinct whole numbers; fingerprints: from ids to (graph_id, fingerprint); wanted: how many (None: as many as
    there are). With no ids, or wanted 0, nothing is tried.
    """
    spark = ids.sparkSession
    lo, hi = ids.agg(F.min("id"), F.max("id")).first()
    accepted: list[DataFrame] = []
    n, attempts, run, size, saturated = 0, 0, 0, first_round, False
    at = lo
    while lo is not None and at <= hi and not saturated and (wanted is None or n < wanted):
        some = ids.where((F.col("id") >= at) & (F.col("id") < at + size))
        rows = _marked(fingerprints(some), stored(spark, store), run)
        enough = F.lit(None) if wanted is None else F.min(F.when(F.col("rank") == wanted - n, F.col("at")))
        ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("run") >= stop, F.col("at"))).alias("full"), enough.cast("bigint").alias("enough"), F.max_by("run", "at").alias("run")).first()
        last = min(x for x in (ends["n"], ends["full"], ends["enough"]) if x is not None)
        made = written(rows.where(F.col("is_new") & (F.col("at") <= last)).select("fingerprint", "graph_id"))
        made.write.mode("append").parquet(store)
        accepted.append(made)
        n += made.count()
        attempts += last
        saturated = ends["full"] is not None and ends["full"] == last
        run, at, size = ends["run"] or run, at + size, size * 2
    out = spark.createDataFrame([], STORE)
    for made in accepted:
        out = out.union(made)
    return out.select("graph_id", "fingerprint"), Report(wanted, n, attempts, attempts - n, saturated)


def default_fingerprints(nodes: DataFrame, edges: DataFrame, concept: Column) -> DataFrame:
    """(graph_id, fingerprint) of default graphs: concept, numbers of properties, entities and irrelevant attributes, and the
    ordered (entity, layer, type) of the evidence. concept: an expression of graph_id."""
    kinds = nodes.groupBy("graph_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("property", "entity", "irrelevant_property")])
    layer = nodes.select("graph_id", F.col("node_id").alias("dst"), "layer")
    ev = edges.where(F.col("type").startswith("defeasible")).join(layer, ["graph_id", "dst"])
    entity = F.regexp_extract("src", r"(\d+)$", 1).cast("int")
    parts = ev.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(entity.alias("e"), "layer", "type"))).alias("parts"))  # one graph
    line = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["e"].cast("string"), x["layer"].cast("string"), x["type"])), ",")
    whole = F.concat_ws("|", concept, *[F.col(t).cast("string") for t in ("property", "entity", "irrelevant_property")], F.coalesce(line, F.lit("")))
    return kinds.join(parts, "graph_id", "left").select("graph_id", F.md5(whole.cast("binary")).alias("fingerprint"))
