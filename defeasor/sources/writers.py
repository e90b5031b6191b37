"""Writers: dataset files with metadata, single-run payloads, graphs, views and tables. One JSON document a file where a
format asks for it, else one line a row. Files come from executors; nothing is collected but frames that are handed to a plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unions import union_of


def write_document(frame: DataFrame, path: str, *, pretty: bool = True) -> None:
    """A frame of one row as one JSON document (a folder with one part)."""
    frame.select(F.to_json(F.struct(*frame.columns), {"pretty": str(pretty).lower()})).coalesce(1).write.mode("overwrite").text(path)


def write_samples(metadata: DataFrame, samples: DataFrame, path: str) -> None:
    """A dataset: its metadata as one document in path/metadata, its samples line by line in path/samples."""
    write_document(metadata, f"{path}/metadata")
    samples.write.mode("overwrite").json(f"{path}/samples")


def write_whole_dataset(metadata: DataFrame, samples: DataFrame, path: str) -> None:
    """A dataset as the single document {metadata, samples}; for datasets of a size that one task holds (150 samples)."""
    every = samples.agg(F.array_sort(F.collect_list(F.struct(*samples.columns))).alias("samples"))
    head = metadata.select(F.struct(*metadata.columns).alias("metadata"))
    write_document(head.join(every), path)


def write_run(config: DataFrame, summary: DataFrame, sentences: DataFrame, conversations: DataFrame, path: str) -> None:
    """The payload of one run: config and summary (a row each), sentences (edge_id, sentence) as a map, conversations."""
    one = lambda f, name: f.select(F.struct(*f.columns).alias(name))
    told = sentences.groupBy("edge_id").agg(F.max("sentence").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("edge_id", "s"))).alias("edge_sentences"))  # one graph
    talks = conversations.agg(F.collect_list(F.struct(*conversations.columns)).alias("conversations"))  # one graph
    write_document(one(config, "config").join(one(summary, "graph_summary")).join(told).join(talks), path)


def write_conversations(conversations: DataFrame, path: str) -> None:
    conversations.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A knowledge graph: nodes and edges line by line in folders of these names."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_paraphrases(samples: DataFrame, provenance: dict[str, str], path: str, versions: tuple[str, ...] = ("para1", "para2")) -> None:
    """Copies of a dataset, one a version, each row with where it comes from."""
    source = F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())])
    copies = union_of(*[samples.withColumn("paraphrase_metadata", F.struct(F.lit(v).alias("version"), source.alias("source"))).withColumn("version", F.lit(v)) for v in versions])
    copies.write.mode("overwrite").partitionBy("version").json(path)


def write_properties(properties: DataFrame, path: str) -> None:
    properties.write.mode("overwrite").partitionBy("domain").json(path)


def write_entities(sets: DataFrame, path: str) -> None:
    """Entities with their sorted sets, one line each."""
    sets.write.mode("overwrite").json(path)


def write_seeds(seeds: list[int], frame: DataFrame, path: str, rng_seed: int = 7) -> None:
    """The seed manifest, in the session of the frame."""
    one = frame.sparkSession.range(1).select(F.array(*map(F.lit, seeds)).alias("seeds"), F.lit(rng_seed).alias("seed_rng_seed"), F.lit(seeds[0]).alias("fixed_seed_0"))
    write_document(one, path)


def write_views(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """An SVG drawing of each graph in a page of its own: a row for each graph. nodes: graph_id, node_id, label, x, y, colour;
    edges: graph_id, src, dst, colour, line."""
    pixel = lambda c: (F.col(c) * 90 + 60).cast("int").cast("string")
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    dots = F.concat(F.lit('<circle r="16" cx="'), pixel("x"), F.lit('" cy="'), pixel("y"), F.lit('" fill="'), "colour", F.lit('"/><text x="'), pixel("x"), F.lit('" y="'), pixel("y"), F.lit('">'), safe("label"), F.lit("</text>"))
    at = nodes.select("graph_id", "node_id", pixel("x").alias("px"), pixel("y").alias("py"))
    ends = edges.join(at.toDF("graph_id", "src", "x1", "y1"), ["graph_id", "src"]).join(at.toDF("graph_id", "dst", "x2", "y2"), ["graph_id", "dst"])
    dash = F.when(F.col("line") == "dashed", ' stroke-dasharray="6"').when(F.col("line") == "dotted", ' stroke-dasharray="2"').otherwise("")
    lines = F.concat(F.lit('<line x1="'), "x1", F.lit('" y1="'), "y1", F.lit('" x2="'), "x2", F.lit('" y2="'), "y2", F.lit('" stroke="'), "colour", F.lit('"'), dash, F.lit("/>"))
    parts = union_of(ends.select("graph_id", F.lit(0).alias("o"), lines.alias("s")), nodes.select("graph_id", F.lit(1), dots))
    drawn = parts.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "").alias("s"))  # one graph
    page = F.concat(F.lit('<!DOCTYPE html><html><body><svg width="2400" height="1600" font-size="12">'), "s", F.lit("</svg></body></html>"))
    drawn.select("graph_id", page.alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


def plot_frame(frame: DataFrame, most: int = 100_000):
    """A frame for a plot, as pandas; more than `most` rows are an error, as figures show aggregates."""
    found = frame.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"a figure of more than {most} rows; aggregate first")
    return found


def table_cells(frame: DataFrame) -> DataFrame:
    """Text cells of a result table: shares named acc* as percentages with one decimal, counts with separators of thousands,
    other numbers with three decimals, a dash for null."""
    def cell(c: str, t: str):
        if t in ("double", "float"):
            return F.format_string("%.1f", F.col(c) * 100) if c.startswith("acc") else F.format_string("%.3f", F.col(c).cast("double"))
        return F.format_number(c, 0) if t in ("int", "bigint", "smallint") else F.col(c).cast("string")

    return frame.select(*[F.coalesce(F.when(F.col(c).isNotNull(), cell(c, t)), F.lit("—")).alias(c) for c, t in frame.dtypes])


def write_dump(graphs: DataFrame, samples: DataFrame, path: str) -> None:
    """Each graph (graph_id, graph as JSON text) with its conversations (id sample_<graph_id>, conversations), one line each."""
    both = graphs.withColumn("id", F.concat(F.lit("sample_"), F.col("graph_id").cast("string"))).join(samples, "id", "left")
    whole = F.concat(F.lit('{"graph":'), "graph", F.lit(',"conversations":'), F.coalesce(F.to_json("conversations"), F.lit("[]")), F.lit("}"))
    both.select(whole).write.mode("overwrite").text(path)
