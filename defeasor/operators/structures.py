"""Graphs as tables: the default generator, views of a graph while evidence is revealed, chains and reachability.

nodes: graph_id, node_ord, node_id, type, layer, label; edges: graph_id, edge_ord, src, dst, type, serial. Everything is keyed
by graph_id; what walks a graph does so inside one row that holds the graph's adjacency, so graphs are dealt out freely and
no join is repeated level by level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli, number, order_key, pick, unit
from ..functions.unions import union_of
from .generate import ids_of
from .skeptical import EVIDENCE, NEGATIVE, POSITIVE


@dataclass(frozen=True)
class DefaultShape:
    """Ranges from which a default graph's size is drawn."""

    chain: tuple[int, int]
    objects: tuple[int, int]
    irrelevant: tuple[int, int]
    sparsity: tuple[float, float]
    sections: int
    t4_share: float


# Shapes of default graphs by difficulty.
DEFAULT_SHAPES = {"easy": DefaultShape((5, 10), (2, 3), (1, 2), (0.30, 0.50), 2, 0.5), "hard": DefaultShape((10, 20), (4, 7), (2, 4), (0.40, 0.70), 5, 0.4)}
#: Predicates that label generated nodes where no knowledge base is given.
PREDICATES = ["is red", "can fly", "has wings", "is small", "can swim", "has scales", "is warm", "produces light", "appears striped", "has horns"]
OPPOSITES = ["is not red", "cannot fly", "does not have wings", "is not small", "cannot swim", "is heavy", "has stripes", "does not glow"]


def _between(lo: int, hi: int, purpose: str, seed: int) -> Column:
    return lo + number(purpose, "graph_id", seed=seed) % (hi - lo + 1)


def _property(i: Column) -> Column:
    return F.concat(F.lit("Property_"), i.cast("string"))


def _object(j: Column) -> Column:
    return F.concat(F.lit("Object_"), j.cast("string"))


def default_graphs(spark: SparkSession, n: int | DataFrame, difficulty: str = "easy", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chains of properties with objects at the root, evidence on inner properties, irrelevant attributes
    and a hypothesis for each object. The serial counts a graph's evidence through: by property, then objects in hash order."""
    shape = DEFAULT_SHAPES[difficulty]
    g = ids_of(spark, n).select(F.col("id").alias("graph_id"))
    g = g.select("graph_id", _between(*shape.chain, "dlen", seed).alias("length"), _between(*shape.objects, "dobj", seed).alias("objects"), _between(*shape.irrelevant, "dirr", seed).alias("irrelevant"), (F.lit(shape.sparsity[0]) + unit("dsp", "graph_id", seed=seed) * F.lit(round(shape.sparsity[1] - shape.sparsity[0], 6))).alias("sparsity"))
    upto = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("bigint"), hi))
    chain = g.select("graph_id", "length", upto(0, F.col("length") - 1).alias("i"))
    objects = g.select("graph_id", "length", "sparsity", upto(1, F.col("objects")).alias("j"))
    extra = g.select("graph_id", "objects", upto(0, F.col("irrelevant") - 1).alias("k"))
    nodes = union_of(
        chain.select("graph_id", F.col("i").alias("node_ord"), _property(F.col("i")).alias("node_id"), F.lit("property").alias("type"), (F.col("i") + 1).cast("int").alias("layer"), pick(PREDICATES, "plabel", "graph_id", "i", seed=seed).alias("label")),
        objects.select("graph_id", F.col("j") + 1000, _object(F.col("j")), F.lit("entity"), F.lit(0), F.concat(F.lit("Entity "), F.col("j").cast("string"))),
        extra.select("graph_id", F.col("k") + 2000, F.concat(F.lit("Irrelevant_"), F.col("k").cast("string")), F.lit("irrelevant_property"), F.lit(1), pick(OPPOSITES, "ilabel", "graph_id", "k", seed=seed)),
    )
    none, root, leaf = F.lit(None).cast("int"), F.lit("Property_0"), _property(F.col("length") - 1)
    target = F.concat(F.lit("Irrelevant_"), F.col("k").cast("string"))
    pairs = objects.where("length > 2").withColumn("i", upto(1, F.col("length") - 2)).where(unit("dev", "graph_id", "i", "j", seed=seed) < F.col("sparsity"))
    serial = F.row_number().over(Window.partitionBy("graph_id").orderBy("i", order_key("dser", "graph_id", "i", "j", seed=seed)))
    sign = F.when(bernoulli(0.5, "dsign", "graph_id", "i", "j", seed=seed), "defeasible_has_property").otherwise("defeasible_lacks_property")
    edges = union_of(
        chain.where("i > 0").select("graph_id", F.col("i").alias("edge_ord"), _property(F.col("i") - 1).alias("src"), _property(F.col("i")).alias("dst"), F.lit("implies").alias("type"), none.alias("serial")),
        objects.select("graph_id", F.col("j") + 1000, _object(F.col("j")), root, F.lit("is_a"), none),
        extra.select("graph_id", F.col("k") + 2000, _object(1 + number("iobj", "graph_id", "k", seed=seed) % F.col("objects")), target, F.lit("has_attribute"), none),
        objects.select("graph_id", F.col("j") + 3000, _object(F.col("j")), leaf, F.lit("hypothesis_edge"), none),
        pairs.select("graph_id", F.col("i") * 100 + F.col("j") + 4000, _object(F.col("j")), _property(F.col("i")), sign, serial),
    )
    return nodes, edges


def leaf_target(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, target: of the properties without an outgoing edge the one of the greatest (layer, id as a string)."""
    inner = edges.where("type = 'implies'").select("graph_id", F.col("src").alias("node_id")).distinct()
    leaves = nodes.where("type = 'property'").join(inner, ["graph_id", "node_id"], "left_anti")
    return leaves.groupBy("graph_id").agg(F.max(F.struct("layer", "node_id")).alias("m")).select("graph_id", F.col("m.node_id").alias("target"))


def intermediate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Properties below the first layer that imply something."""
    return nodes.where("type = 'property' and layer > 1").join(edges.where("type = 'implies'").select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_semi")


def neighbours(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(graph_id, node, neighbour) over outgoing edges, of one type if given."""
    some = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    return some.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def hypotheses(edges: DataFrame) -> DataFrame:
    """(graph_id, target, subjects, first): targets with their distinct subjects in the order of first sight."""
    h = edges.where("type = 'hypothesis_edge'").groupBy("graph_id", "dst", "src").agg(F.min("edge_ord").alias("o"))
    order = F.array_sort(F.collect_list(F.struct("o", "src")))  # one graph's subjects
    return h.groupBy("graph_id", F.col("dst").alias("target")).agg(order.alias("s"), F.min("o").alias("first")).select("graph_id", "target", F.col("s.src").alias("subjects"), "first")


def topology(edges: DataFrame, declared: Column) -> DataFrame:
    """graph_id, topology: what the graph declares, else inheritance if it has such an edge, else default."""
    return edges.groupBy("graph_id").agg(F.max(declared).alias("d"), F.bool_or(F.col("type") == "inheritance").alias("i")).select("graph_id", F.coalesce("d", F.when(F.col("i"), "inheritance").otherwise("default")).alias("topology"))


def _with_target_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("type").alias("dst_type")), ["graph_id", "dst"], "left")


def is_update(edge_type: Column, dst_type: Column) -> Column:
    return edge_type.isin(*EVIDENCE) | ((edge_type == "has_attribute") & (F.coalesce(dst_type, F.lit("")) == "irrelevant_property"))


def base_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that are there from the start: neither evidence nor irrelevant attributes."""
    return _with_target_type(nodes, edges).where(~is_update(F.col("type"), F.col("dst_type"))).select(*edges.columns)


def revealed_graph(nodes: DataFrame, edges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, edges): what is known at each cutoff of a graph (graph_id, cutoff): no hypothesis, and updates with a serial
    (missing: 0) up to it."""
    known = _with_target_type(nodes, edges).where("type <> 'hypothesis_edge'")
    late = is_update(F.col("type"), F.col("dst_type")) & (F.coalesce("serial", F.lit(0)) > F.col("cutoff"))
    return known.join(cutoffs, "graph_id").where(~late).select("cutoff", *edges.columns)


def exception_members(edges: DataFrame) -> DataFrame:
    """Evidence on targets that have two or more members of both signs, with the group's size and first serial."""
    w = Window.partitionBy("graph_id", "dst")
    e = edges.where(F.col("type").isin(*EVIDENCE)).withColumns({"members": F.count(F.lit(1)).over(w), "kinds": F.size(F.collect_set("type").over(w)), "first_serial": F.min("serial").over(w)})
    return e.where("members >= 2 and kinds = 2").drop("kinds")


def inferred_edges(edges: DataFrame) -> DataFrame:
    """Members of two that follow once the other one has been revealed: (graph_id, src, dst, type, from_serial, to_serial),
    known without being told while from_serial <= t < to_serial."""
    pairs = exception_members(edges).where("members = 2")
    w = Window.partitionBy("graph_id", "dst").orderBy("serial")
    return pairs.withColumn("from_serial", F.lag("serial").over(w)).where("from_serial is not null").select("graph_id", "src", "dst", "type", "from_serial", F.col("serial").alias("to_serial"))


def adjacency(edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """graph_id with a map from each node to its neighbours in order of edges."""
    by = edges.groupBy("graph_id", F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct("edge_ord", F.col(value).alias("v")))).alias("v"))
    return by.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v.v"))).alias(name))  # one graph


def chains(edges: DataFrame) -> DataFrame:
    """(graph_id, subject, target, chain): from the subject's root along implies edges to the target.

    The way goes back from the target: to the root if it is among the parents, else to the first parent. A broken or
    circular way gives the empty chain."""
    parents = adjacency(edges.where("type = 'implies'"), "dst", "src", "parents")
    roots = edges.where("type = 'is_a'").groupBy("graph_id", F.col("src").alias("subject")).agg(F.min_by("dst", "edge_ord").alias("root"))
    asked = edges.where("type = 'hypothesis_edge'").select("graph_id", F.col("src").alias("subject"), F.col("dst").alias("target"))
    asked = asked.join(roots, ["graph_id", "subject"], "left").join(parents, "graph_id", "left")

    def back(way: Column, _: Column) -> Column:
        at = F.try_element_at(way, F.lit(-1))
        above = F.try_element_at("parents", at)
        to = F.when(F.array_contains(above, F.col("root")), F.col("root")).otherwise(F.get(above, F.lit(0)))
        stuck = to.isNull() | F.array_contains(way, to)
        return F.when((at == F.col("root")) | at.isNull(), way).when(stuck, F.array().cast("array<string>")).otherwise(F.array_append(way, to))

    steps = F.sequence(F.lit(1), F.coalesce(F.size("parents"), F.lit(0)) + 1)
    way = F.aggregate(steps, F.array("target"), back)
    done = F.col("root").isNotNull() & (F.try_element_at(way, F.lit(-1)) == F.col("root"))
    return asked.select("graph_id", "subject", "target", F.when(done, F.reverse(way)).otherwise(F.array().cast("array<string>")).alias("chain"))


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, a, b) with reaches: whether b is a or a way of edges of either sign, evidence included, leads there;
    False for nodes without any such edge."""
    signed = edges.where(F.col("type").isin(*POSITIVE, *NEGATIVE))
    onward = adjacency(signed, "src", "dst", "onward")
    ends = signed.select("graph_id", F.explode(F.array("src", "dst")).alias("n")).groupBy("graph_id").agg(F.collect_set("n").alias("there"))  # one graph's nodes
    rows = pairs.join(onward, "graph_id", "left").join(ends, "graph_id", "left")
    widen = lambda seen, _: F.array_union(seen, F.flatten(F.transform(seen, lambda x: F.coalesce(F.try_element_at("onward", x), F.array().cast("array<string>")))))
    seen = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(F.size("there"), F.lit(1)))), F.array("a"), widen)
    there = F.coalesce(F.array_contains("there", F.col("a")) & F.array_contains("there", F.col("b")), F.lit(False))
    return rows.select(*pairs.columns, (there & F.array_contains(seen, F.col("b"))).alias("reaches"))


def layouts(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(graph_id, node_id, x, y) for kind "chain" (one row in order of layers) or "columns" (a column for each type, in order
    of ids); trees have populate.tree_layout."""
    w = Window.partitionBy("graph_id").orderBy("layer", "node_ord") if kind == "chain" else Window.partitionBy("graph_id", "type").orderBy("node_ord")
    column = F.when(F.col("type").isin("entity", "class"), 0).when(F.col("type") == "property", 1).otherwise(2)
    at = (F.row_number().over(w) - 1).cast("double")
    return nodes.select("graph_id", "node_id", at.alias("x") if kind == "chain" else column.cast("double").alias("x"), F.lit(0.0).alias("y") if kind == "chain" else at.alias("y"))


# Colours of node and edge kinds.
NODE_STYLE = {"entity": "#7fb3d5", "class": "#7fb3d5", "property": "#82e0aa", "irrelevant_property": "#d5d8dc"}
EDGE_STYLE = {"defeasible_has_property": ("#1e8449", "dashed"), "defeasible_lacks_property": ("#c0392b", "dashed"), "hypothesis_edge": ("#7d3c98", "dotted")}


def styles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with colour, edges with colour and line: what a drawing needs beside a layout."""
    of = lambda table, default: lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))
    colour, line = {k: v[0] for k, v in EDGE_STYLE.items()}, {k: v[1] for k, v in EDGE_STYLE.items()}
    return nodes.withColumn("colour", of(NODE_STYLE, "#ffffff")(F.col("type"))), edges.withColumns({"colour": of(colour, "#566573")(F.col("type")), "line": of(line, "solid")(F.col("type"))})


def dictionaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id and the graph as one JSON text of nodes and edges, in their order."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", "node_id", "type", "layer", "label"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("edge_ord", "src", "dst", "type", "serial"))).alias("edges"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("graph"))


GRAPH_JSON = "struct<nodes:array<struct<node_ord:bigint,node_id:string,type:string,layer:int,label:string>>,edges:array<struct<edge_ord:bigint,src:string,dst:string,type:string,serial:int>>>"


def from_dictionaries(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from what ``dictionaries`` makes."""
    g = graphs.select("graph_id", F.from_json("graph", GRAPH_JSON).alias("g"))
    return g.select("graph_id", F.explode("g.nodes").alias("n")).select("graph_id", "n.*"), g.select("graph_id", F.explode("g.edges").alias("e")).select("graph_id", "e.*")


#: Graph generators by topology; X.register adds one. Each takes (spark, n, difficulty, seed) and returns (nodes, edges).
GENERATORS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"default": default_graphs}
