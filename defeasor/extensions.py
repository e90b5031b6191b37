"""Where a caller's own pieces plug in: sentence generators, language models, corpora, name generators, graph generators,
knowledge populators, claim planners; and the resolvers as table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import structures
from .operators.skeptical import resolve
from .plans import datasets
from .sources.knowledge import CORPORA

#: A model takes the messages of a batch and returns as many replies; None or an exception means no reply.
Model = Callable[[list[str]], list[str | None]]


def sentences(edges: DataFrame, template: Column, generator: Callable[[str, dict], str | None] | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """edges with sentence: what the generator makes of (type, payload) if it makes anything, else the template."""
    if generator is None:
        return edges.withColumn("sentence", template)

    @F.pandas_udf("string")
    def made(kind: pd.Series, values: pd.DataFrame) -> pd.Series:
        return pd.Series([generator(k, v) or None for k, v in zip(kind, values.to_dict("records"))])

    return edges.withColumn("sentence", F.coalesce(F.nullif(made(F.col("type"), F.struct(*payload)), F.lit("")), template))


def replies(prompts: DataFrame, model: Model, batch: int = 5) -> DataFrame:
    """prompts (key, prompt) with reply, asked in batches; null where the model fails, so that a caller keeps the original."""
    schema = prompts.schema.simpleString()[7:-1].replace(":", " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str | None] = []
            for i in range(0, len(frame), batch):
                part = frame["prompt"].tolist()[i : i + batch]
                try:
                    got = list(model(part))
                except Exception:  # noqa: BLE001  a caller's model may fail in any way
                    got = []
                out += [r or None for r in got[: len(part)]] + [None] * (len(part) - len(got))
            yield frame.assign(reply=out)

    return prompts.mapInPandas(run, f"{schema}, reply string")


def paraphrased(originals: DataFrame, model: Model, prompt: Column, batch: int = 5) -> DataFrame:
    """originals (key, text) with paraphrase: the model's reply, or the text itself."""
    asked = replies(originals.withColumn("prompt", prompt), model, batch)
    return asked.select(*originals.columns, F.coalesce("reply", "text").alias("paraphrase"))


@dataclass(frozen=True)
class Config:
    """What a run is asked for; values of a topology come before those of the run, and these before the defaults."""

    topology: str = "default"
    samples: int = 150
    difficulties: tuple[str, ...] = ("easy", "hard")
    seed: int = 42
    dedup: bool = True
    stop_after: int = 15
    by_topology: dict[str, dict] = field(default_factory=dict)
    own: dict = field(default_factory=dict)

    def value(self, name: str, default=None):
        nested = self.by_topology.get(self.topology, {})
        return nested.get(name, self.own.get(name, getattr(self, name, default)))


def register_corpus(name: str, make: Callable[..., DataFrame]) -> None:
    """make(spark, **options) gives a frame with a column word."""
    CORPORA[name] = make


def register_graphs(topology: str, make: Callable[..., tuple[DataFrame, DataFrame]], turns: Callable[[DataFrame, DataFrame], DataFrame] = datasets.default_turns) -> None:
    """make(spark, n, difficulty, seed) gives (nodes, edges); turns replays them."""
    structures.GENERATORS[topology] = make
    datasets.TOPOLOGIES[topology] = lambda spark, n, difficulty, seed: turns(*make(spark, n, difficulty, seed))


#: Name generators (spark, n) -> frame with a column word, and populators (spark, domain) -> (nodes, edges).
NAMES: dict[str, Callable[[SparkSession, int], DataFrame]] = {"phonotactic": lambda spark, n: CORPORA["phonotactic"](spark, size=n)}
POPULATORS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {}


def populated(spark: SparkSession, kind: str, domains: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a populator for several domains."""
    parts = [POPULATORS[kind](spark, d) for d in domains]
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes.dropDuplicates(["node_id"]), edges.dropDuplicates(["source", "target"])


class ResolveChain:
    """resolve_chain(positives, negatives): the state of a chain from indexes of revealed evidence."""

    def eval(self, positives: list, negatives: list):
        pos, neg = set(positives or ()), set(negatives or ())
        state = "UNDETERMINED" if pos & neg else "ENTAILED" if max([0, *pos]) >= max([-1, *neg]) else "DEFEATED"
        yield (state,)


class ResolveGraph:
    """resolve_graph(edges, subject, target): the skeptical answer over signed edges written "a+b" or "a-b"."""

    def eval(self, edges: list, subject: str, target: str):
        signed = {}
        for e in edges or ():
            at = max(e.find("+"), e.find("-"))
            signed[(e[:at], e[at + 1 :])] = e[at]
        yield (resolve(signed, subject, target),)


def register_functions(spark: SparkSession) -> None:
    """Makes resolve_chain and resolve_graph known to spark.sql."""
    spark.udtf.register("resolve_chain", F.udtf(ResolveChain, returnType="state string"))
    spark.udtf.register("resolve_graph", F.udtf(ResolveGraph, returnType="answer string"))
