"""Commands: python -m defeasor.run generate|reseed|paraphrase|debug ... ; each writes below --out."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import distinct, structures
from .operators import generate as structural
from .plans import datasets
from .sources import files, writers


def generate(spark: SparkSession, out: str, topologies: list[str], difficulties: list[str], n: int, seed: int) -> list[str]:
    """A dataset for each topology and difficulty; the paths written."""
    paths = []
    for topology in topologies:
        for difficulty in difficulties:
            turns = datasets.dataset(spark, topology, n, difficulty, seed)
            path = f"{out}/{topology}_{difficulty}"
            writers.write_samples(datasets.metadata(turns, topology, difficulty, n, seed), datasets.samples(turns), path)
            paths.append(path)
    return paths


def fingerprints(spark: SparkSession, topology: str, difficulty: str, seed: int) -> Callable[[DataFrame], DataFrame]:
    """What makes two raw graphs of a topology duplicates, under the concept drawn for each."""
    concept = structural.drawn_choice("graph_id", structural.CONCEPTS, seed=seed)
    under = lambda f, form: f.select("graph_id", F.md5(F.concat_ws("|", concept, form).cast("binary")).alias("fingerprint"))
    if topology == "linear_inheritance":
        return lambda ids: under(structural.linear_fingerprints(structural.linear_graphs(spark, ids, *datasets.LINEAR_LENGTHS[difficulty], seed)), "fingerprint")
    if topology == "tree_inheritance":
        preset = datasets.TREE_PRESET[difficulty]
        return lambda ids: under(structural.canonical_trees(structural.tree_nodes(spark, ids, preset, seed), structural.TREE_PRESETS[preset][0]), "form")
    return lambda ids: distinct.default_fingerprints(*structures.default_graphs(spark, ids, difficulty, seed), concept)


def generate_distinct(spark: SparkSession, out: str, topology: str, difficulty: str, n: int, seed: int, most_attempts: int = 1 << 20) -> distinct.Report:
    """A dataset of n graphs of which no two are alike, nor like one of an earlier run over the same folder; its metadata has the
    counts of the search, which ends at 15 (classes: 10) duplicates in a row."""
    path = f"{out}/{topology}_{difficulty}_distinct"
    stop = 10 if "inheritance" in topology else 15
    ids, report = distinct.search(spark.range(most_attempts), fingerprints(spark, topology, difficulty, seed), f"{path}/store", wanted=n, stop=stop, first_round=max(256, 2 * n))
    turns = datasets.dataset(spark, topology, ids.select(F.col("graph_id").alias("id")), difficulty, seed)
    counts = {"attempts": report.attempts, "duplicates": report.duplicates, "saturated": report.saturated}
    meta = datasets.metadata(turns, topology, difficulty, n, seed).select("*", *[F.lit(v).alias(k) for k, v in counts.items()])
    writers.write_samples(meta, datasets.samples(turns), f"{path}/dataset")
    return report


def reseed(spark: SparkSession, out: str, topologies: list[str], n: int, only: int | None = None, seeds: list[int] | None = None) -> None:
    """Datasets of all seeds (or one), partitioned by topology and seed, and the manifest of seeds."""
    for topology in topologies:
        turns = datasets.reseeded(spark, topology, n, "easy", seeds, only)
        files.write_dataset(turns.withColumn("topology", F.lit(topology)), f"{out}/{topology}", ["seed"])
    writers.write_seeds(seeds or datasets.SEEDS, spark.range(1), f"{out}/seeds")


def paraphrase(spark: SparkSession, path: str, out: str, rewrite, provider: str, batch: int = 5, most: int | None = None) -> None:
    """Two paraphrased copies of a dataset. rewrite: (texts) -> texts; `most` is a limit the caller asks for."""
    from .extensions import paraphrased

    samples = spark.read.json(f"{path}/samples")
    samples = samples if most is None else samples.orderBy("id").limit(most)
    turns = samples.select("id", F.explode("conversations").alias("c")).select("id", F.col("c.id").alias("conv_id"), F.explode("c.turns").alias("t")).select("id", "conv_id", "t.turn_ord", F.col("t.content").alias("text"))
    new = paraphrased(turns.where("turn_ord = 0"), rewrite, F.col("text"), batch)
    writers.write_paraphrases(new, {"provider": provider, "source": path}, out)


def debug(spark: SparkSession, stage: str, n: int = 3, difficulty: str = "easy", seed: int = 42) -> DataFrame:
    """The result of one stage of a default run: graph, chains, records or turns."""
    from .operators import records

    nodes, edges = structures.default_graphs(spark, n, difficulty, seed)
    stages = {"nodes": lambda: nodes, "graph": lambda: edges, "chains": lambda: structures.chains(edges), "records": lambda: records.all_records(nodes, edges, quantified=True), "turns": lambda: datasets.default_turns(nodes, edges)}
    if stage not in stages:
        raise ValueError(f"no stage {stage}; there are {', '.join(stages)}")
    return stages[stage]()


def properties(spark: SparkSession, domains: list[str], model, out: str) -> None:
    """A property knowledge base: a structured reply of the model for each domain, one JSON object each; bad ones are left out."""
    from .extensions import replies
    from .sources.knowledge import PROPERTY

    asked = spark.createDataFrame([(d, d) for d in domains], "key string, prompt string")
    parsed = replies(asked, model).select(F.explode(F.from_json("reply", f"struct<properties:array<{PROPERTY}>>")["properties"]).alias("p")).select("p.*")
    writers.write_properties(parsed, out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="defeasor.run")
    p.add_argument("command", choices=["generate", "reseed", "debug"])
    p.add_argument("--out", default="datasets")
    p.add_argument("--topology", action="append", choices=sorted(datasets.TOPOLOGIES))
    p.add_argument("--difficulty", action="append", choices=["easy", "hard"])
    p.add_argument("--samples", type=int, default=150)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--seed-index", type=int)
    p.add_argument("--stage", default="turns")
    p.add_argument("--distinct", action="store_true", help="no two graphs alike, nor like those of earlier runs in --out")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("defeasor").getOrCreate()
    topologies = a.topology or sorted(datasets.TOPOLOGIES)
    if a.command == "generate" and a.distinct:
        for topology in topologies:
            for difficulty in a.difficulty or ["easy", "hard"]:
                print(topology, difficulty, generate_distinct(spark, a.out, topology, difficulty, a.samples, a.seed))
    elif a.command == "generate":
        generate(spark, a.out, topologies, a.difficulty or ["easy", "hard"], a.samples, a.seed)
    elif a.command == "reseed":
        reseed(spark, a.out, topologies, min(a.samples, 30), a.seed_index)
    else:
        debug(spark, a.stage, a.samples, (a.difficulty or ["easy"])[0], a.seed).show(50, truncate=False)


if __name__ == "__main__":
    main()
