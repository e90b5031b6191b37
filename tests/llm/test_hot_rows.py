"""A row that a third of a table repeats meets in no task, and no copy of it is lost."""

import re
from collections import Counter

import pytest

from defeasor.llm import mixing, shards


@pytest.fixture
def docs(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = [(i, f"text {i}", "a") for i in range(400)] + [(7, "hot row", "b")] * 200
    yield spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dropped_first(df) -> bool:
    """Whether all rows that are dealt by their keys went through an aggregation of their task before."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(plan) if re.search(r"Exchange hashpartitioning\(__k1", line)]
    below = [" ".join(plan[i + 1 : i + 3]) for i in dealt]
    texts = [x for x in below if "partial_first(__row" in x]
    return bool(texts) and all("partial_first(__row" in x or "FileScan" in " ".join(plan[i : i + 6]) for i, x in zip(dealt, below))


def test_shards(spark, docs):
    out = shards.shard_rows(docs, n_shards=7)
    assert dropped_first(out)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows)[7] == 201 and len(rows) == 600
    assert len({(r["shard"], r["slot"]) for r in rows}) == 600
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_mix(spark, docs):
    out = mixing.mix(docs)
    assert dropped_first(out)
    taken = Counter()
    for r in mixing.mix_report(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert +words == +taken
