"""The stages on a small input, each against a brute-force version of its decision: scores from slow features, Jaccard
similarities of all pairs, all windows of all items, budgets by the definition, and the law of the shards."""

import math
import os
import re
from collections import Counter

import pytest
from test_learning import slow_features
from test_llm import slow_targets
from test_near_copies import slow_kept

import corpus_pipeline
from defeasor.llm import toxicity
from defeasor.llm.queries import held_out

SF = "/root/testdata/sf0.001"


def kept_by(name, spark, before):
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    if name == "toxicity":
        model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"), held_out=held_out("doc_id"))
        weights = dict(zip(model.slots.tolist(), model.weights.tolist()))
        return [i for i, t in rows if 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + sum(weights.get(s, 0.0) for s in slow_features(t, model.bits)))))) < 0.5]
    if name == "near_dedup":
        return slow_kept(rows)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect():
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    return [i for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    seen = docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        seen = stage(spark, before, SF).persist()
        got = seen.collect()
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert seen.columns == docs.columns
            assert sorted(r["doc_id"] for r in got) == sorted(kept_by(name, spark, before))
        if name == "mixing":
            n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            size, own, took = Counter(), {}, Counter()
            for r in before.collect():
                size[r["source"]] += n(r["text"])
                own[r["doc_id"]] = n(r["text"])
            by = Counter()
            for r in got:
                took[r["source"]] += n(r["text"])
                by[r["doc_id"]] += n(r["text"])
            assert seen.columns == docs.columns and all(by[i] <= 2 * own[i] for i in by)
            assert all(goal - 1 <= took[s] <= goal + 1e-6 for s, goal in slow_targets(size).items())
        if name == "sharding":
            assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in before.collect())
            assert sorted((r["shard"], r["slot"]) for r in got) == sorted((p % 40, p // 40) for p in range(len(got)))
            assert seen.columns[: len(docs.columns)] == docs.columns
