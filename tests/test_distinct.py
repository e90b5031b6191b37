"""The search for distinct graphs against one that tries them one by one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from defeasor.operators import distinct


def prints(kinds):
    return lambda ids: ids.select(F.col("id").alias("graph_id"), F.md5((F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 7), 16, 10).cast("bigint") % kinds).cast("string").cast("binary")).alias("fingerprint"))


def slow_search(ids, kinds, known, wanted, stop):
    accepted, run, tried = [], 0, 0
    for i in sorted(ids):
        if wanted is not None and len(accepted) >= wanted:
            return accepted, tried, False
        tried += 1
        f = hashlib.md5(str(int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16) % kinds).encode()).hexdigest()
        if f in known:
            run += 1
            if run >= stop:
                return accepted, tried, True
        else:
            known.add(f)
            run = 0
            accepted.append((i, f))
    return accepted, tried, False


@pytest.mark.parametrize("kinds,wanted,stop,first", [(40, None, 6, 32), (40, 20, 50, 16), (1000, 60, 5, 64), (40, 0, 3, 8)])
def test_search(spark, tmp_path, kinds, wanted, stop, first):
    ids = [*range(-5, 90), *range(200, 320, 3)]
    frame, store, known = spark.createDataFrame([(i,) for i in ids], "id long"), str(tmp_path / "store"), set()
    for _ in range(2):  # the second search finds the fingerprints of the first one in the store
        got, report = distinct.search(frame, prints(kinds), store, wanted=wanted, stop=stop, first_round=first)
        accepted, tried, saturated = slow_search(ids, kinds, known, wanted, stop)
        assert sorted(map(tuple, got.collect())) == accepted
        assert (report.accepted, report.attempts, report.saturated) == (len(accepted), tried, saturated)
        assert report.duplicates == tried - len(accepted) and 0 <= report.duplicate_rate <= 1
    kept = [r["fingerprint"] for r in distinct.stored(spark, store).collect()]
    assert sorted(kept) == sorted(known)


def test_no_candidates(spark, tmp_path):
    got, report = distinct.search(spark.createDataFrame([], "id long"), prints(3), str(tmp_path / "s"), wanted=3)
    assert got.collect() == [] and report == distinct.Report(3, 0, 0, 0, False)


def test_default_fingerprints(spark):
    from defeasor.operators import structures

    nodes, edges = structures.default_graphs(spark, 40)
    got = {r["graph_id"]: r["fingerprint"] for r in distinct.default_fingerprints(nodes, edges, F.lit("animal")).collect()}
    layers = {(r["graph_id"], r["node_id"]): r["layer"] for r in nodes.collect()}
    for g in range(40):
        kinds = [r["type"] for r in nodes.where(F.col("graph_id") == g).collect()] if g < 3 else None
        if kinds:
            ev = sorted((int(r["src"].split("_")[1]), layers[g, r["dst"]], r["type"]) for r in edges.where((F.col("graph_id") == g) & F.col("type").startswith("defeasible")).collect())
            line = "|".join(["animal", *[str(kinds.count(t)) for t in ("property", "entity", "irrelevant_property")], ",".join(":".join(map(str, e)) for e in ev)])
            assert got[g] == hashlib.md5(line.encode()).hexdigest()
    assert len(got) == 40


def test_command_makes_no_graph_twice(spark, tmp_path):
    from defeasor import run

    first = run.generate_distinct(spark, str(tmp_path), "linear_inheritance", "easy", 12, 7)
    assert first.accepted == 12 and not first.saturated
    path = f"{tmp_path}/linear_inheritance_easy_distinct"
    kept = [r["fingerprint"] for r in distinct.stored(spark, f"{path}/store").collect()]
    assert len(kept) == len(set(kept)) == 12
    again, report = distinct.search(spark.range(200), run.fingerprints(spark, "linear_inheritance", "easy", 7), f"{path}/store", wanted=5, first_round=256)
    assert report.accepted == 5 and not {r["fingerprint"] for r in again.collect()} & set(kept)
    meta = spark.read.option("multiLine", True).json(f"{path}/dataset/metadata").first()
    assert meta["num_samples_generated"] == 12 and meta["attempts"] == first.attempts and meta["saturated"] is False
