"""Files, generators, streams, and every query against its SQL."""

import json
import os

import pytest

from defeasor.operators import generate
from defeasor.sources import files
from defeasor.streaming import reveal

SF = "/root/testdata/sf0.001"


def test_knowledge_files(spark, tmp_path):
    pool = {"color": {"examples": ["Red", "Blue"], "template": "are [value]", "object_template": "is [value]"}, "shape": {"examples": ["Round"], "template": "are [value]", "object_template": "is [value]"}}
    (tmp_path / "a.json").write_text(json.dumps(pool, indent=2))
    (tmp_path / "d.json").write_text(json.dumps({"Animal": pool}))
    (tmp_path / "k.json").write_text(json.dumps([{"domain_name": "Animal", "allowed_attributes": ["color"]}, {"allowed_attributes": ["x"]}, {"domain_name": "Animal", "allowed_attributes": ["shape"]}]))
    (tmp_path / "n.txt").write_text("Ann\n\n  Bo \n")
    assert [tuple(r) for r in files.read_attributes(spark, str(tmp_path / "a.json")).select("attribute", "ex_pos", "example").collect()] == [("color", 0, "Red"), ("color", 1, "Blue"), ("shape", 0, "Round")]
    assert files.read_domain_attributes(spark, str(tmp_path / "d.json")).count() == 3
    assert [tuple(r) for r in files.read_domains(spark, str(tmp_path / "k.json")).collect()] == [("Animal", "shape")]
    assert [r["name"] for r in files.read_lines(spark, str(tmp_path / "n.txt")).collect()] == ["Ann", "Bo"]


def test_dataset_round_trip(spark, tmp_path):
    turns = [{"role": "user", "content": "c", "task_type": "t", "ground_truth": "g"}]
    (tmp_path / "s.json").write_text(json.dumps({"metadata": {}, "samples": [{"id": "1", "conversations": [{"id": "x", "turns": turns * 2}]}]}))
    got = files.read_samples(spark, str(tmp_path / "s.json"))
    assert got.count() == 2
    files.write_dataset(got, str(tmp_path / "out"), ["conv_id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    files.write_versions(got, str(tmp_path / "v"))
    assert {r["version"] for r in spark.read.json(str(tmp_path / "v")).collect()} == {"para1", "para2"}


def test_generator_invariants(spark):
    g = generate.linear_graphs(spark, 50).collect()
    for i in range(50):
        mine = [r for r in g if r["graph_id"] == i]
        depth = max(r["layer"] for r in mine)
        ev = [r for r in mine if r["type"].startswith("defeasible")]
        assert sum(r["type"] == "inheritance" for r in mine) == depth and 4 <= depth <= 6
        assert max(1, depth // 2) <= len(ev) <= depth - 1 and sorted(r["serial"] for r in ev) == list(range(1, len(ev) + 1))
    trees = generate.tree_nodes(spark, 20, "balanced").groupBy("graph_id").count().collect()
    assert all(r["count"] == 15 for r in trees)
    jelly = generate.tree_nodes(spark, 20, "no such preset").where("layer = 1").groupBy("graph_id").count().collect()
    assert all(r["count"] == 5 for r in jelly)
    a = spark.createDataFrame([(1, "0", None, 0), (1, "0.1", "0", 1), (1, "0.2", "0", 1), (1, "0.1.1", "0.1", 2), (2, "0", None, 0), (2, "0.1", "0", 1), (2, "0.2", "0", 1), (2, "0.2.1", "0.2", 2)], "graph_id long, node string, parent string, layer int")
    assert len({r["form"] for r in generate.canonical_trees(a, 2).collect()}) == 1


def test_streaming_states(spark, tmp_path):
    spark.createDataFrame([(1, 3, 1), (1, 5, -1), (2, 2, 1)], "subject long, idx int, pol int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject long, idx int, pol int").parquet(str(tmp_path / "in"))
    q = reveal.running_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {r["subject"]: r["state"] for r in spark.sql("select * from states").collect()} == {1: "DEFEATED", 2: "ENTAILED"}
    finally:
        q.stop()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from defeasor.plans.oracle import ORACLE_SQL
    from defeasor.plans.queries import QUERIES

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    text = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    assert set(ORACLE_SQL) <= set(QUERIES)
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        assert sorted(cols) == sorted(df.columns), name
        theirs = sorted(tuple(text(v) for _, v in sorted(zip(cols, r))) for r in res.fetchall())
        ours = sorted(tuple(text(r[c]) for c in sorted(cols)) for r in df.collect())
        assert ours == theirs, name


def test_every_query_reads_a_table(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from defeasor.plans.queries import QUERIES

    for name, query in QUERIES.items():
        with pytest.raises(AnalysisException):
            query(spark, f"{tmp_path}/none")
            raise AssertionError(name)
