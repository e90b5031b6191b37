"""Naming graphs, the default property tree, Markov words and tagged blocks."""

from pyspark.sql import functions as F

from defeasor.operators import populate, text


def test_grown_trees(spark):
    rows = populate.grown_trees(spark, 60, chain=7, most=3, p=0.9).collect()
    for g in range(60):
        nodes = {r["node"]: r for r in rows if r["graph_id"] == g}
        assert sorted(nodes) == list(range(7))
        kids = {}
        for n, r in nodes.items():
            if n == 0:
                assert (r["parent"], r["layer"]) == (-1, 1)
            else:
                assert r["parent"] < n and r["layer"] == nodes[r["parent"]]["layer"] + 1
                kids.setdefault(r["parent"], []).append(n)
        assert all(len(k) <= 3 for k in kids.values())
    assert any(r["parent"] != r["node"] - 1 for r in rows)
    chains = populate.grown_trees(spark, 5, chain=5, p=0.0)
    assert {(r["node"], r["parent"], r["layer"]) for r in chains.collect()} == {(i, i - 1, i + 1) for i in range(5)}
    assert {r["target"] for r in populate.tree_target(chains).collect()} == {4}
    ev = populate.object_evidence(chains, 3, sparsity=1.0).collect()
    assert sorted(r["serial"] for r in ev if r["graph_id"] == 0) == list(range(1, 10))  # three inner nodes, three objects
    assert {r["node"] for r in ev} == {1, 2, 3}


def test_labels(spark):
    nodes = spark.createDataFrame([(0, "0", 0), (0, "0.1", 1), (0, "0.2", 1)], "graph_id int, node string, layer int")
    names = spark.createDataFrame([(0, "animal"), (1, None)], "pos int, name string")
    got = {r["node"]: r["label"] for r in populate.labelled_by_position(populate.breadth_first(nodes), names, "concept").collect()}
    assert got == {"0": "animal", "0.1": "concept_1", "0.2": "concept_2"}
    wanted = spark.createDataFrame([(1, "a", 3), (2, "z", 2)], "key int, grp string, n int")
    pool = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "grp string, name string")
    got = {(r["key"], r["i"]): r["label"] for r in populate.padded_sample(wanted, pool).collect()}
    assert {got[1, 0], got[1, 1]} == {"x", "y"} and got[1, 2] == f"{got[1, 0]} #2"
    assert (got[2, 0], got[2, 1]) == ("entity_0", "entity_1")


def test_markov_words(spark):
    model = text.markov_transitions(spark.createDataFrame([("abc",)], "word string"))
    assert {r["word"] for r in populate.markov_words(model, 5).collect()} == {"Abc"}
    assert populate.markov_words(model.where("false"), 5).isEmpty()


def test_blocks(spark):
    reply = "BLOCK_1_V1:\none\nmore\nBLOCK_1_V2: two\nBLOCK_2_V1: three"
    got = spark.range(1).select(*[populate.blocks_reply(F.lit(reply), F.lit(i), v).alias(f"x{i}{v}") for i in (1, 2) for v in (1, 2)]).first()
    assert list(got) == ["one\nmore", "two", "three", None]
    assert spark.range(1).select(populate.blocks_prompt(F.array(F.lit("a"), F.lit("b")))).first()[0] == "BLOCK_1:\na\n\nBLOCK_2:\nb"
