"""Walks against searches one node at a time, on graphs with cycles, several parents and more steps than any constant."""

import random

import pytest

from defeasor.operators import walks
from defeasor.plans import population


def slow_reached(edges, root):
    seen, level, d = {root: 0}, [root], 0
    while level:
        d += 1
        level = list(dict.fromkeys(b for a, b in edges if a in level and b not in seen))
        seen.update({b: d for b in level})
    return seen


def slow_longest(edges, nodes):
    """By repeated relaxation; nodes that still grow after as many rounds as there are nodes have no longest way."""
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            depth[b] = max(depth[b], depth[a] + 1)
    return {n: d if d < len(nodes) else None for n, d in _stuck(edges, depth, len(nodes)).items()}


def _stuck(edges, depth, n):
    for _ in range(n):
        for a, b in edges:
            depth[b] = max(depth[b], depth[a] + 1)
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_reached_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)]
    roots = [0, 1, 99]
    got = walks.reached_all(spark.createDataFrame(edges + edges[:5] + [(None, 3), (4, None)], "parent int, child int"), spark.createDataFrame([(r,) for r in [*roots, 0, None]], "root int")).collect()
    assert sorted((r["root"], r["node"], r["depth"]) for r in got) == sorted((r, n, d) for r in roots for n, d in slow_reached(edges, r).items())


@pytest.mark.parametrize("seed", range(3))
def test_longest_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)] + ([(20, 21), (21, 20), (24, 24)] if seed else [])
    nodes = set(range(25))
    want = slow_longest(edges, sorted(nodes))
    got = walks.longest_depths(spark.createDataFrame(edges + edges[:3] + [(None, 1)], "parent int, child int"), spark.createDataFrame([(n,) for n in [*nodes, None]], "node int")).collect()
    assert {r["node"]: r["depth"] for r in got} == want and len(got) == 25
    assert {r["node"]: r["n_children"] for r in got} == {n: len({b for a, b in edges if a == n}) for n in nodes}


def test_long_chain_and_empty_tables(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(25)], "parent string, child string").coalesce(1)
    assert max(r["depth"] for r in walks.reached_all(chain, spark.createDataFrame([("0",)], "root string")).collect()) == 25
    none = chain.where("false")
    assert walks.reached_all(none, spark.createDataFrame([("0",)], "root string")).collect() == [("0", "0", 0)]
    assert walks.reached_all(chain, spark.createDataFrame([], "root string")).collect() == []
    assert walks.longest_depths(none).collect() == []


def test_queries_read_tables(spark):
    for name in ("walk_to_the_end", "longest_ways", "appended_runs", "default_tree_generate"):
        with pytest.raises(Exception, match="(?i)path"):
            population.QUERIES[name](spark, "/no/such/folder")
