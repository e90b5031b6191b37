"""The general skeptical resolver as joins, level by level, over graphs of any size.

Same semantics as ``skeptical.resolve``. All queries of all graphs advance together: what lies between x and y is found by
widening frontiers, then every node whose sources are decided is decided in one aggregation, until none is left. Conflicts
are settled by the accepted superclasses of their sources, walked from the conflicts of that level only.

No task holds a graph: rows are dealt by query and node, sums over the edges into a node are partial before they are
shuffled, and every step is written to the shared folder, so the number of steps (the longest way) costs time and no memory.

Each step moves all edges of all queries, which costs most where many small graphs are asked. So a graph of at most
``small`` edges, counted first, is one row with its nodes in topological order; it meets each of its queries once, and the
levels are a fold in that row. Larger graphs and those with a cycle go level by level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import written
from ..functions.unions import sound_unions, union_of
from .skeptical import EVIDENCE, NEGATIVE, POSITIVE, UNKNOWN

def signed_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, sign, serial) from (graph_id, edge_ord, src, dst, type, serial): the last edge of a pair wins; types
    without a sign have none. serial: that of evidence only."""
    last = edges.groupBy("graph_id", "src", "dst").agg(F.max_by(F.struct("type", "serial"), "edge_ord").alias("e"))
    sign = F.when(F.col("e.type").isin(*POSITIVE, "+"), "+").when(F.col("e.type").isin(*NEGATIVE, "-"), "-")
    late = F.when(F.col("e.type").isin(*EVIDENCE), F.coalesce("e.serial", F.lit(0)))
    return last.select("graph_id", "src", "dst", sign.alias("sign"), late.alias("serial")).where("sign is not null")


def fixed_point(start: DataFrame, step, keys: list[str]) -> DataFrame:
    """All rows (keys) that repeated steps reach from start, each once. step: frontier to the next one's candidates."""
    frontier = written(start.select(*keys).distinct())
    seen = frontier
    while not frontier.isEmpty():
        frontier = written(step(frontier).select(*keys).distinct().join(seen, keys, "left_anti"))
        seen = seen.union(frontier)
    return written(seen)


def _between(edges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, node) on positive ways from x or into y through them, and the edges (q, src, dst, sign) into these nodes from them.
    edges: graph_id, src, dst, sign; asked: q, graph_id, subject, target."""
    up = edges.where("sign = '+'").select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    onward = lambda f: f.join(up, ["graph_id", "node"]).select("q", "graph_id", F.col("next").alias("node"))
    from_x = fixed_point(asked.select("q", "graph_id", F.col("subject").alias("node")), onward, ["q", "graph_id", "node"])
    # an edge counts for a query if its source is reached from x
    usable = written(edges.join(from_x.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("q", "src", "dst", "sign"))
    back = usable.select("q", F.col("dst").alias("node"), F.col("src").alias("prev"))
    targets = asked.select("q", F.col("target").alias("node"))
    told = targets.join(back.select("q", "node").distinct(), ["q", "node"], "left_semi")  # else nothing is said of y
    part = fixed_point(told, lambda f: f.join(back, ["q", "node"]).select("q", F.col("prev").alias("node")), ["q", "node"])
    inside = usable.join(part.withColumnRenamed("node", "dst"), ["q", "dst"], "left_semi")
    return part, written(inside.select("q", "src", "dst", "sign"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is found once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_graphs(edges: DataFrame) -> DataFrame:
    """(graph_id, nodes, into): the nodes in topological order and, for each of them, the edges into it as the source's place
    from 1, plus and serial; nodes is null if the graph has a cycle. A graph is one row. edges: graph_id, src, dst, sign, serial."""
    g = edges.where("src is not null and dst is not null").groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", (F.col("sign") == "+").alias("plus"), F.col("serial").cast("long").alias("serial"))).alias("e"))  # counted before
    g = g.withColumn("n", F.array_distinct(F.concat(F.transform("e", lambda e: e["src"]), F.transform("e", lambda e: e["dst"]))))
    place = lambda e, end: F.array_position("n", e[end]).cast("int")
    g = g.select("graph_id", "n", F.transform("e", lambda e: F.struct(place(e, "src").alias("s"), place(e, "dst").alias("d"), e["plus"].alias("plus"), e["serial"].alias("serial"))).alias("e"))
    every = F.sequence(F.lit(1), F.size("n"))

    def peeled(done: Column, _: Column) -> Column:
        waiting = F.transform(F.filter("e", lambda e: ~F.array_contains(done, e["s"])), lambda e: e["d"])
        return F.when(F.size(done) == F.size("n"), done).otherwise(F.concat(done, F.array_except(every, F.array_union(waiting, done))))

    g = g.withColumn("o", F.aggregate(every, F.array().cast("array<int>"), peeled))
    into = lambda i: F.transform(F.filter("e", lambda e: e["d"] == i), lambda e: F.struct(F.array_position("o", e["s"]).cast("int").alias("s"), e["plus"].alias("plus"), e["serial"].alias("serial")))
    whole = F.size("o") == F.size("n")
    return g.select("graph_id", F.when(whole, F.transform("o", lambda i: F.element_at("n", i))).alias("nodes"), F.when(whole, F.transform("o", into)).alias("into"))


def folded_verdict(x: Column, y: Column, into: Column, cutoff: Column | None) -> Column:
    """1, 0 or null for the node at place y, seen from the one at place x, in a fold over the nodes in topological order.

    Kept of each node: r (on a positive way from x), v (its verdict) and b (the accepted nodes below it, by accepted ways).
    Edges count if their source is r. A source is preempted if another source is below it.
    """
    kind = "array<struct<r:boolean,v:int,b:array<int>>>"
    no_one = F.array().cast("array<int>")

    def decide(seen: Column, ins: Column) -> Column:
        mine = F.size(seen) + 1 == x
        held = lambda e: F.lit(True) if cutoff is None else e["serial"].isNull() | cutoff.isNull() | (e["serial"] <= cutoff)
        counts = F.filter(ins, lambda e: held(e) & F.element_at(seen, e["s"])["r"])
        told = F.transform(counts, lambda e: F.struct(e["s"].alias("s"), e["plus"].alias("plus"), F.element_at(seen, e["s"])["v"].alias("v"), F.element_at(seen, e["s"])["b"].alias("b")))

        def verdict(told: Column, yes: Column) -> Column:
            some = lambda of, plus: F.exists(of, lambda e: e["plus"] == F.lit(plus))
            left = F.filter(yes, lambda e: ~F.arrays_overlap(e["b"], F.transform(yes, lambda f: f["s"])))
            settled = let(left, lambda l: F.when(some(l, True) != some(l, False), some(l, True).cast("int")))
            direct = F.when(F.exists(told, lambda e: (e["s"] == x) & ~e["plus"]), 0).when(F.exists(told, lambda e: e["s"] == x), 1)
            denied = F.exists(told, lambda e: e["plus"] & F.coalesce(e["v"] == 0, F.lit(False)))
            by_sides = F.when(some(yes, True) & some(yes, False), settled).when(some(yes, True), 1).when(some(yes, False), 0).when(denied, 0)
            return F.when(mine, 1).otherwise(let(direct, lambda d: F.when(d.isNotNull(), d).otherwise(by_sides)))

        def row(told: Column, yes: Column, v: Column) -> Column:
            below = F.array_distinct(F.flatten(F.transform(F.filter(yes, lambda e: e["plus"]), lambda e: F.concat(F.array(e["s"]), e["b"]))))
            return F.struct((mine | F.exists(told, lambda e: e["plus"])).alias("r"), v.alias("v"), F.when(v == 1, below).otherwise(no_one).alias("b"))

        accepted = lambda told: F.filter(told, lambda e: F.coalesce(e["v"] == 1, F.lit(False)))
        return let(told, lambda t: let(accepted(t), lambda yes: let(verdict(t, yes), lambda v: row(t, yes, v))))

    end = F.aggregate(into, F.array().cast(kind), lambda seen, ins: F.concat(seen, F.array(decide(seen, ins)).cast(kind)))
    return F.when((x > 0) & (y > 0) & (x != y), F.element_at(end, F.greatest(y, F.lit(1)))["v"])


def answer_of(verdict: Column) -> Column:
    return F.when(verdict == 1, "True").when(verdict == 0, "False").otherwise(UNKNOWN).alias("answer")


def resolve_all(edges: DataFrame, queries: DataFrame, small: int = 128) -> DataFrame:
    """(graph_id, subject, target, answer), plus cutoff if the queries have one. edges: graph_id, src, dst, sign (and serial,
    of evidence: it holds for cutoffs from there on); queries: graph_id, subject, target (and cutoff, null for none).

    Edges with sources outside of the part between x and y say nothing. A cycle in the part is an error. Graphs of at most
    `small` edges are folded in a row.
    """
    sound_unions(edges.sparkSession)
    named = [c for c in ("graph_id", "subject", "target", "cutoff") if c in queries.columns]
    edges, asked = written(edges.where("graph_id is not null")), written(queries.select(*named).distinct())
    timed = edges if "serial" in edges.columns else edges.withColumn("serial", F.lit(None).cast("int"))
    # the sizes of graphs and of queries say little of what their rows take in memory: no side is broadcast
    large = written(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("graph_id"))
    some = not large.isEmpty()
    graphs = written(ordered_graphs(timed.join(large.hint("merge"), "graph_id", "left_anti") if some else timed))
    cyclic = graphs.where("nodes is null").select("graph_id")
    hard = union_of(large, cyclic) if some else cyclic
    some = some or not cyclic.isEmpty()
    easy = asked.join(hard.hint("merge"), "graph_id", "left_anti") if some else asked
    met = easy.join(graphs.hint("merge"), "graph_id", "left")
    place = lambda of: F.coalesce(F.array_position("nodes", of), F.lit(0)).cast("int")
    met = met.select(*named, place(F.col("subject")).alias("x"), place(F.col("target")).alias("y"), "into")
    verdict = folded_verdict(F.col("x"), F.col("y"), F.col("into"), F.col("cutoff") if "cutoff" in named else None)
    found = met.select(*named, answer_of(verdict))
    if not some:
        return found
    in_hard = lambda t: t.join(hard.hint("merge"), "graph_id", "left_semi")
    return union_of(found, _by_levels(in_hard(edges), in_hard(asked), named))


def _by_levels(edges: DataFrame, asked: DataFrame, named: list[str]) -> DataFrame:
    """The answers (named, answer) by joins."""
    asked = written(asked.withColumn("q", F.sha2(F.to_json(F.struct(*named)), 256)))
    edges = written(edges)
    keys = asked.select("q", "graph_id", "subject", "target")
    if "cutoff" in named:  # each cutoff sees a graph of its own
        cut = asked.select("graph_id", "cutoff").distinct().withColumn("own", F.sha2(F.to_json(F.struct("graph_id", F.coalesce(F.col("cutoff").cast("string"), F.lit("")).alias("c"))), 256))
        own = asked.join(cut, (asked.graph_id == cut.graph_id) & asked.cutoff.eqNullSafe(cut.cutoff)).select("q", F.col("own").alias("graph_id"), "subject", "target")
        held = F.col("serial").isNull() | F.col("cutoff").isNull() | (F.col("serial") <= F.col("cutoff"))
        edges = written(edges.join(cut, "graph_id").where(held).select(F.col("own").alias("graph_id"), "src", "dst", "sign"))
        keys = written(own)
    part, inside = _between(edges.select("graph_id", "src", "dst", "sign"), keys)
    first = keys.select("q", F.col("subject").alias("x"))

    # open: nodes with the number of sources that wait; done: nodes with their verdict (1, 0, null)
    waits = inside.groupBy("q", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    still = written(part.join(waits, ["q", "node"], "left").select("q", "node", F.coalesce("waits", F.lit(0)).alias("waits")))
    done = None
    accepted_up = None
    while not (ready := written(still.where("waits = 0").select("q", "node"))).isEmpty():
        into = ready.join(first, "q").select("q", "node", "x")
        if done is None:
            sums = into.select("q", "node", "x", *[F.lit(0).alias(c) for c in ("plus", "minus", "denied")], F.lit(None).cast("string").alias("direct"))
        else:
            said = inside.select("q", "src", F.col("dst").alias("node"), "sign").join(done.select("q", F.col("node").alias("src"), "verdict"), ["q", "src"])
            met = into.join(said, ["q", "node"], "left")
            sums = met.groupBy("q", "node", "x").agg(F.count_if((F.col("sign") == "+") & (F.col("verdict") == 1)).alias("plus"), F.count_if((F.col("sign") == "-") & (F.col("verdict") == 1)).alias("minus"), F.count_if((F.col("sign") == "+") & (F.col("verdict") == 0)).alias("denied"), F.max(F.when(F.col("src") == F.col("x"), F.col("sign"))).alias("direct"))
        verdict = F.when(F.col("node") == F.col("x"), 1).when(F.col("direct").isNotNull(), F.when(F.col("direct") == "+", 1).otherwise(0)).when((F.col("plus") > 0) & (F.col("minus") > 0), -1).when(F.col("plus") > 0, 1).when(F.col("minus") > 0, 0).when(F.col("denied") > 0, 0)
        decided = written(sums.select("q", "node", verdict.alias("verdict")))
        conflicts = decided.where("verdict = -1").select("q", "node")
        if done is not None and not conflicts.isEmpty():
            settled = _preempted(conflicts, inside, done, accepted_up)
            decided = written(union_of(decided.where("verdict is null or verdict >= 0"), settled))
        done = decided if done is None else done.union(decided)
        yes = done.where("verdict = 1").select("q", "node")
        pairs = inside.where("sign = '+'").select("q", "src", "dst")
        accepted_up = pairs.join(yes.withColumnRenamed("node", "src"), ["q", "src"], "left_semi").join(yes.withColumnRenamed("node", "dst"), ["q", "dst"], "left_semi")
        fewer = inside.join(ready.withColumnRenamed("node", "src"), ["q", "src"]).groupBy("q", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("less"))
        still = written(still.where("waits > 0").join(fewer, ["q", "node"], "left").select("q", "node", (F.col("waits") - F.coalesce("less", F.lit(0))).alias("waits")))
    if not still.isEmpty():
        raise ValueError("a graph has a cycle")
    if done is None:
        found = asked.select(*named, F.lit(None).cast("int").alias("verdict"))
    else:
        found = asked.join(done, (asked.q == done.q) & (asked.target == done.node), "left").select(*[asked[c] for c in named], "verdict")
    return found.select(*named, answer_of(F.col("verdict")))


def _preempted(conflicts: DataFrame, inside: DataFrame, done: DataFrame, accepted_up: DataFrame) -> DataFrame:
    """(q, node, verdict) of conflicts: sources that are accepted superclasses of other sources do not count."""
    yes = done.where("verdict = 1").select("q", F.col("node").alias("src"))
    sources = written(inside.withColumnRenamed("dst", "node").join(conflicts, ["q", "node"], "left_semi").join(yes, ["q", "src"], "left_semi").select("q", "node", "src", "sign"))
    step = accepted_up.select("q", F.col("src").alias("at"), F.col("dst").alias("next"))
    onward = lambda f: f.join(step, ["q", "at"]).select("q", "node", F.col("next").alias("at"))
    start = onward(sources.select("q", "node", F.col("src").alias("at")))
    above = fixed_point(start, onward, ["q", "node", "at"])
    left = sources.join(above.select("q", "node", F.col("at").alias("src")), ["q", "node", "src"], "left_anti")
    sides = left.groupBy("q", "node").agg(F.bool_or(F.col("sign") == "+").alias("plus"), F.bool_or(F.col("sign") == "-").alias("minus"))
    verdict = F.when(F.col("plus") != F.col("minus"), F.col("plus").cast("int"))
    return conflicts.join(sides, ["q", "node"], "left").select("q", "node", verdict.alias("verdict"))
