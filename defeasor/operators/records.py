"""Question records of default graphs: on-chain evidence, irrelevant attributes, quantified and generic exceptions.

All handlers give the columns of RECORD. States come from running maxima over a subject's evidence, as in ``chain``; a state
at any cutoff is one conditional maximum, not a replay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bernoulli
from ..functions.unions import union_of
from .chain import delta_label, mode_a_label, replay, state_of
from .skeptical import EVIDENCE
from .structures import chains

RECORD = ("graph_id", "id", "question_type", "subject", "hypothesis_target", "pi_add_type", "pi_add_node", "pi_add_serial", "baseline_state", "post_update_state", "mode_a_label", "mode_b_label", "difficulty", "scope")

# Beginnings that negate a label.
NEGATIONS = ("not ", "cannot ", "does not ", "is not ", "are not ")


def mode_b(state: Column) -> Column:
    return F.when(state == "ENTAILED", "YES").when(state == "DEFEATED", "NO").otherwise("UNKNOWN")


def record_id(subject: Column, question_type: Column, kind: Column, node: Column, serial: Column) -> Column:
    return F.concat_ws("_", subject, F.concat(F.lit("t"), question_type.cast("string")), kind, node, F.replace(F.format_string("%.3f", serial.cast("double")), F.lit("."), F.lit("_")))


def _records(rows: DataFrame, question_type: int, mode_a: Column, difficulty: Column, scope: Column | None = None) -> DataFrame:
    """From rows with graph_id, subject, target, kind, node, at, baseline and post."""
    kind = F.lit(question_type)
    return rows.select(
        "graph_id", record_id(F.col("subject"), kind, F.col("kind"), F.col("node"), F.col("at")).alias("id"), kind.alias("question_type"), "subject", F.col("target").alias("hypothesis_target"), F.col("kind").alias("pi_add_type"), F.col("node").alias("pi_add_node"), F.col("at").cast("double").alias("pi_add_serial"),
        F.col("baseline").alias("baseline_state"), F.col("post").alias("post_update_state"), mode_a.alias("mode_a_label"), mode_b(F.col("post")).alias("mode_b_label"), difficulty.alias("difficulty"), (F.lit(None).cast("array<string>") if scope is None else scope).alias("scope"),
    )


def chain_evidence(edges: DataFrame) -> DataFrame:
    """Evidence of hypothesis subjects on their chain: graph_id, subject, target, node, idx, pol, serial, length."""
    on = chains(edges).select("graph_id", "subject", "target", F.size("chain").alias("length"), F.posexplode("chain").alias("idx", "node"))
    e = edges.where(F.col("type").isin(*EVIDENCE)).select("graph_id", F.col("src").alias("subject"), F.col("dst").alias("node"), F.when(F.col("type") == EVIDENCE[0], 1).otherwise(-1).alias("pol"), F.coalesce("serial", F.lit(0)).alias("serial"))
    return on.join(e, ["graph_id", "subject", "node"]).select("graph_id", "subject", "target", "node", "idx", "pol", "serial", "length")


def states_at(found: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (graph_id, subject, cut, ...) with state: of the subject's chain with evidence up to cut."""
    e = found.select("graph_id", "subject", F.col("idx").alias("e_idx"), F.col("pol").alias("e_pol"), F.col("serial").alias("e_serial"))
    met = asked.join(e, ["graph_id", "subject"], "left")
    top = lambda sign: F.max(F.when((F.col("e_pol") == sign) & (F.col("e_serial") <= F.col("cut")), F.col("e_idx")))
    g = met.groupBy(*asked.columns).agg(F.greatest(F.coalesce(top(1), F.lit(0)), F.lit(0)).alias("p"), F.coalesce(top(-1), F.lit(-1)).alias("q"))
    return g.withColumn("state", state_of(F.col("p"), F.col("q"))).drop("p", "q")


def evidence_records(edges: DataFrame, seed: int = 42) -> DataFrame:
    """A record for each piece of on-chain evidence: the state before and after it; a denial is framed as an exception half of
    the time and then comes 0.001 later."""
    e = chain_evidence(edges).withColumn("key", F.struct("graph_id", "subject"))
    r = replay(e.withColumnRenamed("subject", "name").withColumnRenamed("key", "subject"))
    r = r.drop("subject").withColumnRenamed("name", "subject")
    framed = F.when(F.col("pol") == 1, "pos").when(bernoulli(0.5, "frame", "graph_id", "subject", "idx", seed=seed), "exception").otherwise("neg")
    r = r.withColumns({"kind": framed, "baseline": F.col("state_before"), "post": F.col("state")})
    r = r.withColumn("at", F.col("serial") + F.when(F.col("kind") == "exception", 0.001).otherwise(0.0))
    return _records(r, 1, mode_a_label(F.col("kind"), F.col("baseline"), F.col("post")), F.to_json(F.struct(F.col("idx").alias("chain_depth"), F.col("length").alias("chain_length"))))


def labels_conflict(said: Column, label: Column) -> Column:
    """Whether one of two lower-cased labels negates the other."""
    rest = lambda s, prefix: F.substring(s, len(prefix) + 1, 1 << 30)
    out = F.lit(False)
    for prefix in NEGATIONS:
        mine, theirs = rest(said, prefix), rest(label, prefix)
        out = out | said.startswith(prefix) & (label.startswith(mine) | mine.startswith(label)) | label.startswith(prefix) & said.startswith(theirs)
    for plain, denied in (("can ", "cannot "), ("is ", "is not ")):
        out = out | label.startswith(plain) & said.startswith(denied) & (rest(label, plain) == rest(said, denied))
    return out


def tagged_irrelevant(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, subject, target, node, node_ord, tag: irrelevant attributes of hypothesis subjects, trap_irr if their label
    conflicts with one of the chain's, else safe_irr."""
    label = F.trim(F.lower(F.coalesce("label", F.lit(""))))
    named = nodes.select("graph_id", "node_id", "node_ord", "type", label.alias("label"))
    on = chains(edges)
    of_chain = on.select("graph_id", "subject", "target", F.explode_outer("chain").alias("node_id")).join(named.select("graph_id", "node_id", "label"), ["graph_id", "node_id"], "left")
    of_chain = of_chain.groupBy("graph_id", "subject", "target").agg(F.collect_set("label").alias("labels"))  # one chain
    mine = edges.where("type = 'has_attribute'").select("graph_id", F.col("src").alias("subject"), F.col("dst").alias("node_id")).join(named.where("type = 'irrelevant_property'"), ["graph_id", "node_id"])
    met = mine.join(of_chain, ["graph_id", "subject"])
    trap = F.exists("labels", lambda c: labels_conflict(F.col("label"), c))
    return met.select("graph_id", "subject", "target", F.col("node_id").alias("node"), "node_ord", F.when(trap, "trap_irr").otherwise("safe_irr").alias("tag"))


def irrelevant_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A record for each irrelevant attribute, at 0.0, 0.1, ... of its subject: a safe one changes nothing, a trap is
    expected to be answered as defeat."""
    t = tagged_irrelevant(nodes, edges).withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "subject", "target").orderBy("node_ord", "node")))
    t = t.withColumn("at", F.round((F.col("r") - 1) * 0.1, 1)).withColumn("cut", F.when(F.col("tag") == "safe_irr", 1 << 30).otherwise(0)).withColumnRenamed("tag", "kind").drop("node_ord", "r")
    s = states_at(chain_evidence(edges), t).withColumnRenamed("state", "baseline").withColumn("post", F.when(F.col("kind") == "safe_irr", F.col("baseline")).otherwise("DEFEATED"))
    return _records(s, 2, mode_a_label(F.col("kind"), F.col("baseline"), F.col("post")), F.to_json(F.struct((F.col("kind") == "trap_irr").alias("is_trap"))))


def instantiation_records(edges: DataFrame) -> DataFrame:
    """For each chain node below the root with two or more subjects' evidence of both signs: a record for every subject, half
    a step before the first of them. Subjects in its scope become undetermined, the others keep the state of that moment."""
    found = chain_evidence(edges)
    g = found.where("idx > 0").groupBy("graph_id", "target", "node").agg(F.array_sort(F.collect_set("subject")).alias("scope"), F.count(F.lit(1)).alias("n"), F.count_distinct("pol").alias("kinds"), F.min("serial").alias("first"))
    g = g.where("n >= 2 and kinds = 2").select("graph_id", "target", "node", "scope", "first")
    asked = g.join(chains(edges).where("size(chain) > 0").select("graph_id", "subject", "target"), ["graph_id", "target"])
    before = states_at(found, asked.withColumn("cut", F.greatest(F.lit(0), F.col("first") - 2))).withColumnRenamed("state", "baseline").drop("cut")
    after = states_at(found, before.withColumn("cut", F.col("first") - 1))
    rows = after.withColumns({"kind": F.lit("quantified_inst"), "at": F.col("first") - 0.5, "post": F.when(F.array_contains("scope", F.col("subject")), "UNDETERMINED").otherwise(F.col("state"))})
    return _records(rows, 3, delta_label(F.col("baseline"), F.col("post")), F.to_json(F.struct(F.size("scope").alias("scope_size"))), F.col("scope"))


def generic_records(edges: DataFrame) -> DataFrame:
    """For each chain node below the root that some subject is denied: a record for every subject, after all evidence, that
    leaves it undetermined."""
    found = chain_evidence(edges)
    last = edges.where(F.col("type").isin(*EVIDENCE)).groupBy("graph_id").agg(F.max(F.coalesce("serial", F.lit(0))).alias("last"))
    g = found.where("pol = -1 and idx > 0").select("graph_id", "target", "node", "idx").distinct().join(last, "graph_id")
    asked = g.join(chains(edges).where("size(chain) > 0").select("graph_id", "subject", "target"), ["graph_id", "target"]).withColumn("cut", F.col("last"))
    rows = states_at(found, asked).withColumnRenamed("state", "baseline").withColumns({"kind": F.lit("quantified_gen"), "at": F.col("last") + 1 + F.col("idx"), "post": F.lit("UNDETERMINED")})
    return _records(rows, 3, delta_label(F.col("baseline"), F.col("post")), F.to_json(F.struct(F.lit("generic").alias("scope"))))


def quantified_records(edges: DataFrame) -> DataFrame:
    return union_of(instantiation_records(edges), generic_records(edges))


def all_records(nodes: DataFrame, edges: DataFrame, *, quantified: bool = False, per_subject: int | None = None, claims: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The records of all handlers, at most per_subject for a subject (smallest serial first). claims: a planner of
    source claims that adds records of its own."""
    parts = [evidence_records(edges), irrelevant_records(nodes, edges)]
    parts += [quantified_records(edges)] if quantified else []
    parts += [claims(nodes, edges).select(*RECORD)] if claims else []
    out = union_of(*parts)
    if per_subject is None:
        return out
    w = Window.partitionBy("graph_id", "subject").orderBy("pi_add_serial", "id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_subject).drop("r")


def report(records: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, records by type and warnings: on-chain evidence whose chain is defeated before it."""
    n = lambda t: F.count_if(F.col("question_type") == t).alias(f"type{t}")
    warned = F.when((F.col("question_type") == 1) & (F.col("baseline_state") == "DEFEATED"), F.col("id"))
    found = records.groupBy("graph_id").agg(n(1), n(2), n(3), F.count(warned).alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return edges.select("graph_id").distinct().join(found, "graph_id", "left").select("graph_id", *[zero(c) for c in ("type1", "type2", "type3", "warnings")])


def in_force(episodes: DataFrame, moments: DataFrame) -> DataFrame:
    """moments (subject, serial) with denied (nodes whose denial by the less reliable source is in force) and rules (bypasses
    of the more reliable one). episodes: subject, scenario, node, b_serial, a_serial, bypass_source, bypass_target. A denial
    holds from b_serial on, in a contradiction until a_serial; a bypass holds from a_serial on."""
    met = moments.join(episodes, "subject", "left")
    holds = (F.col("b_serial") <= F.col("serial")) & ((F.col("scenario") == "bypass") | (F.col("serial") < F.col("a_serial")))
    rule = (F.col("scenario") == "bypass") & (F.col("a_serial") <= F.col("serial")) & F.col("bypass_source").isNotNull() & F.col("bypass_target").isNotNull()
    g = met.groupBy("subject", "serial").agg(F.collect_set(F.when(holds, F.col("node"))).alias("d"), F.collect_set(F.when(rule, F.struct("bypass_source", "bypass_target"))).alias("rules"))  # a subject's few episodes
    return g.select("subject", "serial", F.array_sort("d").alias("denied"), F.array_sort("rules").alias("rules"))


def effect(edge_type: Column, *, before: Column, now: Column, on_chain: Column, irrelevant: Column, grouped: Column) -> Column:
    """strengthen, weaken or no effect of an update on a class hypothesis. grouped: the subject is another member of the
    update's exception group; then the update says the opposite of the subject. Else a changed answer decides, else the sign
    of an update on the chain."""
    has, lacks = edge_type == EVIDENCE[0], edge_type == EVIDENCE[1]
    opposite = F.when(~on_chain, "no effect").when(lacks, "strengthen").when(has, "weaken")
    turned = F.when((before != "yes") & (now == "yes"), "strengthen").when((before == "yes") & (now != "yes"), "weaken")
    by_sign = F.when(irrelevant | ~on_chain, "no effect").when(has, "strengthen").when(lacks, "weaken").otherwise("no effect")
    return F.coalesce(F.when(grouped, opposite), turned, by_sign)


def group_schedule(edges: DataFrame) -> DataFrame:
    """(graph_id, at, kind, source, target, pol, members, known_from): the reveals of class graphs in their order.

    Evidence of one target that two or more classes share with both signs is an exception group. It is announced once (kind
    group), half a step before its first member. Of a group of two, the second member is known as soon as the first one is
    told, before its own reveal (known_from); larger groups tell nothing of the others.
    """
    ev = edges.where(F.col("type").isin(*EVIDENCE)).select("graph_id", F.col("src").alias("source"), F.col("dst").alias("target"), (F.col("type") == EVIDENCE[0]).cast("int").alias("pol"), F.coalesce("serial", F.lit(0)).alias("serial"))
    g = ev.groupBy("graph_id", "target").agg(F.array_sort(F.collect_list("source")).alias("members"), F.count_distinct("pol").alias("kinds"), F.min("serial").alias("first")).where("size(members) >= 2 and kinds = 2").drop("kinds")  # a target's classes
    of = ev.join(g.hint("merge"), ["graph_id", "target"], "left")
    inferred = F.when(F.size("members") == 2, F.col("first")).otherwise(F.col("serial"))
    each = of.select("graph_id", F.col("serial").cast("double").alias("at"), F.lit("edge").alias("kind"), "source", "target", "pol", "members", inferred.cast("double").alias("known_from"))
    announced = g.select("graph_id", (F.col("first") - 0.5).cast("double").alias("at"), F.lit("group").alias("kind"), F.lit(None).cast("string").alias("source"), "target", F.lit(None).cast("int").alias("pol"), "members", F.lit(None).cast("double").alias("known_from"))
    return union_of(each, announced)


def grouped_replay(edges: DataFrame, layers: DataFrame, asked: DataFrame) -> DataFrame:
    """(graph_id, subject, at, kind, source, answer, effect) of class chains for each asked (graph_id, subject).

    layers: (graph_id, node, layer). The answer is the sign of the deepest evidence known at that moment, told or inferred, on the
    subject or above it (yes without any); an announcement changes nothing. The effect is that of ``effect``: for another member
    of the update's group the opposite of what the update says. What is known from when is one more row on the same axis as
    the reveals, so one running maximum answers all; a graph's reveals meet its subjects once. Generated graphs have several times
    the size that Spark takes them for, so no side of a join is broadcast.
    """
    events = group_schedule(edges)
    depth = layers.select("graph_id", F.col("node").alias("source"), F.col("layer").alias("depth"))
    e = events.join(depth.hint("merge"), ["graph_id", "source"], "left")
    s = asked.join(layers.select("graph_id", F.col("node").alias("subject"), F.col("layer").alias("own")).hint("merge"), ["graph_id", "subject"])
    met = e.join(s.hint("merge"), "graph_id").withColumn("code", F.when(F.col("depth") <= F.col("own"), F.col("depth") * 2 + F.col("pol")))
    none = lambda kind: F.lit(None).cast(kind)
    known = F.struct(F.col("known_from").alias("at"), F.lit(0).alias("order"), none("string").alias("kind"), none("string").alias("source"), none("int").alias("pol"), none("array<string>").alias("members"), F.col("code"))
    shown = F.struct("at", F.lit(1).alias("order"), "kind", "source", "pol", "members", none("int").alias("code"))
    line = met.select("graph_id", "subject", F.explode(F.when(F.col("kind") == "edge", F.array(known, shown)).otherwise(F.array(shown))).alias("x")).select("graph_id", "subject", "x.*")
    w = Window.partitionBy("graph_id", "subject")
    best = F.max("code").over(w.orderBy("at", "order", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("now", F.when(best.isNull() | (best % 2 == 1), "yes").otherwise("no")).where("kind is not null")
    line = line.withColumn("before", F.coalesce(F.lag("now").over(w.orderBy("at", "source")), F.lit("yes")))
    kind = F.when(F.col("pol") == 1, EVIDENCE[0]).when(F.col("pol") == 0, EVIDENCE[1])
    other = F.coalesce(F.array_contains("members", F.col("subject")) & (F.col("subject") != F.col("source")), F.lit(False))
    what = effect(kind, before=F.col("before"), now=F.col("now"), on_chain=F.lit(True), irrelevant=F.lit(False), grouped=other)
    return line.select("graph_id", "subject", "at", "kind", "source", F.col("now").alias("answer"), F.when(F.col("kind") == "group", "no effect").otherwise(what).alias("effect"))
