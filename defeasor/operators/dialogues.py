"""Whole conversations of default graphs: evidence, irrelevant updates and quantified ones, then episodes of two sources.

A graph has one conversation. Its first part speaks of one subject after the other: evidence in order with irrelevant
updates at random places among it, then quantified updates. It ends when the turns so far reach the cap less a reserve for
what follows. The second part takes the subjects kept back for it: in an episode source B denies a property that source A
confirms, in either order. An episode that no longer fits is skipped, whole, when its first claim comes up; later ones that
fit are still told, so which are told is a fold over a conversation's claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import phrases
from ..functions.hashing import bernoulli, order_key
from ..functions.stored import written
from ..functions.unions import union_of
from . import records
from .chain import mode_a_label, state_of
from .converse import EFFECT_QUESTION
from .structures import hypotheses

# Tries to find episodes, episodes of a subject, turns of an opening, an update and an episode, the reserve
# for a subject of the second part.
TRIES, EPISODES, OPENING, UPDATE, EPISODE, RESERVE = 8, 2, 2, 4, 8, 10
SOURCES = ("Source 1", "Source 2")


def ordered_subjects(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """(graph_id, subject, s_ord, late): subjects in the order of first sight; of two or more a share, rounded half to even and one
    at least but not all, is kept back for the second part, by hash."""
    h = hypotheses(edges).groupBy("graph_id").agg(F.min_by("subjects", "first").alias("subjects"))
    s = h.select("graph_id", F.size("subjects").alias("n"), F.posexplode("subjects").alias("s_ord", "subject"))
    late = F.when(F.col("n") > 1, F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share)).cast("int")))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(order_key("late", "graph_id", "subject", seed=seed), "subject"))
    return s.withColumn("place", place).select("graph_id", "subject", "s_ord", (F.col("place") <= late).alias("late"))


def plan_episodes(found: DataFrame, b_first: float = 0.7, seed: int = 42) -> DataFrame:
    """(graph_id, subject, ep, node, idx, b_first, b_serial, a_serial) of subjects' chain evidence (records.chain_evidence).

    Anchors are the positives of the later half by serial, in hash order. Every other one of TRIES draws an order of the two
    sources for the next anchor: B's denial comes half a step before A's confirmation or half a step after it. A draw whose
    denial falls on that of an earlier episode is rejected, and the next one draws again; EPISODES at most are kept.
    """
    pos = found.where("pol = 1").groupBy("graph_id", "subject").agg(F.array_sort(F.collect_list(F.struct("serial", "node", "idx"))).alias("p"))  # a chain's evidence
    keyed = F.transform(F.slice("p", F.floor(F.size("p") / 2).cast("int") + 1, F.size("p")), lambda x: F.struct(order_key("anchor", "graph_id", "subject", x["node"], seed=seed).alias("k"), x["serial"].alias("serial"), x["node"].alias("node"), x["idx"].alias("idx")))
    drawn = F.array(*[bernoulli(b_first, "source", "graph_id", "subject", F.lit(t), seed=seed) for t in range(0, TRIES, 2)])
    rows = pos.select("graph_id", "subject", F.array_sort(keyed).alias("anchors"), drawn.alias("drawn"))
    kind = "array<struct<node:string,idx:int,b_first:boolean,b_serial:double,a_serial:double>>"

    def step(kept: Column, first: Column) -> Column:
        x = F.get("anchors", F.size(kept))
        b = x["serial"] + F.when(first, -0.5).otherwise(0.5)
        fits = (F.size(kept) < EPISODES) & x.isNotNull() & ~F.exists(kept, lambda e: e["b_serial"] == b)
        new = F.struct(x["node"].alias("node"), x["idx"].cast("int").alias("idx"), first.alias("b_first"), b.cast("double").alias("b_serial"), x["serial"].cast("double").alias("a_serial"))
        return F.when(fits, F.array_append(kept, new)).otherwise(kept).cast(kind)

    kept = rows.select("graph_id", "subject", F.aggregate("drawn", F.array().cast(kind), step).alias("kept"))
    return kept.select("graph_id", "subject", F.posexplode("kept").alias("ep", "e")).select("graph_id", "subject", "ep", "e.*")


def episode_claims(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """Two claims for each episode with the states around them: (graph_id, subject, ep, node, source, serial, n, before, after,
    effect). A denial holds from its moment until the confirmation: a half-open interval, empty if A came first."""
    claim = lambda source, serial: F.struct(F.lit(source).alias("source"), F.col(serial).alias("serial"))
    said = episodes.select("graph_id", "subject", "ep", "node", F.col("idx").alias("at"), "b_first", "b_serial", "a_serial", F.explode(F.array(claim("B", "b_serial"), claim("A", "a_serial"))).alias("c")).select("*", "c.source", "c.serial").drop("c")
    holds = said.select("graph_id", "subject", "ep", "source", "serial").join(episodes.select("graph_id", "subject", F.col("idx").alias("denied"), F.col("b_serial").alias("from"), F.col("a_serial").alias("until")), ["graph_id", "subject"]).where("from <= serial and serial < until")
    denied = holds.groupBy("graph_id", "subject", "ep", "source").agg(F.collect_set("denied").alias("denied"))
    said = said.join(denied, ["graph_id", "subject", "ep", "source"], "left").withColumn("denied", F.coalesce("denied", F.array().cast("array<int>")))
    e = found.select("graph_id", "subject", F.col("idx").alias("e_idx"), "pol", F.col("serial").alias("e_serial"))
    known = said.join(e, ["graph_id", "subject"], "left").withColumn("in", F.col("e_serial") <= F.floor("serial"))
    top = lambda sign: F.max(F.when(F.col("in") & (F.col("pol") == sign), F.col("e_idx")))
    g = known.groupBy(*said.columns).agg(F.greatest(F.coalesce(top(1), F.lit(0)), F.lit(0)).alias("p"), top(-1).alias("q"), F.bool_or(F.col("in") & (F.col("pol") == 1) & F.array_contains("denied", F.col("e_idx"))).alias("both"))
    q = F.greatest(F.coalesce("q", F.lit(-1)), F.coalesce(F.array_max("denied"), F.lit(-1)))
    g = g.withColumn("after", F.when(F.coalesce("both", F.lit(False)), "UNDETERMINED").otherwise(state_of(F.col("p"), q)))
    w = Window.partitionBy("graph_id", "subject").orderBy("serial", "ep", F.desc("source"))
    g = g.withColumns({"n": F.row_number().over(w), "before": F.coalesce(F.lag("after").over(w), F.lit("ENTAILED"))})
    told = mode_a_label(F.when(F.col("source") == "B", "neg").otherwise("pos"), F.col("before"), F.col("after"))
    effect = F.when((F.col("source") == "B") & ~F.col("b_first"), "NO_EFFECT").otherwise(told)
    return g.select("graph_id", "subject", "ep", "node", "source", "serial", "n", "before", "after", effect.alias("effect"))


def _first_part(recs: DataFrame, subjects: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """Openings and updates in order, those within the budget: (graph_id, s_ord, subject, section, pos, size, *record)."""
    r = recs.join(subjects.where("not late").select("graph_id", "subject", "s_ord"), ["graph_id", "subject"])
    mixed = r.where("question_type < 3")
    own = Window.partitionBy("graph_id", "subject", "question_type")
    order = mixed.withColumn("nth", F.row_number().over(own.orderBy("pi_add_serial", "id")))
    # places are dealt by hash; those of a kind go to its rows in their order
    places = order.select("graph_id", "subject", "question_type", F.row_number().over(Window.partitionBy("graph_id", "subject").orderBy(order_key("mix", "graph_id", "id", seed=seed), "id")).alias("pos"))
    places = places.withColumn("nth", F.row_number().over(own.orderBy("pos")))
    mixed = order.join(places, ["graph_id", "subject", "question_type", "nth"]).drop("nth").withColumn("section", F.lit(1))
    last = r.where("question_type = 3").withColumns({"pos": F.row_number().over(Window.partitionBy("graph_id", "subject").orderBy("pi_add_serial", "id")), "section": F.lit(2)})
    updates = mixed.unionByName(last).withColumn("size", F.lit(UPDATE))
    openings = updates.select("graph_id", "subject", "s_ord").distinct().withColumns({"section": F.lit(0), "pos": F.lit(0), "size": F.lit(OPENING)})
    items = updates.unionByName(openings, allowMissingColumns=True)
    reserve = subjects.where("late").groupBy("graph_id").agg((F.count(F.lit(1)) * RESERVE).alias("reserve"))
    before = Window.partitionBy("graph_id").orderBy("s_ord", "section", "pos").rowsBetween(Window.unboundedPreceding, -1)
    items = items.join(reserve, "graph_id", "left").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    items = items if cap is None else items.where(F.col("start") < F.lit(cap) - F.coalesce("reserve", F.lit(0)))
    state = F.last(F.when(F.col("question_type") == 1, F.col("post_update_state")), ignorenulls=True).over(Window.partitionBy("graph_id", "subject").orderBy("section", "pos").rowsBetween(Window.unboundedPreceding, -1))
    post = F.when(F.col("question_type") == 2, F.coalesce(state, F.lit("ENTAILED"))).otherwise(F.col("post_update_state"))
    effect = F.when(F.col("question_type") == 2, "NO_EFFECT").otherwise(F.col("mode_a_label"))
    return items.select("graph_id", "start", "size", "subject", "section", F.col("question_type").alias("kind"), F.col("pi_add_node").alias("node"), F.col("pi_add_type").alias("said"), "scope", post.alias("post"), effect.alias("effect"))


def _second_part(claims: DataFrame, subjects: DataFrame, first: DataFrame, cap: int | None) -> DataFrame:
    """Openings and the claims of episodes that fit, after the first part."""
    c = claims.join(subjects.where("late").select("graph_id", "subject", "s_ord"), ["graph_id", "subject"])
    openings = c.select("graph_id", "subject", "s_ord").distinct().withColumns({"n": F.lit(0), "ep": F.lit(-1)})
    items = c.unionByName(openings, allowMissingColumns=True)
    used = first.groupBy("graph_id").agg(F.max(F.col("start") + F.col("size")).alias("used"))
    lined = items.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("s_ord", "n", "ep"))).alias("line"))  # a few claims
    lined = lined.join(used, "graph_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("int"))
    kind = "struct<n:int,told:array<struct<s:int,ep:int>>,out:array<struct<s_ord:int,n:int,start:int>>>"
    start = F.struct(F.col("used").alias("n"), F.array().alias("told"), F.array().alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        mine = F.struct(x["s_ord"].cast("int").alias("s"), x["ep"].cast("int").alias("ep"))
        running = F.array_contains(acc["told"], mine)
        fits = F.lit(True) if cap is None else acc["n"] + EPISODE <= cap
        tell = (x["ep"] < 0) | running | fits
        row = F.struct(x["s_ord"].cast("int").alias("s_ord"), x["n"].cast("int").alias("n"), acc["n"].alias("start"))
        more = F.struct((acc["n"] + F.when(x["ep"] < 0, OPENING).otherwise(UPDATE)).cast("int").alias("n"), F.array_append(acc["told"], mine).alias("told"), F.array_append(acc["out"], row).alias("out"))
        # an episode that did not fit at its first claim does not come back at its second one
        skipped = F.struct(acc["n"].alias("n"), F.array_append(acc["told"], F.struct(mine["s"].alias("s"), (-2 - mine["ep"]).cast("int").alias("ep"))).alias("told"), acc["out"].alias("out"))
        gone = F.array_contains(acc["told"], F.struct(mine["s"].alias("s"), (-2 - mine["ep"]).cast("int").alias("ep")))
        return F.when(tell & ~gone, more.cast(kind)).otherwise(skipped.cast(kind))

    told = lined.select("graph_id", F.explode(F.aggregate("line", start, step)["out"]).alias("o")).select("graph_id", "o.*")
    rows = items.join(told, ["graph_id", "s_ord", "n"])
    said = F.when(F.col("source") == "A", "confirms").when(F.col("source") == "B", "denies")
    return rows.select("graph_id", "start", F.when(F.col("n") == 0, OPENING).otherwise(UPDATE).alias("size"), "subject", F.when(F.col("n") == 0, 0).otherwise(1).alias("section"), F.when(F.col("n") > 0, 4).alias("kind"), "node", said.alias("said"), F.lit(None).cast("array<string>").alias("scope"), F.col("after").alias("post"), "effect")


def whole_conversations(nodes: DataFrame, edges: DataFrame, *, cap: int | None = 120, late_share: float = 0.5, seed: int = 42) -> DataFrame:
    """(graph_id, turn_ord, role, content, subject, question_type, node, serial, task_type, ground_truth, effect): the turns of
    one conversation for each graph. serial counts its updates. cap None: no cap."""
    nodes, edges = written(nodes), written(edges)  # many parts read them
    subjects = written(ordered_subjects(edges, late_share, seed))
    recs = written(records.all_records(nodes, edges, quantified=True))
    found = written(records.chain_evidence(edges))
    first = _first_part(recs, subjects, cap, seed)
    late = found.join(subjects.where("late").select("graph_id", "subject"), ["graph_id", "subject"], "left_semi")
    first = written(first)
    second = _second_part(episode_claims(plan_episodes(late, seed=seed), late), subjects, first, cap)
    items = union_of(first, second).withColumn("serial", F.sum((F.col("kind").isNotNull()).cast("int")).over(Window.partitionBy("graph_id").orderBy("start")))
    label = nodes.select("graph_id", F.col("node_id").alias("node"), "label")
    items = items.join(label, ["graph_id", "node"], "left")
    target = hypotheses(edges).groupBy("graph_id").agg(F.min_by("target", "first").alias("node")).join(label, ["graph_id", "node"]).select("graph_id", F.col("label").alias("claim"))
    items = items.join(target, "graph_id")
    return _turns(items)


def _turns(items: DataFrame) -> DataFrame:
    subject, label = F.col("subject"), F.col("label")
    plain, denied = F.concat(subject, F.lit(" "), label, F.lit(".")), phrases.negative_sentence(subject, label)
    told = F.when(F.col("kind") == 4, F.concat(F.when(F.col("said") == "confirms", f"{SOURCES[0]} reports: ").otherwise(f"{SOURCES[1]} reports: "), F.when(F.col("said") == "confirms", plain).otherwise(denied)))
    told = told.when(F.col("said") == "quantified_inst", phrases.at_least_one_of(phrases.listed(F.col("scope")), label)).when(F.col("said") == "quantified_gen", phrases.at_least_one_object(label, label))
    told = told.when(F.col("said").isin("neg", "exception"), denied).otherwise(plain)
    says, effect = F.lower(records.mode_b(F.col("post"))), F.lower("effect")
    none = F.lit(None).cast("string")
    turn = lambda role, content, task, truth, effect: F.struct(F.lit(role).alias("role"), content.alias("content"), task.alias("task_type"), truth.alias("ground_truth"), effect.alias("effect"))
    ask = F.concat(F.lit(" Question: Given all the information so far about "), subject, F.lit(", does "), F.when(F.col("section") == 0, "the information").otherwise("it"), F.lit(" support the latest hypothesis?"))
    head = F.when(F.col("start") == 0, "Hypothesis: ").otherwise("We now turn to a different object. New hypothesis: ")
    opening = F.array(turn("user", F.concat(head, subject, F.lit(" "), F.col("claim"), F.lit("."), ask), F.when(F.col("start") > 0, "hypothesis_change"), none, none), turn("assistant", F.lit(""), F.lit("initial_answer"), F.lit("yes"), none))
    update = F.array(turn("user", F.concat(F.lit("Information update: "), told, ask), none, none, none), turn("assistant", F.lit(""), F.lit("update_answer"), says, effect), turn("user", F.lit(f"Question: {EFFECT_QUESTION}"), none, none, none), turn("assistant", F.lit(""), F.lit("effect_of_update"), effect, none))
    rows = items.select("graph_id", "start", "subject", F.col("kind").alias("question_type"), "node", F.when(F.col("kind").isNotNull(), F.col("serial")).alias("serial"), F.posexplode(F.when(F.col("section") == 0, opening).otherwise(update)).alias("at", "t"))
    return rows.select("graph_id", (F.col("start") + F.col("at")).cast("int").alias("turn_ord"), "t.role", "t.content", "subject", "question_type", "node", "serial", "t.task_type", "t.ground_truth", "t.effect")
