"""Claims of two sources about a chain: plans for the subjects of a conversation, and their replay.

A plan has a source A, whose word counts, and a source B. In a contradiction both speak about one node, which one of the
later positives of the subject supports: B denies it and A affirms it. In a bypass A says that a chain node leads straight
to a later one, at least three steps on, and B denies a rule strictly inside of that span. Between the claims, and after
them, a piece of the subject's own evidence may be revealed.

No subject waits for another: that a bypass is claimed once in a conversation is a join of positions (the n-th subject that
a source serves takes the n-th option of that source's shuffled list), and a state during the replay depends only on the
events so far, which are four at most.

Evidence of a subject is collected into an array; it has one edge for each chain node, so the chain's length bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import phrases
from ..functions.hashing import bernoulli, number, order_key
from ..functions.once import once, spread
from .chain import delta_label

CONTRADICTION, BYPASS = "contradiction", "bypass"
ANSWERS = {"ENTAILED": "yes", "DEFEATED": "no"}


def _drawn(items: Column, purpose: str, *of: Column | str, seed: int) -> Column:
    """The element (a struct with idx) whose hash is least; null of none."""
    keyed = F.transform(items, lambda x: F.struct(order_key(purpose, *of, x["idx"], seed=seed).alias("k"), x.alias("x")))
    return F.array_min(keyed)["x"]


def _event(kind: str, idx: Column, pol: Column | int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), (F.lit(pol) if isinstance(pol, int) else pol).cast("int").alias("pol"))


def _reveal(idx: str, pol: str) -> Column:
    return F.when(F.col(idx).isNotNull(), _event("reveal", F.col(idx), F.col(pol)))


def plan_claims(evidence: DataFrame, chain_length: int, sources: int = 3, b_first: float = 0.7, later: float = 0.6, seed: int = 42) -> DataFrame:
    """One row for each subject of evidence (conversation, subject, idx, pol, serial; one row for each subject and idx).

    skipped is null if there is a plan, else the reason: no positive evidence, a chain of fewer than five nodes, or no
    bypass that this source has not claimed in the conversation. sources must be two or more.
    """
    edge = F.struct("serial", "idx", "pol")
    s = evidence.groupBy("conversation", "subject").agg(F.array_sort(F.collect_list(edge)).alias("evidence"))
    s = once(s, scenario=F.when(bernoulli(0.5, "scenario", "subject", seed=seed), CONTRADICTION).otherwise(BYPASS))
    s = s.withColumn("ordering", F.when(bernoulli(b_first, "ordering", "subject", seed=seed), "b_first").otherwise("a_first"))
    s = s.withColumn("source_a", (number("source_a", "subject", seed=seed) % (sources - 1)).cast("int"))
    s = s.withColumn("source_b", (F.col("source_a") + 1 + number("source_b", "subject", seed=seed) % (sources - 1 - F.col("source_a"))).cast("int"))
    s = _with_contested(s, seed)
    s = _with_bypass(s, chain_length, seed)
    contra = F.col("scenario") == CONTRADICTION
    reason = F.when(contra & F.col("contested").isNull(), "no positive evidence")
    if chain_length < 5:
        reason = reason.when(~contra, "chain too short")
    s = s.withColumn("skipped", reason.when(~contra & F.col("a_src").isNull(), "no unclaimed bypass"))
    return _with_events(s, later, seed)


def _with_contested(s: DataFrame, seed: int) -> DataFrame:
    """contested: one of the later half of the positives, by serial."""
    positives = F.filter("evidence", lambda x: x["pol"] == 1)
    n = F.size(positives)
    half = F.slice(positives, F.floor(n / 2).cast("int") + 1, F.greatest(n, F.lit(1)))
    return once(s, contested=F.when(F.col("scenario") == CONTRADICTION, _drawn(half, "contested", "subject", seed=seed)["idx"]))


def _with_bypass(s: DataFrame, chain_length: int, seed: int) -> DataFrame:
    """a_src, a_tgt (each once for a source in a conversation) and b_src, b_tgt strictly inside."""
    none = F.lit(None).cast("int")
    spans = [(i, j) for i in range(chain_length - 3) for j in range(i + 3, chain_length)] if chain_length >= 5 else []
    if not spans:
        return s.withColumns({c: none for c in ("a_src", "a_tgt", "b_src", "b_tgt")})
    turn = F.row_number().over(Window.partitionBy("conversation", "source_a", "scenario").orderBy("subject"))
    key = lambda i, j: order_key("bypass", "conversation", "source_a", F.lit(i), F.lit(j), seed=seed)
    shuffled = F.array_sort(F.array(*[F.struct(key(i, j).alias("k"), F.lit(i).alias("src"), F.lit(j).alias("tgt")) for i, j in spans]))
    s = s.withColumn("__turn", turn)
    s = spread(s, F.when((F.col("scenario") == BYPASS) & (F.col("__turn") <= len(spans)), F.get(shuffled, F.col("__turn") - 1)), "__k", "a_src", "a_tgt")
    a_src, a_tgt = F.col("a_src"), F.col("a_tgt")
    inside = F.flatten(F.transform(F.sequence(a_src + 1, a_tgt - 2), lambda i: F.transform(F.sequence(i + 1, a_tgt - 1), lambda j: F.struct(i.alias("src"), j.alias("tgt")))))
    s = once(s, __inside=inside)
    s = spread(s, F.get("__inside", (number("inside", "subject", seed=seed) % F.size("__inside")).cast("int")), "b_src", "b_tgt")
    return s.drop("__turn", "__k", "__inside")


def _with_events(s: DataFrame, later: float, seed: int) -> DataFrame:
    """events: the first claim, evidence up to the spot that the claims are about, the second claim, later evidence."""
    contra = F.col("scenario") == CONTRADICTION
    own = F.filter("evidence", lambda x: ~F.coalesce(x["idx"] == F.col("contested"), F.lit(False)))
    s = once(s, __own=own)
    upto = F.when(contra, F.col("contested")).otherwise(F.col("b_src"))
    s = spread(s, _drawn(F.filter("__own", lambda x: x["idx"] <= upto), "between", "subject", seed=seed), "__s1", "__idx1", "__pol1")
    rest = F.filter("__own", lambda x: (F.col("__idx1").isNull() | (x["idx"] != F.col("__idx1"))) & (contra | (x["idx"] <= F.col("a_src"))))
    s = spread(s, F.when(~contra | bernoulli(later, "post", "subject", seed=seed), _drawn(rest, "after", "subject", seed=seed)), "__s2", "__idx2", "__pol2")
    a = _event("a_claim", F.when(contra, F.col("contested")).otherwise(F.col("a_tgt")), 1)
    b = _event("b_claim", F.when(contra, F.col("contested")).otherwise(F.col("b_tgt")), -1)
    b_first = F.col("ordering") == "b_first"
    row = F.array(F.when(b_first, b).otherwise(a), _reveal("__idx1", "__pol1"), F.when(b_first, a).otherwise(b), _reveal("__idx2", "__pol2"))
    return s.withColumn("events", F.when(F.col("skipped").isNull(), F.array_compact(row))).drop("__own", "__s1", "__idx1", "__pol1", "__s2", "__idx2", "__pol2", "evidence")


def _state(events: Column, contra: Column, rule_src: Column, rule_tgt: Column) -> Column:
    """The state once these events have come in; also the greatest positive and negative index (-1 if none)."""
    a_spoke = F.exists(events, lambda e: e["kind"] == "a_claim")
    idx = lambda found: F.transform(found, lambda e: e["idx"])
    pos = idx(F.filter(events, lambda e: (e["pol"] == 1) & ((e["kind"] == "reveal") | contra)))
    neg = idx(F.filter(events, lambda e: (e["pol"] == -1) & ((e["kind"] == "reveal") | ~(contra & a_spoke))))
    top = lambda found, least: F.greatest(F.coalesce(F.array_max(found), F.lit(least)), F.lit(least))
    low = lambda found: F.filter(found, lambda x: x <= rule_src)
    fires = ~contra & a_spoke & ~F.array_contains(neg, rule_tgt) & (top(low(pos), 0) >= top(low(neg), -1))
    entry = F.when(fires, F.greatest(top(pos, 0), rule_tgt)).otherwise(top(pos, 0))
    state = F.when(F.arrays_overlap(pos, neg), "UNDETERMINED").when(entry >= top(neg, -1), "ENTAILED").otherwise("DEFEATED")
    return F.struct(state.alias("state"), top(pos, -1).alias("p"), top(neg, -1).alias("q"))


def _sentence(chain: str = "P") -> Column:
    """What is said: of an object in a contradiction and a reveal, of a rule in a bypass."""
    name = F.concat(F.lit("object "), F.col("subject").cast("string"))
    node = lambda c: F.concat(F.lit(chain), c.cast("string"))
    has = F.concat(F.lit("has "), node(F.col("idx")))
    said = F.when(F.col("pol") == 1, F.concat(phrases.capitalized(name), F.lit(" "), has, F.lit("."))).otherwise(phrases.negative_sentence(name, has))
    is_a = F.col("kind") == "a_claim"
    have = F.concat(F.lit("have "), node(F.col("idx")))
    rule = F.concat(F.lit("objects with property "), node(F.when(is_a, F.col("a_src")).otherwise(F.col("b_src"))), F.lit(" generally "), F.when(is_a, have).otherwise(phrases.negated_rule(have)), F.lit("."))
    source = F.concat(F.lit("Expert "), F.char(F.lit(65) + F.when(is_a, F.col("source_a")).otherwise(F.col("source_b"))), F.lit(" reports: "))
    claim = F.concat(source, F.when(F.col("scenario") == BYPASS, rule).otherwise(said))
    return F.when(F.col("kind") == "reveal", said).otherwise(claim)


def replay_claims(plans: DataFrame, chain_length: int) -> DataFrame:
    """One row for each event of a plan: what it says, the states around it, the answer and the effect.

    A's affirmation removes B's denial of the node; once A has spoken, B's denial of it has no effect. A's bypass always
    strengthens, and so does A's affirmation if it comes first. All else follows from the states, with the rule of the
    shorter path for a positive that leaves the chain entailed.
    """
    contra = F.col("scenario") == CONTRADICTION
    rows = plans.where("skipped is null").select("*", F.posexplode("events").alias("__at", "__e"))
    rows = spread(rows, F.col("__e"), "kind", "idx", "pol")
    seen = lambda n: _state(F.slice("events", F.lit(1), n), contra, F.col("a_src"), F.col("a_tgt"))
    rows = spread(rows, seen(F.col("__at")), "was", "p_was", "q_was")
    rows = spread(rows, seen(F.col("__at") + 1), "now", "p_now", "q_now")
    was, now = F.col("was"), F.col("now")
    delta = delta_label(was, now)
    both = (was == "ENTAILED") & (now == "ENTAILED") & (F.col("pol") == 1)
    nearer = F.when(F.col("idx") >= F.greatest("p_was", "q_was"), "STRENGTHENING").otherwise("NO_EFFECT")
    a_first = F.col("ordering") == "a_first"
    effect = (
        F.when(F.col("kind") == "reveal", F.when(both, nearer).otherwise(delta))
        .when((F.col("kind") == "a_claim") & (~contra | a_first), "STRENGTHENING")
        .when((F.col("kind") == "b_claim") & contra & a_first, "NO_EFFECT")
        .otherwise(delta)
    )
    answer = F.when(now == "ENTAILED", ANSWERS["ENTAILED"]).when(now == "DEFEATED", ANSWERS["DEFEATED"]).otherwise("unknown")
    update = F.concat(F.lit("type4_"), F.when(F.col("kind") == "reveal", "edge_reveal").otherwise(F.col("kind")))
    return rows.select("subject", (F.col("__at") + 1).alias("event_ord"), update.alias("update_type"), "idx", (chain_length - 1 - F.col("idx")).alias("hyp_node_distance"), was.alias("state_before"), now.alias("state"), answer.alias("answer"), F.lower(effect).alias("effect"), _sentence().alias("sentence"))


def plan_report(plans: DataFrame) -> DataFrame:
    """Plans by scenario, ordering and reason of skipping."""
    return plans.groupBy("scenario", "ordering", F.coalesce("skipped", F.lit("planned")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
