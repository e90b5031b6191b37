"""Plans and replay of claims against a fold over the events; ranking and layouts against plain Python."""

import random

from pyspark.sql import functions as F

from defeasor.operators import claims, generate, knowledge, populate, ranking, text

SCHEMA = "conversation long, subject long, idx int, pol int, serial int"


def sample(n=120, length=10, seed=3):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        spots = rng.sample(range(1, length - 1), rng.randint(1, 6))
        rows += [(s // 60, s, i, rng.choice([1, -1]), k) for k, i in enumerate(spots, 1)]
    return rows


def chain_state(pos, neg, rules):
    entries = {0, *pos}
    for j, k in rules:
        if k not in neg and any(e <= j and not any(e < x <= j for x in neg) for e in entries):
            entries.add(k)
    if set(pos) & set(neg):
        return "UNDETERMINED"
    return "ENTAILED" if any(not any(x > e for x in neg) for e in entries) else "DEFEATED"


def delta(a, b):
    if a == b:
        return "no_effect"
    if b == "ENTAILED":
        return "strengthening"
    return "weakening" if a == "ENTAILED" or (a, b) == ("UNDETERMINED", "DEFEATED") else "no_effect"


def fold(plan):
    contra, a_first = plan.scenario == "contradiction", plan.ordering == "a_first"
    pos, neg, rules, spoke, out = [], [], [], False, []
    for e in plan.events:
        before, was_pos, was_neg = chain_state(pos, neg, rules), list(pos), list(neg)
        label = None
        if e.kind == "a_claim":
            if contra:
                neg, pos = [x for x in neg if x != e.idx], [*pos, e.idx]
            else:
                rules = [(plan.a_src, plan.a_tgt)]
            label, spoke = "strengthening" if not contra or a_first else None, True
        elif e.kind == "b_claim":
            if contra and spoke:
                label = "no_effect"
            else:
                neg = [*neg, e.idx]
        elif e.pol == 1:
            pos = [*pos, e.idx]
        else:
            neg = [*neg, e.idx]
        after = chain_state(pos, neg, rules)
        if e.kind == "reveal" and e.pol == 1 and before == after == "ENTAILED":
            viable = lambda k: not any(x > k for x in was_neg)
            label = "strengthening" if viable(e.idx) and not any(j > e.idx and viable(j) for j in was_pos) else "no_effect"
        out.append((before, after, label or delta(before, after)))
    return out


def test_plans_and_replay(spark):
    rows = sample()
    made = claims.plan_claims(spark.createDataFrame(rows, SCHEMA), 10, later=1.0)
    plans = {p.subject: p for p in made.collect()}
    own = {}
    for _, s, i, pol, k in rows:
        own.setdefault(s, {})[i] = (pol, k)
    taken = set()
    for s, p in plans.items():
        if p.scenario == "contradiction":
            good = sorted((k, i) for i, (pol, k) in own[s].items() if pol == 1)
            assert (p.skipped is None) == bool(good)
            if good:
                assert p.contested in [i for _, i in good[len(good) // 2 :]]
        elif p.skipped is None:
            assert p.a_src < p.b_src < p.b_tgt < p.a_tgt and p.a_tgt - p.a_src >= 3
            claim = (p.conversation, p.source_a, p.a_src, p.a_tgt)
            assert claim not in taken
            taken.add(claim)
        if p.skipped is None:
            assert 0 <= p.source_a < p.source_b < 3
            kinds = [e.kind for e in p.events if e.kind != "reveal"]
            assert kinds == (["b_claim", "a_claim"] if p.ordering == "b_first" else ["a_claim", "b_claim"])
            shown = [e.idx for e in p.events if e.kind == "reveal"]
            assert len(set(shown)) == len(shown) and all(own[s][e.idx][0] == e.pol for e in p.events if e.kind == "reveal")
    got = {}
    for r in claims.replay_claims(made, 10).orderBy("subject", "event_ord").collect():
        got.setdefault(r.subject, []).append((r.state_before, r.state, r.effect))
    assert got == {s: fold(p) for s, p in plans.items() if p.skipped is None}
    assert {r.outcome for r in claims.plan_report(made).collect()} >= {"planned", "no positive evidence"}


def test_a_source_runs_out_of_bypasses(spark):
    rows = [(0, s, 1, -1, 1) for s in range(300)]
    made = claims.plan_claims(spark.createDataFrame(rows, SCHEMA), 5, sources=2)
    spans = [(p.a_src, p.a_tgt) for p in made.collect() if p.scenario == "bypass" and p.skipped is None]
    assert sorted(spans) == [(0, 3), (0, 4), (1, 4)]
    short = claims.plan_claims(spark.createDataFrame(rows, SCHEMA), 4, sources=2)
    assert {r.outcome for r in claims.plan_report(short).collect()} == {"chain too short", "no positive evidence"}


def test_no_evidence(spark):
    made = claims.plan_claims(spark.createDataFrame([], SCHEMA), 10)
    assert made.count() == 0 and claims.replay_claims(made, 10).count() == 0


def test_numbered_and_running_max(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-(10**6), 10**6), 500)
    df = spark.createDataFrame([(i, rng.randint(0, 10**6)) for i in ids], "id long, v long")
    bucket = ranking.number_bucket(df, "id", 7)
    rows = ranking.running_max(ranking.numbered(df, bucket, ["id"]), bucket, ["id"], F.col("v"), "top").orderBy("id").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501)) and {r.n_rows for r in rows} == {500}
    top = -1
    for r in rows:
        top = max(top, r.v)
        assert r.top == top
    empty = df.where("false")
    assert ranking.numbered(empty, ranking.number_bucket(empty, "id"), ["id"]).count() == 0


def test_saturation_stops(spark):
    prints = ["a", "b", "a", "c", "a", "b", "d", "a"]
    df = spark.createDataFrame([(i * 3, p) for i, p in enumerate(prints)], "graph_id long, fingerprint string")
    rows = generate.saturation(df, 2).orderBy("graph_id").collect()
    assert [r.run for r in rows] == [0, 0, 1, 0, 1, 2, 0, 1]
    assert [r.accepted for r in rows] == [True, True, False, True, False, False, False, False]


def test_concept_chain_backtracks(spark):
    edges = spark.createDataFrame([("a", "top"), ("b", "top"), ("b1", "b"), ("b2", "b"), ("deep", "b2"), ("lone", "other")], "src string, dst string")
    rows = knowledge.concept_chains(edges, spark.createDataFrame([("top",), ("other",), ("none",)], "start string"), 4, ["w0"]).orderBy("start", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault(r.start, []).append(r.label)
    assert found == {"top": ["top", "b", "b2", "deep"], "other": ["other", "lone", "w0", "nonce_entity_1"], "none": ["none", "w0", "nonce_entity_1", "nonce_entity_2"]}


def test_layout_and_compounds(spark):
    nodes = spark.createDataFrame([(0, "0", None, 0), (0, "0.1", "0", 1), (0, "0.2", "0", 1), (0, "0.2.1", "0.2", 2), (0, "0.2.2", "0.2", 2)], "graph_id long, node string, parent string, layer int")
    assert {r.node: (r.x, r.y) for r in populate.tree_layout(nodes, 2).collect()} == {"0.1": (1.0, -1), "0.2.1": (2.0, -2), "0.2.2": (3.0, -2), "0.2": (2.5, -1), "0": (1.75, 0)}
    parts = spark.createDataFrame([("mOON", "ray"), ("moon", "RAY"), (None, "x"), ("", "y")], "a string, b string")
    assert [r.word for r in text.compounds(parts, ["a", "b"]).collect()] == ["Moon Ray"]
