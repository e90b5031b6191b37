"""Whole conversations against a replay turn by turn."""

import hashlib

import pytest
from pyspark.sql import functions as F

from defeasor.operators import dialogues, records, structures


def key(purpose, *parts):
    return hashlib.md5("|".join(["42", purpose, *map(str, parts)]).encode()).hexdigest()


def unit(purpose, *parts):
    return int(key(purpose, *parts)[:7], 16) / (1 << 28)


def slow_conversation(g, subjects, recs, found, cap):
    """[(subject, kind, node, ground truth, effect, turns so far)] of one graph."""
    n = len(subjects)
    k = min(n - 1, max(1, round(n * 0.5))) if n > 1 else 0
    late = sorted(subjects, key=lambda s: (key("late", g, s), s))[:k]
    says = {"ENTAILED": "yes", "DEFEATED": "no", "UNDETERMINED": "unknown"}
    out, turns, over = [], 0, False
    ok = lambda: cap is None or turns < cap - 10 * k
    for s in [s for s in subjects if s not in late]:
        mine = [r for r in recs if r["subject"] == s]
        if over or not mine or not ok():
            over = over or bool(mine)
            continue
        kinds = {t: sorted((r for r in mine if r["question_type"] == t), key=lambda r: (r["pi_add_serial"], r["id"])) for t in (1, 2, 3)}
        both = sorted(kinds[1] + kinds[2], key=lambda r: (key("mix", g, r["id"]), r["id"]))
        its = {1: iter(kinds[1]), 2: iter(kinds[2])}
        line = [next(its[r["question_type"]]) for r in both] + kinds[3]
        out.append((s, None, None, "yes", None, turns))
        turns += 2
        state = "ENTAILED"
        for r in line:
            if not ok():
                over = True
                break
            if r["question_type"] == 1:
                state = r["post_update_state"]
            post = state if r["question_type"] == 2 else r["post_update_state"]
            effect = "no_effect" if r["question_type"] == 2 else r["mode_a_label"].lower()
            out.append((s, r["question_type"], r["pi_add_node"], says[post], effect, turns))
            turns += 4
    for s in [s for s in subjects if s in late]:
        ev = sorted((e for e in found if e["subject"] == s), key=lambda e: e["serial"])
        pos = [e for e in ev if e["pol"] == 1]
        anchors = sorted(pos[len(pos) // 2 :], key=lambda e: key("anchor", g, s, e["node"]))
        eps = []
        for t in range(0, 8, 2):
            if len(eps) == 2 or len(eps) == len(anchors):
                break
            a, first = anchors[len(eps)], unit("source", g, s, t) < 0.7
            b = a["serial"] + (-0.5 if first else 0.5)
            if b not in [e[1] for e in eps]:
                eps.append((a, b, first))
        if not eps:
            continue
        out.append((s, None, None, "yes", None, turns))
        turns += 2
        claims = sorted([(b, i, 0) for i, (a, b, _) in enumerate(eps)] + [(a["serial"], i, 1) for i, (a, b, _) in enumerate(eps)], key=lambda c: (c[0], c[1], c[2]))
        told, skipped, states = set(), set(), ["ENTAILED"]
        for at, i, is_a in claims:
            a, b, first = eps[i]
            denied = [x["idx"] for x, y, _ in eps if y <= at < x["serial"]]
            p = [e["idx"] for e in ev if e["pol"] == 1 and e["serial"] <= int(at)]
            q = [e["idx"] for e in ev if e["pol"] == -1 and e["serial"] <= int(at)] + denied
            after = "UNDETERMINED" if set(p) & set(denied) else "ENTAILED" if max([0, *p]) >= max([-1, *q]) else "DEFEATED"
            before = states[-1]
            states.append(after)
            if i in skipped:
                continue
            if i not in told:
                if cap is not None and turns + 8 > cap:
                    skipped.add(i)
                    continue
                told.add(i)
            effect = "strengthening" if is_a else "weakening" if first else "no_effect"
            out.append((s, 4, a["node"], says[after], effect, turns))
            turns += 4
    return out


@pytest.mark.parametrize("cap,difficulty", [(60, "hard"), (14, "easy")])
def test_whole_conversations(spark, cap, difficulty):
    nodes, edges = structures.default_graphs(spark, 25, difficulty)
    got = dialogues.whole_conversations(nodes, edges, cap=cap).collect()
    recs, found = records.all_records(nodes, edges, quantified=True).collect(), records.chain_evidence(edges).collect()
    hyp = {r["graph_id"]: r["subjects"] for r in structures.hypotheses(edges).collect()}
    kinds = set()
    for g in range(25):
        mine = sorted((r for r in got if r["graph_id"] == g), key=lambda r: r["turn_ord"])
        assert [r["turn_ord"] for r in mine] == list(range(len(mine))) and [r["role"] for r in mine] == ["user", "assistant"] * (len(mine) // 2)
        answers = [(r["subject"], r["question_type"], r["node"], r["ground_truth"], r["effect"], r["turn_ord"] - 1) for r in mine if r["task_type"] in ("initial_answer", "update_answer")]
        assert answers == slow_conversation(g, hyp[g], [r for r in recs if r["graph_id"] == g], [r for r in found if r["graph_id"] == g], cap)
        assert [r["serial"] for r in mine if r["task_type"] == "update_answer"] == list(range(1, sum(r["task_type"] == "update_answer" for r in mine) + 1))
        assert all(r["content"] for r in mine if r["role"] == "user")
        kinds |= {r["question_type"] for r in mine}
    assert cap == 14 or kinds == {None, 1, 2, 3, 4}
    if cap == 14:
        assert dialogues.whole_conversations(nodes.where("false"), edges.where("false"), cap=None).collect() == []


def test_episodes_are_rejected_and_drawn_again(spark):
    """Two anchors one step apart: a denial half a step after the first falls on one half a step before the second."""
    rows = [(g, "s", "t", f"n{i}", i, 1, i, 9) for g in range(200) for i in (1, 2, 3, 4)]
    found = spark.createDataFrame(rows, "graph_id long, subject string, target string, node string, idx int, pol int, serial int, length int")
    eps = dialogues.plan_episodes(found).collect()
    by = {}
    for e in eps:
        by.setdefault(e["graph_id"], []).append(e)
    assert all(len(x) <= 2 and len({e["b_serial"] for e in x}) == len(x) for x in by.values())
    assert {e["node"] for e in eps} == {"n3", "n4"} and {len(x) for x in by.values()} >= {2}
