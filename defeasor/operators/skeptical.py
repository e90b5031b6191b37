"""The general skeptical resolver for any acyclic signed graph, one small graph for each group of rows.

Semantics, in order, for each node of the part between x and y: an edge from x itself decides; else supports and attacks
from accepted nodes decide if only one kind is there; if both are, sources that are accepted superclasses of another
source are preempted and what is left decides; a node that nothing supports is rejected if a rejected node supports it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Signs of edge types; hypothesis and attribute edges have none.
POSITIVE = ("inheritance", "is_a", "implies", "has_property", "defeasible_has_property")
NEGATIVE = ("defeasible_lacks_property",)
EVIDENCE = ("defeasible_has_property", "defeasible_lacks_property")
UNKNOWN = "Skeptical/Unknown"


def closure(start, step) -> set:
    """Everything that repeated steps reach from start."""
    seen, todo = set(start), list(start)
    while todo:
        for n in step(todo.pop()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def resolve(signed: dict[tuple, str], x, y) -> str:
    """signed: (source, target) to '+' or '-'."""
    up: dict = {}
    down: dict = {}
    for (u, v), s in signed.items():
        up.setdefault(u, {})[v] = s
        down.setdefault(v, {})[u] = s
    from_x = closure([x], lambda n: [v for v, s in up.get(n, {}).items() if s == "+"])
    if not any(p in from_x for p in down.get(y, {})):
        return UNKNOWN
    part = closure([y], lambda n: [p for p in down.get(n, {}) if p in from_x])
    waits = {n: sum(p in part for p in down.get(n, {})) for n in part}
    ready, verdict, n_done = [n for n, k in waits.items() if not k], {}, 0

    def decide(n):
        if n == x:
            return True
        if n in up.get(x, {}):
            return up[x][n] == "+"
        sides = {s: {p for p, t in down.get(n, {}).items() if p in part and t == s and verdict.get(p) is True} for s in "+-"}
        if sides["+"] and sides["-"]:
            accepted = lambda m: [v for v, s in up.get(m, {}).items() if s == "+" and verdict.get(v) is True]
            above = closure([], accepted).union(*(closure(accepted(m), accepted) for m in sides["+"] | sides["-"]))
            sides = {s: found - above for s, found in sides.items()}
            return None if bool(sides["+"]) == bool(sides["-"]) else bool(sides["+"])
        if sides["+"] or sides["-"]:
            return bool(sides["+"])
        return False if any(p in part and t == "+" and verdict.get(p) is False for p, t in down.get(n, {}).items()) else None

    while ready:
        n = ready.pop()
        verdict[n] = decide(n)
        n_done += 1
        for v in up.get(n, {}):
            if v in part:
                waits[v] -= 1
                if not waits[v]:
                    ready.append(v)
    if n_done < len(part):
        raise ValueError("the graph has a cycle")
    return {True: "True", False: "False", None: UNKNOWN}[verdict.get(y)]


def signs(edges, cutoff: int | None = None) -> dict[tuple, str]:
    """(src, dst, type, serial) rows to signed edges; the last edge of a pair wins; the cutoff holds for evidence only."""
    last = {(u, v): (t, serial) for u, v, t, serial in edges}
    out = {}
    for pair, (t, serial) in last.items():
        if cutoff is not None and t in EVIDENCE and (serial or 0) > cutoff:
            continue
        if t in POSITIVE or t == "+":
            out[pair] = "+"
        elif t in NEGATIVE or t == "-":
            out[pair] = "-"
    return out


def resolve_graphs(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """edges: graph_id, edge_ord, src, dst, type, serial; queries: graph_id, subject, target, cutoff. One answer a query.

    Both sides are grouped by graph, so each task holds one graph, which is small by nature.
    """

    def run(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values("edge_ord")[["src", "dst", "type", "serial"]]
        rows = [(u, v, t, None if pd.isna(s) else int(s)) for u, v, t, s in rows.itertuples(index=False)]
        out = q[["graph_id", "subject", "target"]].copy()
        out["answer"] = [resolve(signs(rows, None if pd.isna(c) else int(c)), x, y) for x, y, c in zip(q["subject"], q["target"], q["cutoff"])]
        return out

    return edges.groupBy("graph_id").cogroup(queries.groupBy("graph_id")).applyInPandas(run, "graph_id string, subject string, target string, answer string")
