"""The step-down correction and odds ratios against their definitions."""

import math
import random

import pytest

from defeasor.operators import analytics


def slow_holm(ps):
    order, out, top = sorted(range(len(ps)), key=lambda i: ps[i]), [None] * len(ps), 0.0
    for k, i in enumerate(order):
        top = max(top, (len(ps) - k) * ps[i])
        out[i] = min(1.0, top)
    return out


def test_holm(spark):
    rng = random.Random(1)
    rows = [(f, t, rng.choice([rng.random(), rng.random() / 100, 0.01])) for f in "abc" for t in range(rng.randint(1, 12))] + [("d", 0, 0.9), ("a", 99, None)]
    got = {(r["family"], r["test"]): r["p_holm"] for r in analytics.holm(spark.createDataFrame(rows, "family string, test int, p double"), ["family"], ["test"]).collect()}
    for f in "abcd":
        mine = [r for r in rows if r[0] == f and r[2] is not None]
        for r, p in zip(mine, slow_holm([r[2] for r in mine])):
            assert got[f, r[1]] == pytest.approx(p)
    assert got["a", 99] is None


def test_odds_ratio(spark):
    cells = [("m", 40, 10, 20, 30), ("n", 0, 5, 5, 0), ("o", 7, 7, 7, 7)]
    for r in analytics.odds_ratio(spark.createDataFrame(cells, "model string, a int, b int, c int, d int"), ["model"]).collect():
        a, b, c, d = (x + 0.5 for x in next(x for x in cells if x[0] == r["model"])[1:])
        log, se = math.log(a * d / (b * c)), math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        assert (r["odds_ratio"], r["ci_low"], r["ci_high"]) == pytest.approx((math.exp(log), math.exp(log - 1.959964 * se), math.exp(log + 1.959964 * se)), abs=1e-4, rel=1e-5)
        assert r["p"] == pytest.approx(math.erfc(abs(log / se) / math.sqrt(2)), abs=2e-7)
