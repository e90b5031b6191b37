"""Special functions against closed forms, finite sums, tabled values and numerical integration."""

import math
import random

import pytest
from pyspark.sql import functions as F

from defeasor.functions import special
from defeasor.operators import analytics

#: Quantiles at 0.975 of F for small degrees of freedom, as tables print them.
TABLED = {(1, 1): 647.789, (2, 1): 799.5, (1, 2): 38.5063, (3, 4): 9.9792, (4, 3): 15.1010, (5, 10): 4.2361, (10, 5): 6.6192, (1, 10): 6.9367, (10, 10): 3.7168, (4, 20): 3.5147}


def integral(f, d1, d2, n=20000):
    """P(F <= f) by Simpson's rule over the angle."""
    end = math.atan(math.sqrt(d1 * f / d2))
    g = lambda t: math.sin(t) ** (d1 - 1) * math.cos(t) ** (d2 - 1) if t > 0 else float(d1 == 1)
    total = sum((1 if i in (0, n) else 4 if i % 2 else 2) * g(end * i / n) for i in range(n + 1)) * end / (3 * n)
    return 2 * total * math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2))


def test_log_gamma(spark):
    rng = random.Random(3)
    xs = [0.01, 0.5, 1.0, 2.0, 10.0, 1e4, 1e7] + [rng.uniform(0.01, 300) for _ in range(50)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_gamma(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11)


def test_quantiles(spark):
    pairs = [(float(a), float(b)) for a in (1, 2, 3, 4, 5, 9, 10, 30) for b in (1, 2, 3, 4, 5, 10, 20, 400)] + [(4.0, 7.3), (11.7, 4.0), (2.0, 0.4), (4.0, 90000.0)]
    d = spark.createDataFrame(pairs + [(None, 2.0)], "a double, b double")
    q = special.f_quantile(0.975, F.col("a"), F.col("b"))
    got = {(r["a"], r["b"]): r["q"] for r in d.select("a", "b", q.alias("q")).collect()}
    assert got.pop((None, 2.0)) is None
    for (a, b), f in got.items():
        if a == b == 1:
            assert f == pytest.approx(math.tan(math.pi * 0.975 / 2) ** 2, rel=1e-9)
        if a == 2:
            assert f == pytest.approx(b / 2 * math.expm1(-2 / b * math.log1p(-0.975)), rel=1e-8)
        if b == 2:
            assert f == pytest.approx(2 / a * 0.975 ** (2 / a) / -math.expm1(2 / a * math.log(0.975)), rel=1e-8)
        if (a, b) in TABLED:
            assert f == pytest.approx(TABLED[a, b], abs=6e-4 if f > 100 else 6e-5)
        if b > 1 and f < 1000 and b < 1000:
            assert integral(f, a, b) == pytest.approx(0.975, abs=1e-8)


def test_incomplete_beta_is_a_binomial_sum(spark):
    cells = [(x, a, b) for x in (0.01, 0.3, 0.5, 0.9, 0.999) for a in (1, 3, 12) for b in (1, 4, 25)] + [(0.0, 2, 2), (1.0, 2, 2)]
    x, a, b = (F.col(c).cast("double") for c in "xab")
    for r in spark.createDataFrame(cells, "x double, a int, b int").select("x", "a", "b", special.incomplete_beta(x, 1 - x, a, b).alias("i")).collect():
        n = r["a"] + r["b"] - 1
        assert r["i"] == pytest.approx(sum(math.comb(n, k) * r["x"] ** k * (1 - r["x"]) ** (n - k) for k in range(r["a"], n + 1)), abs=1e-12)


def test_tails(spark):
    zs = [0.0, 0.1, 1.0, 1.959963984540054, 2.999, 3.0, 4.5, 8.0, 20.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.normal_tails(F.col("z")).alias("p"), analytics.chi_squared_tail(F.col("z") * F.col("z"), 3).alias("c")).collect():
        z = r["z"]
        assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-10)
        assert r["c"] == pytest.approx(math.erfc(z / math.sqrt(2)) + z * math.sqrt(2 / math.pi) * math.exp(-z * z / 2), rel=1e-10)
