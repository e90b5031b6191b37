"""Special functions as column expressions: log-gamma, the incomplete beta function, the normal tail, quantiles of F.

Continued fractions are evaluated from their last term back, so a fold carries one number. All take and give doubles; null in,
null out. Tests hold them to tabled values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, 1 / z, 1 / z^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 10 and the recurrence back, to 1e-13."""
    z = x + 10
    series = sum((c / F.pow(z, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.5 * math.log(2 * math.pi)))
    return (z - 0.5) * F.log(z) - z + series - sum((F.log(x + i) for i in range(1, 10)), F.log(x))


def _fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """1 + d1 / (1 + d2 / (1 + ...)), the continued fraction of the incomplete beta function."""
    def term(m: Column) -> Column:
        k = F.floor(m / 2).cast("double")
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return F.when(m % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, m: 1 + term(m) / t)


def incomplete_beta(x: Column, y: Column, a: Column, b: Column) -> Column:
    """I_x(a, b), the regularised incomplete beta function, with y = 1 - x given apart, as it may be too small for 1 - x.

    The fraction is used on the side where it converges fast; its terms grow with the square root of the parameters."""
    terms = (80 + 12 * F.sqrt(F.greatest(a, b))).cast("int")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
    here = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(here, front / (a * _fraction(x, a, b, terms))).otherwise(1 - front / (b * _fraction(y, b, a, terms)))


def f_below(f: Column, d1: Column, d2: Column) -> Column:
    """P(F <= f) for d1 and d2 degrees of freedom, whole or not."""
    whole = d1 * f + d2
    return incomplete_beta(d1 * f / whole, d2 / whole, d1 / 2, d2 / 2)


def f_quantile(p: float, d1: Column, d2: Column) -> Column:
    """The f with P(F <= f) = p, by bisection of its logarithm between -300 and 300."""
    def halved(at: Column, _: Column) -> Column:
        middle = (at["lo"] + at["hi"]) / 2
        low = f_below(F.exp(middle), at["d1"], at["d2"]) < p
        return F.struct(F.when(low, middle).otherwise(at["lo"]).alias("lo"), F.when(low, at["hi"]).otherwise(middle).alias("hi"), at["d1"].alias("d1"), at["d2"].alias("d2"))

    start = F.struct(F.lit(-300.0).alias("lo"), F.lit(300.0).alias("hi"), d1.cast("double").alias("d1"), d2.cast("double").alias("d2"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(70)), start, halved, lambda at: F.when(at["d1"].isNotNull() & at["d2"].isNotNull(), F.exp((at["lo"] + at["hi"]) / 2)))


def normal_tails(z: Column) -> Column:
    """P(|N| > z) for z >= 0: a series of positive terms up to 3 and a continued fraction beyond."""
    half = z * z / 2
    series = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, n: 1 + z * z / (2 * n + 1) * t)
    beyond = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), z, lambda t, n: z + n / t)
    scale = math.sqrt(2 / math.pi)
    return F.when(z < 3, 1 - scale * z * F.exp(-half) * series).otherwise(scale * F.exp(-half) / beyond)
