"""Deterministic randomness: md5 of a seed and a purpose, equal in Spark and in other SQL engines. Never rand()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(purpose: str, *cols: Column | str, seed: int = 42) -> Column:
    """A hex string to sort by."""
    parts = [F.lit(f"{seed}|{purpose}")]
    for c in cols:
        parts += [F.lit("|"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def number(purpose: str, *cols: Column | str, seed: int = 42) -> Column:
    """A whole number below 2**28."""
    return F.conv(F.substring(order_key(purpose, *cols, seed=seed), 1, 7), 16, 10).cast("bigint")


def unit(purpose: str, *cols: Column | str, seed: int = 42) -> Column:
    """In [0, 1)."""
    return number(purpose, *cols, seed=seed) / F.lit(float(1 << 28))


def bernoulli(p: float, purpose: str, *cols: Column | str, seed: int = 42) -> Column:
    return unit(purpose, *cols, seed=seed) < F.lit(p)


def pick(values: list, purpose: str, *cols: Column | str, seed: int = 42) -> Column:
    """One of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number(purpose, *cols, seed=seed) % len(values) + 1).cast("int"))


def short_id(*cols: Column | str, length: int = 8) -> Column:
    return F.substring(order_key("id", *cols), 1, length)
