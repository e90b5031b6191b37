"""Columns that are computed once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns behind a Generate of one row.

    A projection would be merged with those above it, which copies an expression to each of its uses; inside a lambda it is
    then evaluated for every element, and such copies multiply from step to step. A Generate is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread(df: DataFrame, row: Column, *names: str) -> DataFrame:
    """df with the fields of a struct, computed once, as columns; nulls of a null struct."""
    return df.select("*", F.inline(F.array(row)).alias(*names))
