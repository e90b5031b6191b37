"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..N-1 in an order that depends on its content only. A keyed permutation of 0..N-1 turns
it into a position p; the shard is p mod n_shards and the slot p div n_shards. So shards differ by one row at most, slots
have no gaps, any row's place can be computed from its number, and the whole shuffle is reproduced from the seed.

The permutation is a balanced Feistel network over [0, 2^(2k)), 2^(2k) >= N; a value outside [0, N) is encrypted again
until it falls inside (cycle walking), which keeps it a permutation of exactly N numbers.

Edge cases: null ids and null texts are ordinary values; equal rows get numbers side by side; an empty table gives an
empty result. Output names that the input already has (size, text_crc32, law, shard, slot, grown_shard) are replaced; all
other names are free.

Scale: row numbers need no global sort. Rows are counted by a 128-bit hash of their content, which is all that is numbered:
hashes go to buckets of some ``per_bucket`` of them (2**17 buckets at most), the driver sums up the buckets' rows, and a
window numbers the hashes of a bucket. Rows that are equal in all columns are
one hash with a count: repeats are dropped before rows are sent on, the rows that are left meet their numbers in one join, and
copies are made by many tasks, so a row that a third of the table repeats meets in none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .util import copied, one_each, packed, row_keys, stash

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) as round function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(numbers: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """The permutation of 0..n-1 for these numbers."""
    half = max(1, math.ceil(max(1, (max(n, 2) - 1).bit_length()) / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1) for r in range(rounds)]
    x = np.asarray(numbers, np.uint64).copy()
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            v = x[todo]
            left, right = v >> shift, v & mask
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
            x[todo] = (left << shift) | right
            todo = x >= np.uint64(max(n, 1))
    return x.astype(np.int64)


def numbers_of(rows: DataFrame, per_bucket: int = 1 << 16) -> tuple[DataFrame, int]:
    """From rows with __k1 and __k2: for each pair its number of rows __n and the first of their global numbers __start, and
    the number of all rows."""
    groups = stash(rows.groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("__n")), "groups")
    buckets = max(64, min(1 << 17, -(-groups.count() // per_bucket)))
    groups = groups.withColumn("__bucket", F.pmod("__k1", F.lit(buckets)).cast("int"))
    counts = dict(groups.groupBy("__bucket").agg(F.sum("__n")).collect())  # at most `buckets` rows
    starts, n = [], 0
    for b in sorted(counts):
        starts.append((b, n))
        n += counts[b]
    offsets = rows.sparkSession.createDataFrame(starts, "__bucket int, __offset long")
    within = F.sum("__n").over(Window.partitionBy("__bucket").orderBy("__k1", "__k2")) - F.col("__n")
    numbered = groups.withColumn("__at", within).join(F.broadcast(offsets), "__bucket")
    return numbered.select("__k1", "__k2", "__n", (F.col("__offset") + F.col("__at")).alias("__start")), n


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes plus 16, null: 16) and text_crc32 (null: as the empty text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.drop(*ADDED).withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary"))})


def shard_rows(docs: DataFrame, *, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, carry: list[str] | None = None) -> DataFrame:
    """docs (or only id and the columns in carry) with size, text_crc32, law, shard, slot and grown_shard (null)."""
    kept = sized(docs, text_col)
    kept = kept if carry is None else kept.select(id_col, *[c for c in carry if c != id_col], "size", "text_crc32")
    first, second = row_keys(kept)
    rows = packed(kept, __k1=first, __k2=second)
    numbers, n = numbers_of(rows.select("__k1", "__k2"))
    numbers = stash(numbers, "numbers")

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), n, seed))

    def placed(found: DataFrame) -> DataFrame:
        p = found.withColumn("__p", place("__at"))
        return p.select(*[F.col("__row").getField(c).alias(c) for c in kept.columns], F.lit("rows").alias("law"), F.pmod("__p", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__p") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

    one = one_each(rows)
    out = placed(one.join(numbers.where("__n = 1"), ["__k1", "__k2"]).withColumn("__at", F.col("__start")))
    if not (several := numbers.where("__n > 1")).isEmpty():
        out = out.union(placed(copied(one.join(several, ["__k1", "__k2"]), F.col("__n"), "__i").withColumn("__at", F.col("__start") + F.col("__i"))))
    return out
