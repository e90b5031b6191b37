"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of digits, ASCII letters (lower-cased) and all non-ASCII characters. Each item gives its windows of
``window`` consecutive words (the whole item if it has fewer, nothing if it has none). The windows are the patterns of
one automaton over word numbers; a document is normalised to the numbers of its words (0 for words of no item), scanned
once, and every match is a run of word numbers, which maps to code points of the original text.

Edge cases: null and wordless texts have no words, no hits and are clean. Items that are null or wordless give no
pattern. Equal windows of several items count for each of them. Rows that repeat are scanned and returned each for
itself. Empty tables give empty or clean results. Of the input only the named columns are read, so other columns may
have any names; ``decontaminate`` keeps all columns of the documents.

Scale: the documents are scanned in place without a shuffle. The item texts go to every worker, so their size is
measured first: up to ``most_bytes`` in all, blocks of at most ``block_bytes`` (and one item) are built into one automaton
each, and every text is scanned by each. A worker holds two automata at most; with more blocks they take turns over rounds
of texts. Larger benchmarks are not sent to anyone: the digests of their windows are a table, a Bloom filter of bounded size
keeps most windows of the texts where they are, and the rest meet the table in a join, with the same result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .util import packed, small_batches, stash, unpacked

#: One byte to one byte: A-Z to a-z, other ASCII outside of digits and letters to a blank; bytes of longer characters stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Automata a Python worker holds at a time, and the bytes of texts that one of them scans before the next takes over.
HELD, ROUND = 2, 8 << 20
#: Word numbers are written in this base: the automaton searches a node's children one by one, so they should be few.
BASE = 64

_automata: dict[tuple, Matcher] = {}


def normal_words(text: bytes | str | None) -> list[bytes]:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return raw.translate(_NORMAL).split()


@dataclass(frozen=True)
class Matcher:
    """An automaton over word numbers: each distinct item word is a number of `digits` letters, so windows of ten words
    are a few dozen nodes deep whatever the words' lengths, and a match that ends at a whole word is a match of words."""

    vocabulary: dict[bytes, str]
    digits: int
    automaton: ahocorasick.Automaton

    def scan(self, w: list[bytes]) -> list[tuple[tuple[str, ...], int, int]]:
        """(items, first word, last word) of every occurrence, in order of its end."""
        if not len(self.automaton) or not w:
            return []
        k, coded = self.digits, "".join(map(self.vocabulary.get, w, itertools.repeat("\0" * self.digits)))
        return [(ids, end // k - n + 1, end // k) for end, (n, ids) in self.automaton.iter(coded) if end % k == k - 1]


def matcher(items: tuple[tuple[str, bytes], ...], window: int) -> Matcher:
    """Built once in each Python worker, as long as it is among the last HELD ones."""
    key = (hash(items), len(items), window)
    if key not in _automata:
        numbers: dict[bytes, int] = {}
        for _, text in items:
            for x in normal_words(text):
                numbers.setdefault(x, len(numbers))
        digits = 1
        while BASE**digits < len(numbers):
            digits += 1
        vocabulary = {x: "".join([chr(1 + n // BASE**i % BASE) for i in range(digits)]) for x, n in numbers.items()}
        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            w = [vocabulary[x] for x in normal_words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                found.setdefault("".join(part), (len(part), set()))[1].add(item)
        a = ahocorasick.Automaton()
        for part, (n, ids) in found.items():
            a.add_word(part, (n, tuple(sorted(ids))))
        if len(a):
            a.make_automaton()
        while len(_automata) >= HELD:
            _automata.pop(next(iter(_automata)))
        _automata[key] = Matcher(vocabulary, digits, a)
    return _automata[key]


def rounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `most` bytes."""
    now, size = [], 0
    for batch in batches:
        now.append(batch)
        size += batch.nbytes
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def scanned(batches: Iterator[pa.RecordBatch], at: int, sent: list, window: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list]]]:
    """Each batch with, for each text in column `at`, its number of words and all occurrences. If there are more blocks
    than a worker holds automata, each takes its turn over a round of batches."""
    for some in rounds(batches, ROUND if len(sent) > HELD else 0):
        sizes, found = [[0] * len(b) for b in some], [[[] for _ in range(len(b))] for b in some]
        for block in sent:
            m = matcher(block.value, window)
            for batch, n, f in zip(some, sizes, found):
                for row, text in enumerate(batch.column(at).to_pylist()):
                    w = normal_words(text)
                    n[row] = len(w)
                    f[row] += m.scan(w)
        yield from zip(some, sizes, found)


def union_length(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto + 1) + 1)
        upto = max(upto, b)
    return total


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[tuple[tuple[str, bytes], ...]]:
    """The items in blocks of bounded size; the caller has checked their total."""
    out, now, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null").orderBy("i", "t")
    for i, t in rows.toLocalIterator():
        now.append((i if i is not None else "", bytes(t)))
        size += len(t)
        if size > block_bytes:
            out.append(tuple(now))
            now, size = [], 0
    return [*out, tuple(now)] if now or not out else out


SPANS = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _reported(id_field: T.StructField) -> T.StructType:
    return T.StructType([id_field, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])


def runs(found: list[tuple[tuple[str, ...], int, int]]) -> dict[str, list[tuple[int, int]]]:
    """For each item the runs of words that its windows cover, from occurrences in order of their ends."""
    by_item: dict[str, list[tuple[int, int]]] = {}
    for ids, a, b in found:
        for i in ids:
            mine = by_item.setdefault(i, [])
            if mine and a <= mine[-1][1] + 1 and a >= mine[-1][0]:
                mine[-1] = (mine[-1][0], max(b, mine[-1][1]))
            else:
                mine.append((a, b))
    return by_item


def fits(benchmark: DataFrame, text_col: str, most_bytes: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) <= most_bytes


def window_digests(w: list[bytes], n: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2] if digests else np.zeros(0, np.uint64)


def joined_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, most_bytes: int) -> DataFrame:
    """What find_hits returns, and __text_hash, by a join of window digests."""
    spark = docs.sparkSession

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes, str]] = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = normal_words(text)
                n = min(window, len(w))
                out += [(n, d, item or "") for d in set(window_digests(w, n))] if w else []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.binary(), pa.string()))], names=["n", "w", "item"])

    texts = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string").cast("binary"))
    table = stash(texts.mapInArrow(item_windows, "n int, w binary, item string").distinct(), "windows")
    sizes = sorted(r[0] for r in table.select("n").distinct().collect())  # at most `window` numbers
    segments = bloom.segments_for(16 * table.count())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(b.column(0).to_pylist()) for b in batches)]))
        yield from bloom.parts(h, np.zeros(len(h), bool), segments)

    known = spark.sparkContext.broadcast(bloom.collected(table.select("w").mapInArrow(fill, bloom.PARTS), segments, most_bytes, twice=False))
    kind = pa.list_(pa.struct([("n", pa.int32()), ("w", pa.binary()), ("first", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                w, mine = normal_words(text), []
                for n in sizes:
                    digests = window_digests(w, n)
                    mine += [(n, digests[i], i) for i in np.flatnonzero(known.value.suspects(_hashes(digests))).tolist()]
                at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))] if mine else []
                counts.append(len(w))
                found.append([{"n": n, "w": d, "first": i, "start": at[i][0], "end": at[i + n - 1][1]} for n, d, i in mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["id", "h", "n_words", "found"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("t"), F.xxhash64(text_col).alias("h"))
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    match = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("w", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("first", "start", "end")]])
    scanned = rows.mapInArrow(suspects, T.StructType([id_field, T.StructField("h", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(match))]))
    scanned = stash(scanned.withColumn("uid", F.monotonically_increasing_id()), "scanned")
    met = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.*").join(table, ["n", "w"])
    by_text = met.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct((F.col("first") + F.col("n") - 1).alias("last"), "first", "item", "start", "end"))).alias("found"))  # as long as a text has windows
    report = T.StructType([T.StructField("uid", T.LongType()), *_reported(id_field).fields[2:]])

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, items, spans = [], [], []
            for found in batch.column(1).to_pylist():
                by_item = runs([((f["item"],), f["first"], f["last"]) for f in found])
                starts, ends = {f["first"]: f["start"] for f in found}, {f["last"]: f["end"] for f in found}
                n_hit.append(union_length([(f["first"], f["last"]) for f in found]))
                items.append(sorted(by_item))
                spans.append([{"item_id": i, "start": starts[a], "end": ends[b]} for i in sorted(by_item) for a, b in by_item[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=report.names)

    found = by_text.mapInArrow(reports, report)
    out = scanned.drop("found").join(found, "uid", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.col("h").alias("__text_hash"))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 1 << 20, most_bytes: int = 1 << 24) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted distinct item ids as strings) and spans.

    spans: array of (item_id, start, end) in code points of the original text, end exclusive, one for each run of words
    that windows of the item cover.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not fits(benchmark, item_text_col, most_bytes):
        return joined_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, most_bytes).drop("__text_hash")
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text_col, block_bytes)]
    out = _reported(T.StructField(id_col, docs.schema[id_col].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, counts, every in scanned(batches, 1, sent, window):
            n_hit, items, spans = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), every):
                by_item = runs(found)
                n_hit.append(union_length([x[1:] for x in found]))
                items.append(sorted(by_item))
                at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))] if found else []
                spans.append([{"item_id": i, "start": at[a][0], "end": at[b][1]} for i in sorted(by_item) for a, b in by_item[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], names=out.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text")).mapInArrow(run, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 1 << 20, most_bytes: int = 1 << 24) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    if not fits(benchmark, item_text_col, most_bytes):
        found = joined_hits(docs.select(text_col, F.lit(0).alias("__zero")), benchmark, "__zero", text_col, item_col, item_text_col, window, most_bytes)
        bad = stash(found.where("n_hit > 0").select(F.col("__text_hash").alias("__h")).distinct(), "contaminated")
        return unpacked(packed(docs, __h=F.xxhash64(text_col)).join(bad, "__h", "left_anti"), docs)
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text_col, block_bytes)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, every in scanned(batches, at, sent, window):
            clean = [not found for found in every]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
