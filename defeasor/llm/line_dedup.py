r"""Line dedup with two Bloom filters.

A text is split at \n; a line's key is the line stripped of white space and lower-cased (A-Z). A key of at least
``min_chars`` code points that is in at least ``min_docs`` documents loses all its lines in every document (or, with
``keep_first``, all but the first occurrence in the corpus, by id).

1. The lines are counted, which sets the size of the filters: ``bits_per_line`` bits a line, in segments by the leading
   bits of a line's 64-bit hash. Each input partition fills two filters of its own, "seen once" and "seen twice", and
   hands on the places of their bits. Partial filters of a segment are merged by OR: a bit is in the second filter if it is
   in any second one or in two first ones. No line and no hash of one is shuffled. The merged second filters are
   broadcast; beyond ``most_bytes`` in all they are folded by OR to that size.
2. Texts are read again: only lines that the second filter suspects of repeating leave their task, as 128-bit digests
   with document counts, pre-aggregated, and are counted exactly. False positives of the filter drop out here; a
   repeated line always passes both filters.
3. Texts are read a third time and lose the lines of confirmed keys. The confirmed digests are counted first: up to
   ``block_keys`` of them are broadcast. Beyond that nothing is: each text's suspected digests are joined with the
   confirmed ones and come back to the text as an array, by the hash of the text.

Edge cases: null and empty texts are one empty line, which is never dropped (unless min_chars is 0); a key repeated
within a document counts once for it; rows are documents, whatever their id: repeated rows and null ids count each for
itself, and with keep_first one row of them keeps a line. Ids are compared as their type is, null last, then by the hash of
the text. Empty tables give empty results. Only the named columns are read; ``drop_repeated_lines`` keeps all columns,
whatever their names.

Scale: no text is shuffled while the confirmed digests fit a broadcast, else once; with keep_first the table is written
once with a number for each row. What is shuffled for the filters is some 4 bytes a distinct line of a partition. A folded
filter suspects more lines, and one that is full all of them: then every digest is shuffled, pre-aggregated, and the result
is the same. With the default size that begins beyond some 10**9 distinct lines.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .util import packed, small_batches, stash, unpacked

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line."""
    return [line.strip(_SPACE) for line in (text or b"").translate(_LOWER).split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").cast("binary").alias("t"))


def _document_counts(texts: list[bytes | None], min_chars: int) -> Counter:
    seen: Counter = Counter()
    for text in texts:
        seen.update({k for k in line_keys(text) if long_enough(k, min_chars)})
    return seen


def twice_filter(docs: DataFrame, text_col: str = "text", min_chars: int = 1, bits_per_line: int = 16, most_bytes: int = 1 << 26) -> bloom.Filter:
    """The second filter of all lines: at most most_bytes."""
    text = F.col(text_col).cast("string")
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = bloom.segments_for(lines * bits_per_line)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            seen = _document_counts(batch.column(0).to_pylist(), min_chars)
            hashes.append(np.array([xxhash.xxh64_intdigest(k) for k in seen], np.uint64))
            counts.append(np.fromiter(seen.values(), np.int64, len(seen)))
        h, back = np.unique(np.concatenate(hashes), return_inverse=True)
        again = np.bincount(back, np.concatenate(counts), len(h)) > 1
        yield from bloom.parts(h, again, segments)

    return bloom.collected(_texts(docs, text_col).mapInArrow(fill, bloom.PARTS), segments, most_bytes, twice=True)


def repeated_keys(docs: DataFrame, filters: Broadcast, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """key (128-bit digest) and n_docs of every key in at least min_docs documents, confirmed exactly. Written once."""
    small_batches(docs.sparkSession)
    if min_docs < 2:
        raise ValueError("a repeated line is in at least two documents")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _document_counts(batch.column(0).to_pylist(), min_chars)
            keys = list(seen)
            may = filters.value.suspects(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64))
            keys = [keys[i] for i in np.flatnonzero(may).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()), pa.array([seen[k] for k in keys], pa.int64())], names=["key", "n"])

    counted = _texts(docs, text_col).mapInArrow(suspects, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n_docs"))
    return stash(counted.where(F.col("n_docs") >= min_docs), "lines")


def _digests(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short."""
    return [xxhash.xxh3_128_digest(k) if long_enough(k, min_chars) else None for k in line_keys(text)]


def _cut(text: bytes | None, gone: Container[bytes], own: Iterable[bytes], min_chars: int) -> tuple[int, list[bytes]]:
    """The number of lines and the lines that stay; the first line of each key in own stays, too."""
    lines, mine, stay = (text or b"").split(b"\n"), set(own), []
    for line, d in zip(lines, _digests(text, min_chars)):
        if d in mine or d not in gone:
            mine.discard(d)
            stay.append(line)
    return len(lines), stay


class Confirmed:
    """The confirmed keys: broadcast if there are at most block_keys of them, else at hand by joins only."""

    def __init__(self, docs: DataFrame, text_col: str, min_docs: int, min_chars: int, bits_per_line: int, block_keys: int, most_bytes: int):
        small_batches(docs.sparkSession)
        self.docs, self.text_col, self.min_chars = docs, text_col, min_chars
        self.filters = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text_col, min_chars, bits_per_line, most_bytes))
        self.keys = repeated_keys(docs, self.filters, text_col, min_docs, min_chars)
        self.small = self.keys.count() <= block_keys
        held = frozenset(bytes(k) for (k,) in self.keys.select("key").toLocalIterator()) if self.small else frozenset()
        self.held = docs.sparkSession.sparkContext.broadcast(held)

    def occurrences(self, mark: Column) -> DataFrame:
        """(key, mark): confirmed keys of each document, once for each."""
        filters, held, small, least = self.filters, self.held, self.small, self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    mine = [k for k in set(line_keys(t)) if long_enough(k, least)]
                    if not small:
                        may = filters.value.suspects(np.array([xxhash.xxh64_intdigest(k) for k in mine], np.uint64))
                        mine = [mine[j] for j in np.flatnonzero(may).tolist()]
                    found = [d for d in map(xxhash.xxh3_128_digest, mine) if not small or d in held.value]
                    keys += found
                    at += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))], names=["key", "mark"])

        marks = self.docs.select(mark.alias("mark"), F.col(self.text_col).cast("string").cast("binary").alias("t"))
        found = marks.mapInArrow(run, T.StructType([T.StructField("key", T.BinaryType()), marks.schema["mark"]]))
        return found if small else found.join(self.keys.select("key"), "key")

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows (with __h, the hash of the text) with __gone, the keys their lines lose, or null if the broadcast has them.
        What a text loses depends on the text only, so its hash finds it."""
        if self.small:
            return rows.withColumn("__gone", F.lit(None).cast("array<binary>"))
        gone = self.occurrences(F.xxhash64(self.text_col)).distinct().groupBy(F.col("mark").alias("__h")).agg(F.collect_list("key").alias("__gone"))  # as many as a text has lines
        return rows.join(gone, "__h", "left")


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, bits_per_line: int = 16, block_keys: int = 1 << 20, most_bytes: int = 1 << 26) -> DataFrame:
    """Per row: id, n_lines, n_dropped and kept_sha256 (of the lines that stay, joined by \\n)."""
    c = Confirmed(docs.select(id_col, text_col), text_col, min_docs, min_chars, bits_per_line, block_keys, most_bytes)
    held, small, least = c.held, c.small, c.min_chars
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [None] * len(batch) if small else batch.column(2).to_pylist()
            found = [_cut(t, held.value if small else set(g or ()), (), least) for t, g in zip(batch.column(1).to_pylist(), listed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(s) for n, s in found], pa.int64()), pa.array([hashlib.sha256(b"\n".join(s)).hexdigest() for _, s in found], pa.string())], names=out.names)

    text = F.col(text_col).cast("string").cast("binary").alias("__text")
    rows = c.docs.select(F.col(id_col).alias("__id"), text, *([] if small else [F.xxhash64(text_col).alias("__h")]))
    return (rows if small else c.marked(rows)).select("__id", "__text", *([] if small else ["__gone"])).mapInArrow(run, out)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits_per_line: int = 16, block_keys: int = 1 << 20, most_bytes: int = 1 << 26) -> DataFrame:
    """docs with the repeated lines cut out of the text (null stays null). keep_first: the row with the smallest id (null
    last; then by the hash of the text, then any one) that has a key keeps the key's first line."""
    whole = packed(docs, __id=id_col, __t=F.col(text_col).cast("string"))
    if keep_first:
        whole = stash(whole.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    c = Confirmed(whole, "__t", min_docs, min_chars, bits_per_line, block_keys, most_bytes)
    held, small, least = c.held, c.small, c.min_chars

    def cut(t: bytes | None, gone: list[bytes] | None, own: list[bytes] | None) -> str | None:
        if t is None:
            return None
        return b"\n".join(_cut(t, held.value if small else set(map(bytes, gone or ())), map(bytes, own or ()), least)[1]).decode("utf-8", "replace")

    rows = c.marked(whole.withColumn("__h", F.xxhash64("__t")))
    own = F.lit(None).cast("array<binary>")
    if keep_first:
        marks = c.occurrences(F.struct(F.col("__id").isNull().alias("x"), F.col("__id").alias("i"), F.xxhash64("__t").alias("h"), F.col("__n").alias("n")))
        first = marks.groupBy("key").agg(F.min("mark").alias("m"))
        rows = rows.join(first.groupBy(F.col("m.n").alias("__n")).agg(F.collect_list("key").alias("__own")), "__n", "left")
        own = F.col("__own")
    text = F.udf(cut, "string", useArrow=True)(F.col("__t").cast("binary"), F.col("__gone"), own)
    return unpacked(rows, docs, **{text_col: text})
