"""Alignment of two tokenizers' tokens by an event sweep over byte offsets.

Tokenizer A is a byte-level BPE vocabulary that encodes a space and the text, special strings as plain text; B is a
sentencepiece model with byte fallback that adds the space itself. Each token has the bytes it stands for, and each end of
a token is an event at a byte offset.

1. Texts are known by a 128-bit hash; each different text is taken once, with the number of its rows. A task turns texts
   into events of A or of B: runs of up to RUN ids with the offset at which the run starts, as the length of a token
   follows from its id. Both are united, dealt by text and sorted in their partition by offset.
2. A machine reads the sorted runs. It holds the ids since the last offset at which both have an end, and emits groups
   (the ids of A and of B between two such offsets) and links (pairs of tokens whose bytes overlap). The text of groups
   goes through a running SHA-256 and links are added up by pair every LINKS of them, so that what is held does not grow
   with the text, but for a group that itself does not end.
3. Counts of pairs over the corpus are sums of the written links; each pair meets its B id's highest. Up to
   ``most_broadcast`` different pairs are broadcast, beyond that links are joined with them by pair.

Edge cases: a text that is null or empty, or whose joined bytes of A or B differ from a space and the text (for B: it
holds U+2581, or the model rewrites it), has no tokens: zeros and '' for the groups. Rows with equal texts have equal
results, whatever their ids, and each counts. An empty table gives an empty result. Only the named columns are read. B's
pieces never span the start of white space, which is checked when a model is loaded, so stretches that start there are
encoded once each; a model without this property encodes whole texts.

Scale: no text is shuffled but those that several rows share; a text that a third of the rows have is encoded once and
meets its rows in a join of written tables, which AQE can split. What is shuffled is two bytes a token (four for
vocabularies over 65536) and narrow rows by text. A written table holds the links, so that a lost executor repeats a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon_bpe import Encoder, read, vocabulary
from .simhash import small_or_all
from .util import shared_path, small_batches

#: Ids in an event row, and links that are held before they are added up.
RUN, LINKS = 1 << 12, 1 << 17
#: Stretches of text that a worker remembers with their pieces.
MEMO = 1 << 17
A_SIDE, B_SIDE, VOID = 0, 1, 2

_STRETCH = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")


class Pieces(dict):
    """Remembers the packed ids of B for stretches of text, and in `odd` the stretches whose bytes do not come back."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, dtype: str):
        super().__init__()
        self.model, self.dtype, self.odd = model, dtype, set()
        self.bytes_of = piece_bytes(model)
        self.local = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))

    def __missing__(self, stretch: str) -> bytes:
        # the model adds the space that a stretch starts with, but not to an empty text
        ids = self.model.encode(stretch[1:], num_threads=1) if len(stretch) > 1 else self.model.encode("a" + stretch, num_threads=1)[len(self.model.encode("a", num_threads=1)) :]
        if b"".join([self.bytes_of[i] for i in ids]) != stretch.encode():
            self.odd.add(stretch)
        self[stretch] = packed = np.array(ids, self.dtype).tobytes()
        return packed

    def encode(self, text: str) -> bytes | None:
        """Packed ids of a text; None if their bytes are not a space and the text."""
        if len(self) > MEMO or not self.local:
            self.clear()
            self.odd.clear()
        stretches = _STRETCH.findall(" " + text) if self.local else [" " + text]
        packed = b"".join(map(self.__getitem__, stretches))
        if self.odd and not self.odd.isdisjoint(stretches) and b"".join([self.bytes_of[i] for i in np.frombuffer(packed, self.dtype)]) != (" " + text).encode():
            return None
        return packed


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """What each piece stands for: <0xHH> a byte, others their UTF-8 with U+2581 as a space."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Sweep:
    """The machine for one text: takes runs of ids in the order of their offsets."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], written: list[list[bytes]], b_size: int):
        self.lengths, self.written, self.b_size = lengths, written, b_size
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.new: list[list[np.ndarray]] = [[], []]
        self.waiting, self.enough = 0, 2 * RUN
        self.n = [0, 0]
        self.n_groups = self.n_links = self.held = 0
        self.sha, self.codes = hashlib.sha256(), []

    def take(self, side: int, ids: np.ndarray) -> None:
        self.new[side].append(ids.astype(np.int64))
        self.n[side] += len(ids)
        self.waiting += len(ids)
        if self.waiting >= self.enough:
            self.settle()
            self.enough = 2 * RUN + 2 * (len(self.ids[0]) + len(self.ids[1]))

    def settle(self) -> None:
        """Emits all groups that are complete; what comes after the last common end stays."""
        self.waiting = 0
        a, b = self.ids = [np.concatenate([old, *new]) for old, new in zip(self.ids, self.new)]
        self.new = [[], []]
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return
        last_a, last_b = np.searchsorted(a_ends, common[-1]) + 1, np.searchsorted(b_ends, common[-1]) + 1
        self.ids = [a[last_a:], b[last_b:]]
        a, b, a_ends, b_ends = a[:last_a], b[:last_b], a_ends[:last_a], b_ends[:last_b]
        # links: from the first token of B that ends after A's start to the first that does not end before A's end
        low = np.searchsorted(b_ends, a_ends - self.lengths[0][a], "right")
        many = np.searchsorted(b_ends, a_ends, "left") - low + 1
        first = np.repeat(np.cumsum(many) - many, many)
        of_b = np.repeat(low, many) + np.arange(len(first)) - first
        self.codes.append(np.repeat(a, many) * self.b_size + b[of_b])
        self.n_links += len(first)
        self.held += len(first)
        # the text of groups: A's ids, then B's; each with the sign before it
        group_a, group_b = np.searchsorted(common, a_ends, "left"), np.searchsorted(common, b_ends, "left")
        new_a, new_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        signs = np.concatenate([new_a.astype(np.int64), new_b * 2])[order]
        comma, semicolon, bar = self.written
        said = b"".join([(comma, semicolon, bar)[s][i] for s, i in zip(signs.tolist(), np.concatenate([a, b])[order].tolist())])
        self.sha.update(said if self.n_groups else said[1:])
        self.n_groups += len(common)

    def links(self) -> tuple[bytes, bytes]:
        """The pairs of the links held, with how many links hold each; none are held afterwards."""
        codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.codes]), return_counts=True)
        self.codes, self.held = [], 0
        return codes.tobytes(), n.astype(np.uint32).tobytes()


def signed_ids(size: int) -> list[list[bytes]]:
    """Decimal ids with the sign before them: within a side of a group, before a group, before B."""
    return [[sign + b"%d" % i for i in range(size)] for sign in (b",", b";", b"|")]


_loaded: dict[tuple[str, str], tuple] = {}

SWEPT = "k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, held binary"


def _hashes(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _different_texts(docs: DataFrame, text_col: str, several: DataFrame) -> DataFrame:
    """(k1, k2, text): each text that is not empty once; only those of several rows are shuffled."""
    text = F.col(f"`{text_col}`").cast("string")
    all_texts = docs.where(F.length(text) > 0).select(*_hashes(text), text.alias("text"))
    again = small_or_all(several.select("k1", "k2"))
    return all_texts.join(again, ["k1", "k2"], "left_anti").union(all_texts.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))


def _models(a: str, b_file: str) -> tuple:
    """Vocabulary of A, pieces of B, lengths and ids as written; built once in each Python worker."""
    key = (hashlib.sha256(a.encode()).hexdigest(), b_file)
    if key not in _loaded:
        vocab = vocabulary(a)
        model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(b_file))
        sizes = vocab.size, model.get_piece_size()
        lengths = np.array([len(vocab.bytes_of.get(i, b"")) for i in range(sizes[0])]), np.array([len(x) for x in piece_bytes(model)])
        dtype = "<u2" if max(sizes) <= 1 << 16 else "<u4"
        _loaded[key] = Encoder(vocab, plain=True), Pieces(model, dtype), lengths, signed_ids(max(sizes)), dtype
    return _loaded[key]


def events(texts: DataFrame, side: int, a, b_file: str) -> DataFrame:
    """(k1, k2, at, side, ids): runs of token ends; of B also marks of texts whose bytes do not come back, at -1."""
    out = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("at", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces, lengths, _, dtype = _models(a.value, b_file)
        for batch in batches:
            row, at, sides, runs = [], [], [], []
            texts = batch.column(2).to_pylist()
            encoded = encoder.encode_all([" " + t for t in texts]) if side == A_SIDE else map(pieces.encode, texts)
            for i, packed in enumerate(encoded):
                if packed is not None:
                    ids = np.frombuffer(packed, "<u4" if side == A_SIDE else dtype)
                else:
                    row.append(i)
                    at.append(-1)
                    sides.append(VOID)
                    runs.append(b"")
                    continue
                starts = 0
                for s in range(0, len(ids), RUN):
                    some = ids[s : s + RUN]
                    row.append(i)
                    at.append(starts)
                    sides.append(side)
                    runs.append(some.astype(dtype).tobytes())
                    starts += int(lengths[side][some].sum()) if len(ids) > RUN else 0
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(sides, pa.int32()), pa.array(runs, pa.binary())], names=out.names)

    return texts.mapInArrow(run, out)


def sweep(sorted_events: DataFrame, a, b_file: str, b_size: int) -> DataFrame:
    """A row for each text with its figures and links; further rows hold the other links of long texts."""
    names = [c.split()[0] for c in SWEPT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, lengths, written, dtype = _models(a.value, b_file)
        now, machine, rows = None, None, []

        def end() -> None:
            if machine is not None:
                machine.settle()
                rows.append((*now, *machine.n, machine.n_groups, machine.n_links, machine.sha.hexdigest(), *machine.links()))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            k1, k2, _, sides, runs = (c.to_pylist() for c in batch.columns)
            for key, side, ids in zip(zip(k1, k2), sides, runs):
                if key != now:
                    end()
                    now, machine = key, None if side == VOID else Sweep(lengths, written, b_size)
                if machine is not None:
                    machine.take(side, np.frombuffer(ids, dtype))
                    if machine.held >= LINKS:
                        rows.append((*now, None, None, None, None, None, *machine.links()))
                if len(rows) >= 256:
                    yield batch_of(rows)
                    rows.clear()
        end()
        if rows:
            yield batch_of(rows)

    return sorted_events.mapInArrow(run, SWEPT)


def pair_counts(swept: DataFrame, b_size: int) -> DataFrame:
    """(code, n, best): how many links of the corpus hold a pair, and whether no pair of its B id has more; rows count
    __n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            for c, n, times in zip(*(col.to_pylist() for col in batch.columns)):
                codes.append(np.frombuffer(c, np.int64))
                counts.append(np.frombuffer(n, np.uint32).astype(np.int64) * times)
                held += len(codes[-1])
                if held > 1 << 20:
                    one, n = added(codes, counts)
                    if len(one) > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n)], names=["code", "n"])
                        one, n = one[:0], n[:0]
                    codes, counts, held = [one], [n], len(one)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, added(codes, counts))], names=["code", "n"])

    def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        one, where = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(one), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        return one, total

    sums = swept.select("codes", "held", "__n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    sums = _written(sums, "pairs")
    top = sums.groupBy((F.col("code") % b_size).alias("b")).agg(F.max("n").alias("top"))
    # one row for each id of the vocabulary at most
    return sums.join(F.broadcast(top), F.col("code") % b_size == F.col("b")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _valued(swept: DataFrame, pairs: DataFrame, most_broadcast: int) -> DataFrame:
    """Adds n_best and count_sum to each row of links."""
    figures = ["k1", "k2", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.count() <= most_broadcast:
        rows = pairs.toArrow().sort_by("code")
        shared = pairs.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("code", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, best = shared.value
            for batch in batches:
                n_best, total = [], []
                for c, times in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist()):
                    at, m = np.searchsorted(codes, np.frombuffer(c, np.int64)), np.frombuffer(times, np.uint32).astype(np.int64)
                    n_best.append(int(m[best[at]].sum()))
                    total.append(int((m * n[at]).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*figures, "n_best", "count_sum"])

        return swept.drop("__n").mapInArrow(run, "k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, c, times in zip(*(col.to_pylist() for col in batch.columns)):
                codes = np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k1)), pa.array(np.full(len(codes), k2)), pa.array(codes), pa.array(np.frombuffer(times, np.uint32).astype(np.int64))], names=["k1", "k2", "code", "m"])

    met = swept.select("k1", "k2", "codes", "held").mapInArrow(single, "k1 long, k2 long, code long, m long").join(_written(pairs, "pairs"), "code")
    sums = met.groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    return swept.where("n_a is not null").select(*figures).join(sums, ["k1", "k2"])


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1 << 21) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    spark.sparkContext.addFile(b_path)
    b_file = b_path.rsplit("/", 1)[-1]
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    a = spark.sparkContext.broadcast(read(a_path))  # one vocabulary file of some MB, whatever the input

    text = F.col(f"`{text_col}`").cast("string")
    rows = _written(docs.select(F.col(f"`{id_col}`"), *_hashes(text)), "rows")
    several = _written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "several")
    texts = _different_texts(docs, text_col, several)
    found = events(texts, A_SIDE, a, b_file).union(events(texts, B_SIDE, a, b_file))
    found = found.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at", "side")
    swept = _written(sweep(found, a, b_file, b_size), "swept")
    weighted = swept.join(small_or_all(several), ["k1", "k2"], "left").select(*swept.columns, F.coalesce("__n", F.lit(1)).alias("__n"))
    valued = _valued(weighted, pair_counts(weighted, b_size), most_broadcast)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    result = _written(valued.groupBy("k1", "k2").agg(*sums, F.max("groups_sha256").alias("groups_sha256")), "aligned")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(result, ["k1", "k2"], "left").select(F.col(f"`{id_col}`"), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
