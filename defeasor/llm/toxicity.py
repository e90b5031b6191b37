"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of characters other than white space, stripped of ASCII punctuation at both ends. Features, each
hashed to one of 2**bits slots and counted once for a text: the words, their first four to eight letters (which carry a
stem into inflections not seen in training), pairs of neighbours, and pairs with one word between them.

FTRL-proximal learns with a learning rate for each coordinate (alpha / (beta + root of the sum of squared gradients)) and
L1 and L2 terms; L1 leaves most slots at exactly zero, so the weights that are broadcast are a few thousand numbers.

Training uses a sample of labelled rows of documented size (``max_rows``, at most half of them positive, chosen by a hash
of the id); features are hashed on the executors and only slot numbers come to the driver. Scoring covers whole texts.

Edge cases: null and empty texts have no features and get the intercept's score. Labels other than 0 and 1 and null
labels are not used; of several rows with one id one is used; without any label the model is zero and scores everything 0.5 below the threshold's margin (see
``Model.score``). Repeated rows are scored alike. Empty tables give empty results. Labels, language, source and id are
never inputs of a score. Only the named columns are read; ``drop_toxic`` keeps all columns.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import small_batches

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STARTS = (4, 5, 6, 7, 8)
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Vocabulary(dict):
    """Words as they stand in texts to rows of a table of hashes: the bare word and its STARTS first letters. Each
    Python worker has one; it starts anew once it holds `most` words and at the end of a task, so its size has a bound and
    nothing is kept for tasks of other operators."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hashes = np.zeros((1 + len(STARTS), 1 << 10), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        bare = word.strip(_PUNCT)
        if bare:
            letters, crc = bare.decode("utf-8", "replace"), zlib.crc32
            self.hashes[:, at] = crc(bare) + 1, *(crc(letters[:n].encode(), n) + 1 for n in STARTS)
        return at


_vocabulary = Vocabulary()


def distinct(x: np.ndarray) -> np.ndarray:
    """By sorting in place; np.unique hashes, which is slower for some thousand numbers."""
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def text_features(text: bytes | None, bits: int) -> np.ndarray:
    """The distinct slots of a text."""
    known = _vocabulary
    if len(known) > known.most:
        known.clear()
    raw = (text or b"").translate(_LOWER).split()
    ids = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    one = known.hashes[0][ids]
    if not one.all():  # words of punctuation only
        ids, one = ids[one > 0], one[one > 0]
    if not len(ids):
        return np.zeros(0, np.int64)
    stems = known.hashes[1:, distinct(ids)].ravel()
    with np.errstate(over="ignore"):
        a, b = one * np.uint64(0x9E3779B97F4A7C15), one * np.uint64(0xC2B2AE3D27D4EB4F)
        near, skip = a[:-1] ^ (b[1:] >> np.uint64(1)), a[:-2] ^ (b[2:] << np.uint64(1))
        every = np.concatenate([a, stems * np.uint64(0xD6E8FEB86659FD93), near * np.uint64(0xBF58476D1CE4E5B9), skip * np.uint64(0x94D049BB133111EB)])
    return distinct((every >> np.uint64(64 - bits)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """Nonzero weights by slot, in order of the slots."""

    bits: int
    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.slots] = self.weights
        return w

    def score(self, features: np.ndarray, dense: np.ndarray) -> float:
        """The probability of label 1. An untrained model (intercept -1e-9) stays just below 0.5."""
        x = self.intercept + float(dense[features].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, epochs: int = 8, seed: int = 7) -> Model:
    """FTRL-proximal over rows of distinct slots; the intercept is a coordinate without L1."""
    n, z = np.zeros(1 << bits), np.zeros(1 << bits)
    n0 = z0 = 0.0
    rng = np.random.default_rng(seed)

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs if len(rows) else 0):
        for i in rng.permutation(len(rows)).tolist():
            x = rows[i]
            w, w0 = weight(z[x], n[x]), -z0 / ((beta + math.sqrt(n0)) / alpha + l2)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w.sum())))) - labels[i]
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - s * w
            n[x] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / alpha * w0
            n0 += g * g
    w = weight(z, n)
    slots = np.flatnonzero(w)
    return Model(bits, slots, w[slots].astype(np.float32), -z0 / ((beta + math.sqrt(n0)) / alpha + l2) if len(rows) else -1e-9)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: F.Column | None = None, max_rows: int = 8000, bits: int = 20, epochs: int = 8) -> Model:
    """The model from at most max_rows labelled rows, at most half of them positive. held_out: a condition on the id (True:
    never used). The sample is the rows of smallest hash of the id, for each label on its own."""
    small_batches(docs.sparkSession)
    seen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    if held_out is not None:
        seen = seen.where(~held_out)
    seen = seen.groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = None
    for y in (0, 1):
        part = seen.where(F.col("__y") == y).orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").cast("binary").alias("__text")).join(F.broadcast(chosen), "__id")  # of at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t, bits).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "y", "x"])
        _vocabulary.clear()

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    one = picked.select("__id", "__y", "__text").mapInArrow(run, out).groupBy("id", "y").agg(F.min("x").alias("x"))  # one row of each id: max_rows at most
    got = sorted(one.toLocalIterator(), key=lambda r: (str(r[0]), bytes(r[2])))
    return ftrl([np.frombuffer(bytes(r[2]), np.int32) for r in got], np.array([r[1] for r in got], float), bits=bits, epochs=epochs)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, score and predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # nonzero weights only, 2**bits at most
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = m.dense()
        for batch in batches:
            s = np.array([m.score(text_features(t, m.bits), dense) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=out.names)
        _vocabulary.clear()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text")).mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = m.dense()
        for batch in batches:
            keep = [m.score(text_features((t or "").encode("utf-8", "replace"), m.bits), dense) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        _vocabulary.clear()

    return docs.mapInArrow(run, docs.schema)
