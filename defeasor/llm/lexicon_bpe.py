"""Byte-level BPE through a minimal acyclic transducer of frequent words.

A text is cut at the strings of added tokens (unless these count as plain text) and then into words by the vocabulary's
pattern; no merge crosses a word. The words of the whole corpus are counted, and the most frequent of them, up to
``lexicon_words``, are compiled with the token ids they become into a minimal acyclic transducer: words share prefixes and
suffixes, ids are pushed towards the root as far as the words below a state agree. The transducer is one file of flat arrays in
the shared folder, sent to every executor once; Python workers map it into memory, so those of one machine share its pages.
A word that it does not hold is merged by the rules, lowest rank first and leftmost among equals. Ids never depend on
which words the lexicon holds.

``encode`` gives ids as little-endian unsigned 32-bit integers, ``decode`` the text of such ids (malformed UTF-8 becomes
U+FFFD).

Edge cases: null and empty texts have no ids; rows are independent, so repeated rows and null ids come back as they are;
an empty table has an empty lexicon and gives an empty result. Only the named columns are read. A word of any length is
merged in n log n steps; words over 64 bytes are left out of the lexicon.

Scale: the counting pass shuffles the distinct words of each task with their counts, the two others shuffle nothing. The
lexicon is bounded by ``lexicon_words``; the words a worker remembers are bounded by MEMO. Lost executors repeat their tasks;
a new executor fetches the file again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .util import shared_path, small_batches, stash

# Fixed value: the pattern of words of the byte-level vocabularies, as far as it concerns code points below U+0250.
# No two of the alternatives before that of signs can start alike, so that their order is free.
LATIN_WORDS = r" ?{letters}+| ?{numbers}+|'(?:s|t|re|ve|m|ll|d)| ?{signs}+|{space}+(?!{ink})|{space}+"
LATIN = 0x250

#: Words that a worker remembers with their ids; when it has twice as many, those not met of late are forgotten.
MEMO = 1 << 18
#: Longest word, in bytes, that a lexicon holds and that is merged in a plain list; longer ones are merged from a heap.
LONGEST = 64


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself if Latin-1 prints it, else the next free
    character from U+0100 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def latin_words() -> re.Pattern:
    """The pattern with its classes written out, which the plain engine finds fastest."""
    kinds: dict[str, str] = {"L": "", "N": "", "space": ""}
    for c in map(chr, range(LATIN)):
        kind = "space" if c in "\t\n\x0b\x0c\r \x85\xa0" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, numbers, space = kinds["L"], kinds["N"], kinds["space"]
    return re.compile(LATIN_WORDS.format(letters=f"[{letters}]", numbers=f"[{numbers}]", signs=f"[^{space}{letters}{numbers}]", space=f"[{space}]", ink=f"[^{space}]"))


_BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in their order; in several lists if it is very long. Texts with other than Latin letters are cut
    by the library, whose Unicode version decides what a letter is."""
    if not text.isascii() and _BEYOND.search(text):
        yield [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    elif len(text) <= 1 << 22:
        yield latin_words().findall(text)
    else:
        found = latin_words().finditer(text)
        while some := [m[0] for m in islice(found, 1 << 16)]:
            yield some


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE definition."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        model, symbols = whole["model"], byte_symbols()
        if model["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"] or whole["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in model["vocab"].items()}
        self.single = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.single[b[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(model["vocab"][a], model["vocab"][b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [model["vocab"][a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.size = max(self.bytes_of) + 1

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged, the leftmost of equals, until none is left."""
        ids, n = [self.single[b] for b in word], len(word)
        if n > LONGEST:
            return self._merge_long(ids)
        rank, none = self.ranks.get, len(self.made)
        found = [rank(p, none) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [made] = [self.made[best]]
            del found[i]
            if i:
                found[i - 1] = rank((ids[i - 1], made), none)
            if i < len(found):
                found[i] = rank((made, ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, *p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for h, k in ((i, after[i]), (before[i], i)):
                if h >= 0 and k < n and (r := rank((ids[h], ids[k]))) is not None:
                    heapq.heappush(heap, (r, h, ids[h], ids[k]))
        return [i for i in ids if i >= 0]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(definition: str) -> Vocabulary:
    """Built once in each Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(definition)
    return _vocabularies[key]


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, ids, number of a frozen state]
        self.final: tuple[int, ...] | None = None


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The transducer of the words as flat arrays: a header of four counts; then for states the first arc and the final
    output, for arcs the target and the output, the starts and the ids of the outputs, and the bytes of the arcs."""
    known: dict[tuple, int] = {}
    first, final, targets, outs, labels = [0], [], [], [], bytearray()
    pool: dict[tuple[int, ...], int] = {(): 0}

    def freeze(state: _State) -> int:
        key = (state.final, tuple((b, out, to) for b, out, to in state.arcs))
        if key not in known:
            known[key] = len(final)
            final.append(-1 if state.final is None else pool.setdefault(state.final, len(pool)))
            for b, out, to in state.arcs:
                labels.append(b)
                targets.append(to)
                outs.append(pool.setdefault(out, len(pool)))
            first.append(len(labels))
        return known[key]

    path, last = [_State()], b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            number = freeze(path.pop())
            path[-1].arcs[-1][2] = number

    for word in sorted(words):
        out, same = tuple(words[word]), 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same)
        for depth in range(same):  # what the words along the shared way agree on stays there, the rest moves down
            arc, below, k = path[depth].arcs[-1], path[depth + 1], 0
            while k < min(len(arc[1]), len(out)) and arc[1][k] == out[k]:
                k += 1
            if rest := arc[1][k:]:
                arc[1] = arc[1][:k]
                for a in below.arcs:
                    a[1] = rest + a[1]
                if below.final is not None:
                    below.final = rest + below.final
            out = out[k:]
        for b in word[same:]:
            path[-1].arcs.append([b, out, -1])
            path.append(_State())
            out = ()
        path[-1].final = out
        last = word
    close(0)
    root = freeze(path[0])
    ids, starts = array("i"), array("i", [0])
    for out in pool:
        ids.extend(out)
        starts.append(len(ids))
    head = struct.pack("<5q", len(final), len(labels), len(pool), len(ids), root)
    return head + b"".join(array("i", x).tobytes() for x in (first, final, targets, outs, starts, ids)) + bytes(labels)


class Lexicon:
    """Looks words up in a compiled transducer, which stays in the buffer (a memory map, or bytes)."""

    def __init__(self, buffer):
        self.states, arcs, outputs, n_ids, self.root = struct.unpack_from("<5q", buffer)
        parts, at = [], 40
        for n in (self.states + 1, self.states, arcs, arcs, outputs + 1, n_ids):
            parts.append(np.frombuffer(buffer, np.int32, n, at))
            at += 4 * n
        first, self.final, self.targets, self.outs, self.starts, self.ids = parts
        # the arcs in the order of their state and byte, as they are stored
        self.arcs = np.repeat(np.arange(self.states, dtype=np.int64), np.diff(first)) << 8 | np.frombuffer(buffer, np.uint8, arcs, at)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, None for those that the lexicon does not hold. All words walk together, a byte a step."""
        sizes = np.array([len(w) for w in words], np.int64)
        text, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, alive = np.full(len(words), self.root, np.int64), np.flatnonzero(sizes) if len(self.arcs) else np.zeros(0, np.int64)
        lost, said = (sizes > 0) & (len(self.arcs) == 0), []
        for k in range(int(sizes.max(initial=0))):
            key = state[alive] << 8 | text[begin[alive] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else key
            there = self.arcs[arc] == key if len(self.arcs) else np.zeros(0, bool)
            lost[alive[~there]] = True
            alive, arc = alive[there], arc[there]
            state[alive] = self.targets[arc]
            speaks = self.outs[arc] > 0
            said.append((alive[speaks], self.outs[arc[speaks]]))
            alive = alive[sizes[alive] > k + 1]
        held = ~lost & (self.final[state] >= 0)
        said.append((np.flatnonzero(held), self.final[state[held]]))
        found: list[bytes | None] = [b"" if h else None for h in held.tolist()]
        for rows, outs in said:
            for i, o in zip(rows.tolist(), outs.tolist()):
                if found[i] is not None:
                    found[i] += self.ids[self.starts[o] : self.starts[o + 1]].tobytes()
        return found


class Encoder(dict):
    """Remembers the packed ids of words; those of new words come from the lexicon or from the merges."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, plain: bool = False):
        super().__init__()
        self.vocab, self.lexicon, self.older = vocab, lexicon, {}
        self.added = {} if plain else {s: array("I", [i]).tobytes() for s, i in vocab.added.items()}
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")

    def learn(self, words: set[str]) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        new = []
        for word in words.difference(self):
            if packed := self.older.get(word):
                self[word] = packed
            else:
                new.append(word)
        raw = [w.encode() for w in new]
        found = [None] * len(raw) if self.lexicon is None else self.lexicon.find_all([w if len(w) <= LONGEST else b"" for w in raw])
        for word, b, ids in zip(new, raw, found):
            self[word] = ids or array("I", self.vocab.merge(b)).tobytes()

    def _parts(self, text: str | None) -> list[str]:
        """Plain stretches at even places, added tokens at odd ones."""
        if not text:
            return []
        return self.special.split(text) if any(s in text for s in self.added) else [text]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; words are learned about a million characters at a time."""
        held: list[list[bytes | list[str]]] = []
        size = 0
        for text in texts:
            cut = [self.added[part] if i % 2 else words for i, part in enumerate(self._parts(text)) for words in ([()] if i % 2 else words_of(part))]
            held.append(cut)
            size += len(text or "")
            if size > 1 << 20:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[bytes | list[str]]]) -> Iterator[bytes]:
        self.learn(set().union(*[part for cut in held for part in cut if not isinstance(part, bytes)]))
        for cut in held:
            yield b"".join([part if isinstance(part, bytes) else b"".join(map(self.__getitem__, part)) for part in cut])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def word_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at most LONGEST bytes occurs in all texts."""
    small_batches(docs.sparkSession, 500)
    out = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in words_of(text or ""):
                    seen.update(words)
            if len(seen) > MEMO:
                yield rows(seen)
                seen = Counter()
        if seen:
            yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in seen.items() if len(w) <= LONGEST and len(w.encode()) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=out.names)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, out).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, definition: str, *, text_col: str = "text", lexicon_words: int = 1 << 17) -> str:
    """Compiles the most frequent words of all texts; the name under which executors have the file. The words are those of
    at least a count that leaves no more than lexicon_words of them, so no task and no driver sorts words."""
    spark = docs.sparkSession
    counted = stash(word_counts(docs, text_col=text_col).where("n > 1").withColumn("size", F.floor(F.log2("n") * 8)), "words")
    least, total = None, 0
    for r in counted.groupBy("size").count().orderBy(F.desc("size")).collect():  # some 500 sizes at most
        total += r["count"]
        if total > lexicon_words:
            break
        least = r["size"]
    vocab = vocabulary(definition)
    words = [] if least is None else [r["word"].encode() for r in counted.where(F.col("size") >= least).select("word").collect()]
    return share(spark, compile_lexicon({w: tuple(vocab.merge(w)) for w in words}))


def share(spark: SparkSession, content: bytes) -> str:
    """Writes a file to the shared folder and has Spark send it to every executor; its name there."""
    path = shared_path(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(content))
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _by_row(docs: DataFrame, id_col: str, value_col: str, out: T.StructType, make: Callable) -> DataFrame:
    """One result row for each row, from its value; make() gives the function of a batch's values in the worker."""
    small_batches(docs.sparkSession, 500)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *apply(batch.column(1).to_pylist())], names=out.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{value_col}`")).mapInArrow(run, out)


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 1 << 17) -> DataFrame:
    """Per row: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    definition = read(tokenizer_path)
    lexicon = build_lexicon(docs, definition, text_col=text_col, lexicon_words=lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file of some MB, whatever the input

    def make():
        encoder = Encoder(vocabulary(shared.value), Lexicon.open(SparkFiles.get(lexicon)))

        def apply(texts: list[str | None]) -> list[pa.Array]:
            ids = list(encoder.encode_all(texts))
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

        return apply

    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return _by_row(docs, id_col, text_col, out, make)


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, ids and the text they stand for, added tokens included; ids that the vocabulary lacks stand for nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(read(tokenizer_path))

    def make():
        found = vocabulary(shared.value)
        raw = [found.bytes_of.get(i, b"") for i in range(found.size)]

        def text(ids: bytes | None) -> str:
            numbers = array("I", ids or b"")
            known = numbers if not numbers or max(numbers) < found.size else [i for i in numbers if i < found.size]
            return b"".join(map(raw.__getitem__, known)).decode("utf-8", "replace")

        return lambda rows: [pa.array(rows, pa.binary()), pa.array([text(x) for x in rows], pa.string())]

    return _by_row(encoded, id_col, ids_col, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]), make)
