"""SimHash near-duplicates with pivot distance tables.

A text is lower-cased (A-Z), cut at white space and turned into 3-word shingles (repeats count; fewer words: the whole
sequence). Bit b of the fingerprint is set if over half of the shingles' XXH64 (seed 42) have it. Fingerprints that differ
in at most ``radius`` bits are linked; groups are the connected components.

Search: equal fingerprints are one node from the start. Each has its Hamming distances to ``pivots`` fixed reference
fingerprints, precomputed once and written as the pivot table. By the triangle inequality a pair is discarded if any
coordinate differs by more than the radius, and what survives is verified bit by bit. Which pairs are held against the
table: if two fingerprints differ in at most 3 of 64 bits, at least 3 of 6 blocks are equal, so each goes to 20 block keys
of about 32 bits and only those with an equal key meet. A key of more than ``hot`` fingerprints is divided again by 20 keys
of about 16 of its other bits. In a meeting the first coordinate puts the rows in order, so that a row's partners are a
slice, and the other coordinates discard pairs one after the other. Each meeting yields a spanning forest of its links,
never all pairs.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other. A null id is never the
smallest; a group of null ids only has a null component. Repeated rows come back as often as they came. An empty table
gives an empty result. Only the two named columns are read; ``drop_near_duplicates`` keeps all columns.

Scale: texts are read once and never shuffled; from then on rows are some 40 bytes. A finer key shared by more than ``hot``
fingerprints is cut into chunks, and pairs of chunks are handled by separate tasks. Components come from alternating
large-star and small-star passes over written edges, never from links on the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import packed, small_batches, stash, unpacked

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits, unsigned."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return h64(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    hashes = [h64(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: id, __hash (of the text) and __fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("__hash", T.LongType()), T.StructField("__fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=out.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"), F.xxhash64(F.col(text_col)).alias("__h")).mapInArrow(run, out)


def block_masks(radius: int, extra: int = 3) -> list[int]:
    """Masks of every choice of `extra` from radius + extra blocks: two fingerprints within the radius agree on one at least."""
    n = radius + extra
    cuts = [round(64 * i / n) for i in range(n + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(x) for x in itertools.combinations(one, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: np.ndarray, pivots: int) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    refs = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(pivots)], np.uint64)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)


def forest(fps: np.ndarray, coords: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of links that span each component of one meeting. Rows are kept in the order of the first coordinate, so
    that partners are a slice; each further coordinate discards pairs before the fingerprints are compared."""
    rest, queue, links = np.argsort(coords[:, 0], kind="stable"), [], []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        i = queue.pop()
        first = coords[rest, 0]
        lo, hi = np.searchsorted(first, coords[i, 0] - radius), np.searchsorted(first, coords[i, 0] + radius, side="right")
        at = np.arange(lo, hi)
        for k in range(1, coords.shape[1]):
            if len(at) < 8:
                break
            at = at[np.abs(coords[rest[at], k] - coords[i, k]) <= radius]
        at = at[np.bitwise_count(fps[rest[at]] ^ fps[i]) <= radius]
        if len(at):
            found = rest[at].tolist()
            links += [(i, j) for j in found]
            queue += found
            rest = np.delete(rest, at)
    return links


def with_pivots(reps: DataFrame, pivots: int) -> DataFrame:
    """reps (__fp, ...) with __pivots, one byte for each reference fingerprint: the pivot table, written once."""
    out = T.StructType([*reps.schema.fields, T.StructField("__pivots", T.BinaryType())])
    at = reps.columns.index("__fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(at).to_numpy().view(np.uint64), pivots).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=out.names)

    return stash(reps.mapInArrow(run, out), "pivots")


def meetings(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and the positions at which a meeting starts, from rows sorted by the first `keys` columns: whole meetings."""
    left: list[np.ndarray] | None = None
    for batch in itertools.chain(batches, [None]):
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
        if left is not None:
            cols = left if cols is None else [np.concatenate(x) for x in zip(left, cols)]
        if cols is None or not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if batch is not None:  # the last meeting may go on in the next batch
            left, cols = [c[starts[-1] :] for c in cols], [c[: starts[-1]] for c in cols]
            starts = starts[:-1]
        if len(starts):
            yield cols, starts


def rows_of_bytes(column: np.ndarray, kind: type) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    return np.frombuffer(b"".join(column.tolist()), kind).reshape(len(column), -1)


def dealt(rows: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """Rows (keys, __fp, c, ...) with chunks a <= b in the place of c: keys of more than `hot` rows are cut into chunks,
    and each pair of chunks is a meeting of its own."""
    rest = [c for c in rows.columns if c not in (*keys, "c")]
    n = rows.withColumn("n", F.ceil(F.col("c") / hot).cast("int")).withColumn("x", F.pmod(F.xxhash64("__fp"), F.col("n")).cast("int"))
    n = n.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"), *rest)
    return n.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *rest)


def finer_masks(radius: int) -> list[list[int]]:
    """For each of block_masks, masks of the bits outside of it: its blocks in halves, every choice of `radius` halves. Two
    fingerprints within the radius that agree on the block mask agree on one of these at least."""
    out = []
    for mask in block_masks(radius):
        halves, at = [], 0
        while at < 64:
            upto = at
            while upto < 64 and mask >> upto & 1 == mask >> at & 1:
                upto += 1
            if not mask >> at & 1:  # blocks side by side are cut again at the places of blocks
                cuts = sorted({at, upto, *(x for x in (round(64 * i / (radius + 3)) for i in range(radius + 4)) if at < x < upto)})
                for a, b in itertools.pairwise(cuts):
                    half = (a + b) // 2
                    halves += [((1 << half) - 1) ^ ((1 << a) - 1), ((1 << b) - 1) ^ ((1 << half) - 1)]
            at = upto
        out.append([sum(x) for x in itertools.combinations(halves, radius)])
    return out


def _masked(masks: Column, name: str) -> Column:
    """For each mask its number and the fingerprint under it."""
    return F.explode(F.transform(masks, lambda x, i: F.struct(i.alias("t"), F.col("__fp").bitwiseAND(x).alias("m")))).alias(name)


def _longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(x)) for x in masks])


def links(reps: DataFrame, radius: int = 3, pivots: int = 16, hot: int = 2048) -> DataFrame:
    """Links (a < b, unsigned order not implied) between distinct fingerprints __fp that keep every component together."""
    table = with_pivots(reps.select("__fp"), pivots)
    keyed = table.select("__fp", _masked(_longs(block_masks(radius)), "k")).select("__fp", "k.t", "k.m")
    shared = stash(keyed.groupBy("t", "m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    met = stash(keyed.join(shared, ["t", "m"]), "met")
    keys = ["t", "m", "t2", "m2"]
    calm = met.where(F.col("c") <= hot).withColumns({"t2": F.lit(0), "m2": F.lit(0).cast("bigint")}).select(*keys, "c", "__fp")
    if not (busy := met.where(F.col("c") > hot)).isEmpty():
        # a key that many fingerprints share has keys of its own, from the other bits
        finer = F.element_at(F.array(*map(_longs, finer_masks(radius))), F.col("t") + 1)
        busy = busy.select("__fp", "t", "m", _masked(finer, "k")).select("__fp", "t", "m", (F.col("k.t") + 1).alias("t2"), F.col("k.m").alias("m2"))
        again = busy.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        calm = calm.union(busy.join(again, keys).select(*keys, "c", "__fp"))
    met = calm.join(table, "__fp").select(*keys, "c", "__fp", "__pivots")
    met = dealt(met, keys, hot).repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in meetings(batches, 6):
            fps, coords = cols[6].view(np.uint64), rows_of_bytes(cols[7], np.uint8).astype(np.int16)
            sizes = np.diff([*starts, len(fps)])
            two = starts[sizes == 2]
            two = two[(np.abs(coords[two] - coords[two + 1]) <= radius).all(axis=1)]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b = [cols[6][two]], [cols[6][two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = forest(fps[s : s + n], coords[s : s + n], radius)
                if found:
                    i, j = np.array(found).T
                    a.append(cols[6][s + i])
                    b.append(cols[6][s + j])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=out.names)

    return met.mapInArrow(run, out).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have edges (a, b); alternating star passes."""
    now, seen = stash(edges.select("a", "b").where("a <> b"), "edges"), None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("l").alias("b")).where("a <> b").distinct()
        # now a > b everywhere: each node points to smaller ones
        low = large.groupBy("a").agg(F.min("b").alias("l"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("l").alias("b")).where("a <> b").union(low.select("a", F.col("l").alias("b"))).distinct()
        now = stash(small, "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, pivots: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, __hash of the text, __fp) and, for each fingerprint, its root and the smallest id of its group."""
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = stash(rows.groupBy("__fp").agg(F.min(id_col).alias("__rep")), "reps")
    groups = components(links(reps, radius, pivots, hot))
    of = reps.join(groups.withColumnRenamed("node", "__fp"), "__fp", "left").select("__fp", "__rep", F.coalesce("root", "__fp").alias("__root"))
    least = of.groupBy("__root").agg(F.min("__rep").alias("component_id"))
    return rows, of.join(least, "__root").select("__fp", "__root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, pivots: int = 16, hot: int = 2048) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id (the smallest id of its group)."""
    rows, of = _grouped(docs, id_col, text_col, shingle, radius, pivots, hot)
    return rows.join(of, "__fp").select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, pivots: int = 16, hot: int = 2048) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id (null last; ties: any one of them)."""
    rows, of = _grouped(docs, id_col, text_col, shingle, radius, pivots, hot)
    return first_of_groups(docs, rows, of, id_col, text_col)


def small_or_all(written: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table of ids and hashes, to be broadcast if it has been counted to have at most `most` rows."""
    return F.broadcast(written) if written.count() <= most else written


def first_of_groups(docs: DataFrame, rows: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The document of the smallest id of each __root, from rows (id, __hash, __fp) and of (__fp, __root).

    Rows are dealt by id and text only, and repeats of one are counted before; a fingerprint that many rows share is one row
    with its smallest id, from partial minima, before it meets its root. So no task reads all copies of a text.
    """
    each = stash(rows.withColumnRenamed(id_col, "__id").groupBy("__id", "__hash", "__fp").agg(F.count(F.lit(1)).alias("__n")), "rows")
    first = F.min(F.struct(F.col("__id").isNull().alias("x"), F.col("__id"), F.col("__hash"), F.col("__n"))).alias("f")
    keep = each.groupBy("__fp").agg(first).join(of, "__fp").groupBy("__root").agg(F.min("f").alias("f"))
    keep = stash(keep.select("__root", F.col("f.__id").alias("__k"), F.col("f.__hash").alias("__kh"), F.col("f.__n").alias("__kn")), "kept")
    chosen = F.col("__id").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__kh"))
    gone = stash(each.join(keep.where("__kn = 1"), chosen, "left_anti").select("__id", "__hash"), "dropped")
    whole = packed(docs, __i=id_col, __h=F.xxhash64(text_col))
    same = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    out = unpacked(whole.join(small_or_all(gone), same, "left_anti"), docs)
    several = stash(keep.where("__kn > 1").select(F.col("__k").alias("__id"), F.col("__kh").alias("__hash")), "repeated")
    if not several.isEmpty():  # rows with the same id and text: one of them
        out = out.union(unpacked(whole.join(small_or_all(several), same).dropDuplicates(["__id", "__hash"]), docs))
    return out
