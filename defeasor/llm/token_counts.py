"""Token counts through a digest cache.

The content of a row is normalised (null becomes the empty text; nothing else, as the tokenizer sees every character) and
digested with SHA-256. The tokenizer has a version digest, that of its file and of the options used. Counts are stored in
a Parquet cache keyed by both digests: the digests of the rows are joined to it, only distinct misses are encoded, and their
counts are appended, so a second run over the same texts encodes nothing and moves no text.

Counts are those of the library with add_special_tokens off, special strings inside a text handled as the library's
default does, without truncation or padding.

Edge cases: null and empty texts have no bytes and no tokens; repeated texts are encoded once; an empty table leaves
the cache as it is; only the named columns are read. Texts may be of any length.

Scale: a first pass writes the digests; texts are shuffled only if they are misses (up to ``most_broadcast`` of them; beyond
that distinct texts meet the misses' digests in a join). Duplicates are removed on the map side before texts are dealt by
digest, so a text that a third of the rows share costs no task more than others; in the last join AQE can split it. Appends are whole files of finished tasks; a lost executor repeats its task only.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from tokenizers import Tokenizer

from .util import shared_path, small_batches, stash

CACHE = "content_sha256 string, tokenizer_sha256 string, n_tokens long"

_loaded: dict[str, Tokenizer] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|plain, no added specials, no truncation, no padding").hexdigest()


def load(definition: str) -> Tokenizer:
    """From the JSON text; built once in each Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_str(definition)
        t.no_truncation()
        t.no_padding()
        _loaded[key] = t
    return _loaded[key]


def counts(t: Tokenizer, texts: list[str]) -> list[int]:
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    return [len(e.ids) for i in range(0, len(texts), 64) for e in encode(texts[i : i + 64], add_special_tokens=False)]


def read_cache(spark, path: str, version: str) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # no cache there yet
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer_sha256") == version).select("content_sha256", "n_tokens").dropDuplicates(["content_sha256"])


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, most_broadcast: int = 1 << 20) -> DataFrame:
    """Per row: id, content_sha256, n_bytes, n_tokens, over_limit. cache_path: None for a cache that only this call uses.
    most_broadcast: the number of misses up to which their digests are broadcast."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    version, cache_path = tokenizer_version(tokenizer_path), cache_path or shared_path(spark, "token-cache")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # one file of some MB, whatever the input

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(text, 256).alias("content_sha256")
    narrow = stash(docs.select(F.col(id_col), digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache_path, version)
    cold = stored.isEmpty()
    need = narrow.select("content_sha256").distinct()
    need = stash(need if cold else need.join(stored, "content_sha256", "left_anti"), "misses")
    n_misses = need.count()
    texts = docs.select(digest, text.alias("__text"))
    if cold:
        misses = texts.dropDuplicates(["content_sha256"])
    elif n_misses <= most_broadcast:  # only texts of misses leave their task
        misses = texts.join(F.broadcast(need), "content_sha256", "left_semi").dropDuplicates(["content_sha256"])
    else:
        misses = texts.dropDuplicates(["content_sha256"]).join(need, "content_sha256", "left_semi")
    out = T.StructType([T.StructField("content_sha256", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(definition.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts(t, batch.column(1).to_pylist()), pa.int64())], names=out.names)

    if n_misses:
        misses.mapInArrow(run, out).select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens").write.mode("append").parquet(cache_path)
    # written, so that both sides of the join are dealt out by it and a text that very many rows share can be split
    found = stash(read_cache(spark, cache_path, version), "counts")
    return narrow.join(found, "content_sha256").select(F.col(id_col), "content_sha256", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
