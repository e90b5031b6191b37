"""Columns named like internal ones, repeated rows, null and long ids, ties, empty tables, for each operator that keeps columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from defeasor.llm import decontaminate, line_dedup, mixing, near_copies, quality, secrets, shards, simhash, token_counts, toxicity

NAMES = """__row __id __i __h __hash __n __t __text __gone __own __key __k1 __k2 __bucket __at __p __start __offset __size __s __g __source __take __taken __all
__chunk __part __first __root __fp __rep __keys __sig __set __pivots __head __zero key mark a b c t m n x y h w id uid found size_ text_hash item value count""".split()
CLASH = [c for c in NAMES if c not in ("__row_",)]


def make(spark, rows):
    """rows (doc_id, text, source) with a column of each name, whose values tell the row and the name."""
    schema = "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[f"{c}|{i}" for c in CLASH]) for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choice("red green blue one two three four five six seven".split()) + str(rng.randint(0, 99)) for _ in range(k))
    out = [(f"{i:03d}" + "x" * 40, say(40) + "\nthe same line", rng.choice(["a", "b", None])) for i in range(40)]
    return out + [out[3]] * 30 + [(None, say(30), "a"), (None, None, "b"), ("e", "", "b"), ("long", say(30_000), "a")]


def checked(df, docs, *, texts=True):
    assert df.columns[: len(docs.columns)] == docs.columns
    got = df.collect()
    for r in got:
        assert all(r[c] == f"{c}|{r['doc_id']}" for c in CLASH)
    return got


def test_clashes_and_repeats(spark, rows):
    docs = make(spark, rows).repartition(3)
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    ids = Counter(i for i, _, _ in rows)
    for most in (1 << 24, 1):
        got = checked(decontaminate.decontaminate(docs, bench, most_bytes=most), docs)
        assert Counter(r["doc_id"] for r in got) == ids - Counter({rows[5][0]: 1})
    for f in (simhash.drop_near_duplicates, near_copies.drop_near_copies):
        got = checked(f(docs), docs)
        assert Counter(r["doc_id"] for r in got)[rows[3][0]] == 1 and len(got) <= len(set(rows))
    for most in (1 << 20, 0):
        got = checked(line_dedup.drop_repeated_lines(docs, block_keys=most), docs)
        assert len(got) == len(rows) and not any("the same line" in (r["text"] or "") for r in got)
        got = checked(line_dedup.drop_repeated_lines(docs, keep_first=True, block_keys=most), docs)
        assert len(got) == len(rows) and [r["doc_id"] for r in got if "the same line" in (r["text"] or "")] == [rows[0][0]]
    got = checked(shards.shard_rows(docs, n_shards=5), docs)
    assert Counter(r["doc_id"] for r in got) == ids
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((p % 5, p // 5) for p in range(len(rows)))
    mixed = checked(mixing.mix(docs), docs)
    taken = Counter()
    for r in mixing.mix_report(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
    assert +words == +taken
    model = toxicity.train(docs, spark.createDataFrame([(rows[0][0], 1), (rows[1][0], 0)], "doc_id string, toxic int"))
    checked(toxicity.drop_toxic(docs, model), docs)


def slow_shards(docs, n_shards, seed=20240229):
    """The permutation by its definition, on the numbers that the operator gives."""

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
        return x ^ (x >> 32)

    first, second = shards.row_keys(docs)
    keyed = docs.select(first.alias("__k1"), second.alias("__k2"))
    numbers, n = shards.numbers_of(keyed)
    half = max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2))
    out = []
    for r in numbers.collect():
        for x in range(r["__start"], r["__start"] + r["__n"]):
            while True:
                left, right = x >> half, x % 2**half
                for k in range(6):
                    left, right = right, left ^ (mix(right, (seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % 2**64) % 2**half)
                x = left << half | right
                if x < n:
                    break
            out.append((r["__k1"], r["__k2"], x % n_shards, x // n_shards))
    return sorted(out)


def test_shards_against_the_definition(spark, rows):
    docs = make(spark, rows).select("doc_id", "text")
    sized = shards.sized(docs)
    placed = shards.shard_rows(docs, n_shards=7)
    first, second = shards.row_keys(placed.select(*sized.columns))
    assert sorted(map(tuple, placed.select(first, second, "shard", "slot").collect())) == slow_shards(sized, 7)
    numbers, n = shards.numbers_of(sized.select(first.alias("__k1"), second.alias("__k2")))
    assert sorted(x for r in numbers.collect() for x in range(r["__start"], r["__start"] + r["__n"])) == list(range(n))


def test_reports_of_odd_rows(spark, rows):
    """Null ids, long texts, repeated rows and ties come back row by row."""
    docs = make(spark, rows)
    ids = Counter(i for i, _, _ in rows)
    found = secrets.secret_report(docs), quality.quality_report(docs, spark.createDataFrame([], "doc_id string, quality int"))[0], line_dedup.line_report(docs), mixing.mix_report(docs), simhash.near_duplicates(docs)
    for df in found:
        assert Counter(r["doc_id"] for r in df.select("doc_id").collect()) == ids


def test_warm_cache_moves_no_text(spark, rows, tmp_path):
    import public_tokenizers

    docs, path, cache = make(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = token_counts.count_tokens(docs, path, cache_path=cache)
    n = spark.read.parquet(cache).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("warm", "warm cache")
    try:
        again = token_counts.count_tokens(docs, path, cache_path=cache)
        plans = [s.name for j in tracker.getJobIdsForGroup("warm") for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plans and spark.read.parquet(cache).count() == n
    assert "mapInArrow" not in again._jdf.queryExecution().toString()
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    few = docs.unionByName(docs.limit(1).withColumn("text", token_counts.F.lit("a new text")))
    for most in (1 << 20, 0):  # misses found by a broadcast, and by a join
        token_counts.count_tokens(few, path, cache_path=cache, most_broadcast=most)
        assert spark.read.parquet(cache).count() == n + 1


def test_stages_on_odd_tables(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, size string"
    docs = spark.createDataFrame([(i if i % 9 else None, t, "en", s, len(t or ""), f"r{i}", "s") for i, (_, t, s) in enumerate(rows)], schema)
    spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        n = None
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, str(tmp_path))
            kept = [c for c in some.columns if c not in shards.ADDED] if name == "sharding" else some.columns
            assert out.columns[: len(kept)] == kept
            n = out.count()
        assert n or some is not docs
