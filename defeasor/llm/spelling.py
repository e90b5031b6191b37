"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of l code points is divided into halves of l // 2 and l - l // 2. An edit spares one of the halves, so a near word
of l or l + 1 code points has the first half at its start or the second one at its end (moved by one place if it is longer).
Each word is indexed under its two halves with its length, and probes the halves of words of its own length and of one
less. A key is thus (length, length of the known start, length of the known end, start, end), and what lies between is
open. Keys with more than ``hot`` rows are divided again: the open part has halves too, of which an edit spares one, so
each row goes on under two longer keys, until a key is small or one place is open. No pair is lost by that, and no group
of a common half meets as a whole. Where rows meet, the pair is verified by its edit distance, and pairs that met under
several keys are one.

The form of a word is its near word of the largest count (ties: the smallest in code-point order), if that count is at
least ``ratio`` times its own; its root is what following forms ends in. Counts at least double on the way, so the way is
short; it is followed by doubling.

Edge cases: null and empty texts have no words; null ids count as the empty text in whatever a caller derives from them;
repeated rows count each; empty tables give empty results. Texts and words may be of any length. Only the named columns
are read.

Scale: words are counted with partial sums before anything is shuffled, so a word that is very common costs a row for each
task. All steps are joins and aggregations of the vocabulary; a word has at most as many near words as there are edits of
it. Written tables cut the lineage between the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from .util import stash

#: Maximal runs of Latin letters (the two signs between them, too).
RUNS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): each run of each text, A-Z lower-cased; null ids as the empty text."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(RUNS), F.lit(0))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def with_slips(found: DataFrame, every: int = 97) -> Column:
    """The run; where `every` divides the crc32 h of <id>:<run>, without its code point h % length (from 0)."""
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))


def word_counts(words: DataFrame, *, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the distinct values of column word that are long and frequent enough."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, probe, l, p, s) with the start of p and the end of s code points."""
    return rows.select("word", "n", "probe", "l", "p", "s", F.expr("substring(word, 1, p)").alias("start"), F.expr("if(s = 0, '', right(word, s))").alias("end"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: half of what is open joins the known start or the known end."""
    left, right = F.expr("(l - p - s) div 2"), F.expr("(l - p - s) - (l - p - s) div 2")
    two = F.array(F.struct((F.col("p") + left).cast("int").alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + right).cast("int").alias("s")))
    return rows.select("word", "n", "probe", "l", F.explode(two).alias("two")).select("word", "n", "probe", "l", "two.p", "two.s")


KEY = ["l", "p", "s", "start", "end"]


def met_under_keys(words: DataFrame, hot: int = 256) -> DataFrame:
    """(word, n, probe, *KEY, c): rows under keys that c rows share; c is at most hot unless at most one place is open."""
    sides = F.explode(F.array(*[F.struct(F.lit(probe).alias("probe"), F.lit(d).alias("d")) for probe, d in ((False, 0), (True, 0), (True, 1))]))
    length = F.length("word")
    start = words.select("word", "n", sides.alias("side")).select("word", "n", "side.probe", (length - F.col("side.d")).cast("int").alias("l"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    now, done = _keyed(_halves(start.where("l > 0"))), []
    while True:
        # keys that only probes or only indexed words have meet nothing
        sizes = now.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.count_if("probe").alias("probes")).where("probes > 0 and probes < c")
        rows = stash(now.join(sizes.drop("probes"), KEY), "keyed")
        small = (F.col("c") <= hot) | (F.col("l") - F.col("p") - F.col("s") <= 1)
        done.append(rows.where(small))
        large = rows.where(~small)
        if large.isEmpty():
            break
        now = _keyed(_halves(large.drop("c", "start", "end")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def near_pairs(words: DataFrame, hot: int = 256) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words that differ by one inserted, deleted or replaced code point, in both directions."""
    rows = stash(met_under_keys(words, hot), "met")
    index = rows.where("not probe").select(*KEY, F.col("word").alias("b"), F.col("n").alias("n_b"))
    probes = rows.where("probe").select(*KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
    # of two words of one length each probes the other; they need to meet once
    order = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    once_each = probes.join(index, KEY).where(order & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()
    pairs = stash(once_each, "pairs")
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), words without a form left out; forms never lead back to their word."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(now.join(next_step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def variants(counted: DataFrame, *, ratio: int = 2, hot: int = 256) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n."""
    counted = stash(counted.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("b"))).alias("best")
    near = near_pairs(counted, hot).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    all_words = counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("f"))
    all_words = stash(all_words.select("word", "n", "n_near", F.col("f.b").alias("form"), (-F.col("f.m")).alias("form_n")), "forms")
    ends = roots(all_words.where("form is not null"))
    return all_words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slips_every: int | None = None, min_chars: int = 5, min_count: int = 3, ratio: int = 2, hot: int = 256) -> DataFrame:
    """Variants of the words of texts; slips_every: makes slips by a hash of the id and the run (for measuring)."""
    found = runs(docs, id_col=id_col, text_col=text_col)
    words = once(found, word=with_slips(found, slips_every)) if slips_every else found.withColumnRenamed("run", "word")
    return variants(word_counts(words, min_chars=min_chars, min_count=min_count), ratio=ratio, hot=hot)
