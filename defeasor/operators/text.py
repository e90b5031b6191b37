"""Word models and sentence extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import pick, unit
from .generate import ids_of

# Parts of syllables.
ONSETS = ["b", "c", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "cr", "dr", "fr", "gr", "pr", "tr", "ch", "sh", "th"]
NUCLEI = ["a", "e", "i", "o", "u", "ou", "ie", "ea", "ae", "oo"]
CODAS = ["", "", "", "b", "d", "g", "k", "l", "m", "n", "p", "r", "s", "t", "x", "th", "nt", "st"]


def phonotactic_words(spark: SparkSession, n: int | DataFrame, seed: int = 42) -> DataFrame:
    """Invented words of two or three syllables (0.8 to 0.2)."""
    part = lambda i: F.concat(*[pick(x, f"{name}{i}", "id", seed=seed) for name, x in (("on", ONSETS), ("nu", NUCLEI), ("co", CODAS))])
    third = F.when(unit("three", "id", seed=seed) < F.lit(0.2), part(2)).otherwise("")
    return ids_of(spark, n).select("id", F.concat(part(0), part(1), third).alias("word"))


def alphabetic_tokens(text: Column) -> Column:
    """Lower-cased runs of letters a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def markov_transitions(words: DataFrame, order: int = 2) -> DataFrame:
    """state, next and n over ^word$. Aggregates on the map side, so the number of states bounds the shuffle."""
    w = words.select(F.concat(F.lit("^"), F.col("word"), F.lit("$")).alias("w")).where(F.length("w") > order)
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - order)).alias("i"))
    return at.groupBy(F.substring("w", F.col("i"), F.lit(order)).alias("state"), F.substring("w", F.col("i") + order, F.lit(1)).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def valid_nonce(word: Column, least: int = 4, most: int = 10, consonants: int = 3) -> Column:
    """Length, letters only, no letter three times in a row, no long run of consonants."""
    runs = f"[^aeiouyAEIOUY]{{{consonants + 1},}}"
    return F.length(word).between(least, most) & word.rlike("^[A-Za-z]+$") & ~word.rlike(r"(.)\1{2,}") & ~word.rlike(runs)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" ")))), lambda s: s != "")


def extract(sentence: Column) -> Column:
    """struct(kind, subject, value) of a sentence's words. If it has no signs but hyphens and an inner word is the verb "is" or
    "are", the words before the first such verb are the subject and those after it the value, each without a leading article;
    else the first word is the subject, if it has no signs, and the rest the property."""
    words = F.split(F.trim(sentence), r"\s+")
    verb = F.array_position(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.lower(w).isin("is", "are")), True).cast("int")
    bare = lambda part: F.array_join(F.when((F.size(part) > 1) & F.lower(F.get(part, F.lit(0))).isin("a", "an"), F.slice(part, F.lit(2), F.size(part))).otherwise(part), " ")
    plain = lambda text: ~text.rlike(r"[^\w\s-]")
    isa = (verb > 0) & plain(sentence)
    prop = (F.size(words) > 1) & plain(F.get(words, F.lit(0)))
    subject = F.when(isa, bare(F.slice(words, F.lit(1), verb))).when(prop, F.get(words, F.lit(0)))
    value = F.when(isa, bare(F.slice(words, verb + 2, F.size(words)))).when(prop, F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
    return F.struct(F.when(isa, "isa").when(prop, "property").alias("kind"), F.coalesce(subject, F.lit("")).alias("subject"), F.coalesce(value, F.lit("")).alias("value"))


def split_first_turn(content: Column, mark: str = "Question:") -> tuple[Column, Column]:
    """(prefix without trailing blanks, suffix from the mark on); all and '' if there is no mark."""
    at = F.instr(content, mark)
    return F.when(at > 0, F.rtrim(F.substring(content, F.lit(1), at - 1))).otherwise(content), F.when(at > 0, F.substring(content, at, F.length(content))).otherwise("")


def url_concept(url: Column) -> Column:
    """The first part of the path after the language, or of the path."""
    return F.regexp_extract(url, r"^https?://[^/]+/(?:[a-z]{2}/)?([^/?#]*)", 1)


def compounds(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct words of capitalised parts, joined by blanks; a row with a missing or empty part makes none."""
    whole = parts.where(F.forall(F.array(*columns), lambda p: p.isNotNull() & (p != "")))
    return whole.select(F.concat_ws(" ", *[F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))) for c in columns]).alias("word")).distinct()
