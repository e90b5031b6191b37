r"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of a text (words, characters in words, symbols, repeated lines, words in repeated 3-word windows, capitals,
exclamation marks) are computed with built-in functions. From labelled rows a decision list is learned by sequential
covering: a rule starts empty and grows by the threshold condition of the best FOIL gain; then conditions are pruned from
its end while that does not lower (p - n) / (p + n) on rows set aside for pruning; it is accepted if its precision there
is high enough; rows it covers are taken out, and the next rule is learned. Counting is done by Spark: each step is one
aggregation by feature and bin, of a size that the number of features and thresholds bounds. The list is emitted as one
ordered CASE WHEN expression.

Edge cases: null and empty texts have no words and fail the base rule; without labelled rows of both kinds there are no
rules and the base rule alone decides; ratios of wordless texts are 0; repeated rows are judged alike; an empty table
gives an empty result. Only the named columns are read; ``apply_rules`` on other frames needs the statistics' columns.

Scale: texts are read once and not shuffled; learning uses at most ``max_rows`` labelled rows of each label, those of
the smallest hash of the id, and holds numbers only. The statistics cost n log n in a text's words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import SPACE, stash, words

#: Feature columns in order; all are at least 0.
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_capitals", "f_exclaim")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words in n-word windows that are found twice or more in the array w."""
    windows = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    def spread(h: Column) -> Column:
        def covered(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) & (i > 0) | (F.get(s, i + 1)["h"] == x["h"]) & (i + 1 < F.size(s)))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0).cast("bigint"), lambda a, x: a + x))
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(paired, covered))

    return let(windows, spread)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lacks = lambda cls: (F.length(text) - F.length(F.regexp_replace(text, cls, ""))).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    both = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r")))
    rows = docs.select(F.col(id_col), both.alias("__w"), lacks(f"[^{SPACE}]+").alias("word_chars"), lacks(r"[#*$%&|<>]+").alias("n_symbols"), let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d"))).alias("__l"), lacks(r"\p{Lu}+").alias("__upper"), lacks("!+").alias("__bang"))
    n = F.greatest(F.col("__w.n"), F.lit(1))
    per = lambda x, d: F.col(x).cast("double") / d
    return rows.select(
        id_col, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", F.col("__l.d").alias("n_dup_lines"), F.col("__w.r").alias("n_repeat_words"),
        F.col("__w.n").cast("double").alias("f_words"), per("word_chars", n).alias("f_word_length"), per("n_symbols", n).alias("f_symbols"), per("__l.d", F.greatest(F.col("__l.n"), F.lit(1))).alias("f_dup_lines"),
        per("__w.r", n).alias("f_repeats"), per("__upper", F.greatest("word_chars", F.lit(1))).alias("f_capitals"), per("__bang", n).alias("f_exclaim"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > bound, else value <= bound
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list fires: an ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(holds(rule), F.lit(False)) if out is None else out.when(holds(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(labelled: DataFrame, *, label_col: str = "__y", key_col: str = "__key", n_bins: int = 24, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules that say "bad" (label 0), from rows with the features, a label and a long key that splits growing (2 of 3) from pruning."""
    cuts = [i / n_bins for i in range(1, n_bins)]
    by_label = labelled.groupBy(label_col).agg(*[F.percentile_approx(f, cuts, 10000).alias(f) for f in FEATURES]).collect()  # two rows
    if {r[label_col] for r in by_label} != {0, 1}:
        return []
    bounds = {f: sorted({x for r in by_label for x in r[f]}) for f in FEATURES}
    bin_of = lambda f: sum((F.when(F.col(f) > x, 1).otherwise(0) for x in bounds[f]), F.lit(0))  # noqa: E731  how many bounds a value is above
    rows = stash(labelled.select(F.col(label_col).cast("int").alias("y"), (F.pmod(key_col, F.lit(3)) < 2).alias("grow"), *FEATURES, *[bin_of(f).alias(f"b_{f}") for f in FEATURES]), "labelled")
    rules: list[Rule] = []

    def counts(rule: Rule) -> tuple[dict, dict]:
        """On rows that no earlier rule covers: (feature, bin) -> [bad, good] for growing, and the rule's bad and good by set."""
        left = rows
        for r in rules:
            left = left.where(~holds(r))
        left = left.where(holds(rule)) if rule else left
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{f}").alias("b")) for i, f in enumerate(FEATURES)])).alias("p")
        got = left.select("y", "grow", pairs).groupBy("grow", "y", "p.f", "p.b").count().collect()  # at most 4 x features x bins rows
        cells, sets = {}, {True: [0, 0], False: [0, 0]}
        for grow, y, f, b, n in got:
            if grow:
                cells.setdefault((f, b), [0, 0])[y] += n
            if f == 0:
                sets[grow][y] += n
        return cells, sets

    while len(rules) < max_rules:
        rule: Rule = ()
        path: list[tuple[Rule, list[int]]] = []  # each prefix with its bad and good rows for pruning
        cells, sets = counts(rule)
        while sets[True][0] >= min_covered:
            path.append((rule, sets[False]))
            bad, good = sets[True]
            if len(rule) >= max_conditions or not good:
                break
            best, choice = 0.0, None
            for i, f in enumerate(FEATURES):
                low = [0, 0]
                for b, bound in enumerate(bounds[f]):
                    low = [low[y] + cells.get((i, b), [0, 0])[y] for y in (0, 1)]
                    for above, (p, n) in ((False, low), (True, [bad - low[0], good - low[1]])):
                        if p >= min_covered and (gain := p * (log2(p / (p + n)) - log2(bad / (bad + good)))) > best + 1e-9:
                            best, choice = gain, Condition(f, above, float(bound))
            if choice is None:
                break
            rule = (*rule, choice)
            cells, sets = counts(rule)
        worth = lambda pn: (pn[0] - pn[1]) / max(1, sum(pn))
        tried = [x for x in path if x[0]]
        if not tried:
            break
        top = max(worth(pn) for _, pn in tried)
        rule, (p, n) = next(x for x in tried if worth(x[1]) == top)  # the shortest of the best
        if p < 1 or p < min_precision * (p + n):
            break
        rules.append(rule)
    return rules


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20000, **options) -> tuple[DataFrame, list[Rule]]:
    """The statistics with base_failed and kept (False if base_failed, else the list's verdict), and the rules."""
    stats = stash(statistics(docs, id_col=id_col, text_col=text_col), "statistics").withColumn("base_failed", base_failed())
    seen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"))
    seen = stats.where("not base_failed").join(seen, F.col(id_col) == F.col("__id")).withColumn("__key", F.xxhash64(F.col("__id").cast("string")))
    part = lambda y: seen.where(F.col("__y") == y).select("__y", "__key", *FEATURES).orderBy("__key", *FEATURES).limit(max_rows)
    rules = learn(stash(part(0).union(part(1)), "sample"), **options)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
