r"""Secret scans in DataFrame operations only: fixed patterns plus a battery of randomness tests.

Base spans (kinds assign, access, hex) are the matches of three patterns, leftmost and without overlap for each kind;
matches that are too short are dropped. Offsets are code points: a text is cut at the matches, and the lengths of cuts
and matches are summed up in blocks, so that many matches cost no quadratic time.

Candidates of the method are runs of 20 or more characters of [A-Za-z0-9+/_-], with up to two of = after them. The
encoding is inferred (hex, base32, base64) and gives the alphabet. Three tests are computed from the positions of the
characters in the alphabet: chi-squared for uniformity (Wilson-Hilferty), runs above and below the middle, and lag-1 serial
correlation. A candidate counts as random only if none of the three rejects randomness at ``accept``.

The discovery itself is tested against ordinary text. Candidates fall into at most 14 strata by their encoding and the
classes of characters they have (capital, small, digit). For each stratum the law of text is learned from the corpus: over
the candidates that the battery rejects, the excess of chi-squared a character and the share of neighbours of different
classes, with their spread between strings. A candidate's two deviations from that law, each scaled by what its length
lets expect, are added up to one z, and p = P(z as large | text). Benjamini-Hochberg over all candidates of a stratum in
the corpus, on a histogram of p with a fixed number of bins, holds the share of false discoveries below ``fdr`` in each.
Discoveries are spans of kind random. Candidates inside of a base span are tested like others, but not reported twice.

Edge cases: a stratum with fewer than ``LEAST`` rejected candidates uses its encoding's law in ``TEXT_LAW``; null and empty texts have no spans; repeated rows are scanned each for itself; spans of one start are in the
order of the kinds; an empty table gives an empty result; only the named columns are read.

Scale: one scan of the texts writes the few spans and candidates; the second pass reads those only. The histogram has at
most 14 * ``BINS`` rows. Nothing is shuffled but the histogram.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stash

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
#: Alphabets in the order of their encodings.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: By encoding, of ordinary text: the excess of chi-squared a character and its spread, the share of neighbours of different
#: classes and its spread.
TEXT_LAW = {"hex": (0.6, 0.3, 0.1, 0.1), "base32": (1.1, 0.5, 0.05, 0.05), "base64": (3.2, 1.0, 0.12, 0.08)}
#: Candidates of an encoding from which a law of its own is learned, and the least spread it may have.
LEAST, SPREAD = 30, 0.03
BINS = 4096
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _upto(n: Column) -> Column:
    """0 .. n-1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ends(lengths: Column) -> Column:
    """Running sums of an array column, in blocks."""
    def whole(v: Column) -> Column:
        blocks = F.transform(_upto(F.ceil(F.size(v) / BLOCK).cast("int")), lambda b: _sum(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        def with_blocks(bs: Column) -> Column:
            starts = F.transform(_upto(F.size(bs)), lambda b: _sum(F.slice(bs, F.lit(1), b)))
            return let(starts, lambda s: F.transform(_upto(F.size(v)), lambda i: F.get(s, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))
        return let(blocks, with_blocks)
    return let(lengths, whole)


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches."""
    def zipped(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: (F.length(g) + F.length(f)).cast("bigint"))
        return F.zip_with(ends(lengths), found, lambda e, f: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("found")))
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(text.rlike(pattern), let(both, zipped)).otherwise(none)


def _spans(found: Column, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(found, keep) if keep else found
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def _normal_tail(z: Column) -> Column:
    """P(Z > z): a logistic form of the normal tail, good to 0.0002 in the middle, with the true order far out."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(found: Column) -> Column:
    """struct<enc, stratum, n, chi2, changes, p_uniform, p_runs, p_serial> of one candidate of 20 or more characters."""
    enc = F.when(found.rlike("^[0-9a-fA-F]+$"), F.lit("hex")).when(found.rlike("^[A-Z2-7]+=*$"), F.lit("base32")).otherwise(F.lit("base64"))

    def tests(v: Column) -> Column:
        alphabet = F.when(v["enc"] == "hex", ALPHABETS["hex"]).when(v["enc"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        plain = F.translate(F.rtrim(v["s"], F.lit("=")), "-_", "+/")
        plain = F.when(v["enc"] == "hex", F.lower(plain)).otherwise(plain)
        return let(F.struct(v["enc"].alias("enc"), alphabet.alias("alphabet"), plain.alias("s")), lambda u: let(F.struct(u["enc"].alias("enc"), u["s"].alias("s"), F.length(u["alphabet"]).cast("double").alias("k"), F.transform(F.split(u["s"], ""), lambda c: (F.instr(u["alphabet"], c) - 1).cast("double")).alias("x")), numbers))

    def numbers(v: Column) -> Column:
        n, k, x = F.length(v["s"]).cast("double"), v["k"], v["x"]
        squares = F.aggregate(F.array_distinct(F.split(v["s"], "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(v["s"], c, F.lit(""))), F.lit(2.0)))
        mean = F.aggregate(x, F.lit(0.0), lambda a, c: a + c) / n
        high = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.when(c > (k - 1) / 2, 1.0).otherwise(0.0))
        pairs = F.sequence(F.lit(1), F.size(x) - 1)
        turns = F.aggregate(pairs, F.lit(1.0), lambda a, i: a + F.when((F.get(x, i) > (k - 1) / 2) != (F.get(x, i - 1) > (k - 1) / 2), 1.0).otherwise(0.0))
        step = lambda c, at: F.when(c >= at, 1).otherwise(0)
        kind = lambda c: F.when(v["enc"] == "hex", step(c, 10)).when(v["enc"] == "base32", step(c, 26)).otherwise(step(c, 26) + step(c, 52) + step(c, 62))
        changes = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when(kind(F.get(x, i)) != kind(F.get(x, i - 1)), 1.0).otherwise(0.0))
        has = lambda cls, mark: F.when(v["s"].rlike(cls), mark).otherwise("")
        stratum = F.concat(v["enc"], F.lit(" "), has("[A-Z]", "u"), has("[a-z]", "l"), has("[0-9]", "d"))
        return let(F.struct(v["enc"].alias("enc"), stratum.alias("stratum"), n.alias("n"), k.alias("k"), x.alias("x"), (k / n * squares - n).alias("chi2"), mean.alias("mean"), high.alias("high"), turns.alias("runs"), changes.alias("changes")), p_values)

    def p_values(v: Column) -> Column:
        n, df, x = v["n"], v["k"] - 1, v["x"]
        z_chi = (F.pow(F.greatest(v["chi2"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean_runs = 2 * v["high"] * (n - v["high"]) / n + 1
        var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
        z_runs = (v["runs"] - mean_runs) / F.sqrt(var_runs)
        spread = F.aggregate(x, F.lit(0.0), lambda a, c: a + (c - v["mean"]) * (c - v["mean"]))
        lag = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (F.get(x, i) - v["mean"]) * (F.get(x, i - 1) - v["mean"]))
        z_serial = F.when(spread > 0, (lag / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.struct(v["enc"].alias("enc"), v["stratum"].alias("stratum"), n.cast("int").alias("n"), v["chi2"].alias("chi2"), v["changes"].alias("changes"), _normal_tail(z_chi).alias("p_uniform"), (2 * _normal_tail(F.abs(z_runs))).alias("p_runs"), (2 * _normal_tail(F.abs(z_serial))).alias("p_serial"))

    return let(F.struct(enc.alias("enc"), found.alias("s")), tests)


Law = dict[str, tuple[float, float, float, float]]


def _df(t: Column) -> Column:
    return F.when(t["enc"] == "hex", 15.0).when(t["enc"] == "base32", 31.0).otherwise(63.0)


def _by_stratum(t: Column, values: dict[str, float], otherwise: Column) -> Column:
    out = None
    for name, x in sorted(values.items()):
        out = F.when(t["stratum"] == name, F.lit(x)) if out is None else out.when(t["stratum"] == name, F.lit(x))
    return otherwise if out is None else out.otherwise(otherwise)


def text_law(rows: DataFrame, accept: float) -> Law:
    """The law of ordinary text for strata with enough of it, from the candidates that the battery rejects."""
    c = rows.select(F.explode("__cands.t").alias("t")).where(~random_like(F.col("t"), accept)).select("t", ((F.col("t.chi2") - _df(F.col("t"))) / F.col("t.n")).alias("e"), (F.col("t.changes") / (F.col("t.n") - 1)).alias("q"))
    found = c.groupBy("t.stratum").agg(F.count(F.lit(1)), F.avg("e"), F.stddev_samp("e"), F.avg("q"), F.stddev_samp("q")).collect()  # at most 14 rows
    return {name: (max(e, 0.1), max(se, SPREAD), min(max(q, 0.01), 0.9), max(sq, SPREAD)) for name, n, e, se, q, sq in found if n >= LEAST}


def p_text(t: Column, law: Law) -> Column:
    """P(as far from text | text): two deviations, each with the variance of its count and that between strings."""
    known = lambda i: F.when(t["enc"] == "hex", TEXT_LAW["hex"][i]).when(t["enc"] == "base32", TEXT_LAW["base32"][i]).otherwise(TEXT_LAW["base64"][i])
    of = lambda i: _by_stratum(t, {name: x[i] for name, x in law.items()}, known(i))
    n, df, excess, q = t["n"].cast("double"), _df(t), of(0), of(2)
    z_chi = (df + n * excess - t["chi2"]) / F.sqrt(2 * df + 4 * n * excess + F.pow(n * of(1), F.lit(2.0)))
    z_mix = (t["changes"] - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q) + F.pow((n - 1) * of(3), F.lit(2.0)))
    return _normal_tail((z_chi + z_mix) / F.sqrt(F.lit(2.0)))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base (spans), cands (start, end, tests) and the text's candidates' encodings. Written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12
    found = docs.select(F.col(id_col), _spans(find(text, ASSIGN), "assign", value).alias("__a"), _spans(find(text, ACCESS), "access").alias("__k"), _spans(find(text, HEX), "hex").alias("__h"), find(text, CANDIDATE).alias("__c"))
    base = F.array_sort(F.concat("__a", "__k", "__h"))
    inside = lambda c: F.exists(F.col("__base"), lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    rows = found.withColumn("__base", base)
    rows = rows.withColumn("__cands", F.when(F.size("__c") > 0, F.transform("__c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), inside(c).alias("known"), battery(c["found"]).alias("t")))).otherwise(F.array()))
    return stash(rows.select(id_col, F.size("__a").cast("long").alias("n_assign"), F.size("__k").cast("long").alias("n_access"), F.size("__h").cast("long").alias("n_hex"), F.col("__base").cast(SPAN).alias("__base"), "__cands"), "spans")


def thresholds(rows: DataFrame, law: Law, fdr: float, accept: float) -> dict[str, float]:
    """For each stratum the largest p that Benjamini-Hochberg admits (by the upper edges of its bins), if any."""
    p = rows.select(F.explode("__cands.t").alias("t")).select("t.stratum", p_text(F.col("t"), law).alias("p"), random_like(F.col("t"), accept).alias("r"))
    bin_of = F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * 100)).cast("int")
    bins = p.groupBy("stratum", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("all"), F.count_if("r").alias("n")).collect()  # 14 * BINS rows at most
    out: dict[str, float] = {}
    for name in {b["stratum"] for b in bins}:
        mine = sorted((b for b in bins if b["stratum"] == name), key=lambda b: -b["bin"])
        total, rank = sum(b["all"] for b in mine), 0
        for b in mine:
            rank += b["n"]
            edge = 10 ** (-b["bin"] / 100)
            if b["n"] and edge <= fdr * rank / total:
                out[name] = edge
    return out


def random_like(t: Column, accept: float) -> Column:
    return (t["p_uniform"] >= accept) & (t["p_runs"] >= accept) & (t["p_serial"] >= accept)


def _text_of(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, accept: float = 0.001) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base (string), spans (string), span_list (kind, start, end)."""
    rows = scan(docs, id_col=id_col, text_col=text_col)
    law = text_law(rows, accept)
    most = thresholds(rows, law, fdr, accept)
    hit = F.filter("__cands", lambda c: ~c["known"] & random_like(c["t"], accept) & (p_text(c["t"], law) <= _by_stratum(c["t"], most, F.lit(-1.0))))
    random = F.transform(hit, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end"))).cast(SPAN)
    every = F.array_sort(F.concat("__base", random))
    listed = F.transform(every, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(id_col, "n_assign", "n_access", "n_hex", _text_of(F.col("__base")).alias("base"), _text_of(every).alias("spans"), listed.alias("span_list"))
