"""Evaluation statistics over results (model, seed, topology, difficulty, depth, correct, cls, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.once import once
from ..functions.special import f_quantile, normal_tails

#: Six decimals, as oracles compare.
def r6(x: Column) -> Column:
    return F.round(x, 6)


def accuracy_pivot(results: DataFrame, topologies: list[str]) -> DataFrame:
    """Accuracy by model and topology, with the mean of a row over the cells that have a value."""
    p = results.groupBy("model").pivot("topology", topologies).agg(F.avg("correct"))
    cells = F.array_compact(F.array(*[F.col(t) for t in topologies]))
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)
    return p.select("model", *[r6(F.col(t)).alias(f"acc_{t}") for t in topologies], r6(mean).alias("row_mean"))


def depth_curve(results: DataFrame) -> DataFrame:
    """Mean and standard error of accuracy by model, topology and depth."""
    g = results.groupBy("model", "topology", "depth").agg(F.avg("correct").alias("m"), F.stddev_samp("correct").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("model", "topology", "depth", r6(F.col("m")).alias("mean_accuracy"), r6(F.col("s") / F.sqrt("n")).alias("sem_accuracy"), "n")


def fixed_bins(results: DataFrame, value: str, step: int) -> DataFrame:
    lo = (F.floor((F.col(value) - 1) / step) * step + 1).cast("int")
    return results.groupBy("model", lo.alias("lo")).agg(r6(F.avg("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def quantile_bins(results: DataFrame, value: str, n_bins: int) -> DataFrame:
    """Left-open bins between exact quantiles (equal edges dropped; the first bin holds the least value)."""
    q = [i / n_bins for i in range(n_bins + 1)]
    edges = results.groupBy("difficulty").agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, q)))).alias("e"))
    binned = results.join(F.broadcast(edges), "difficulty")  # one row for each difficulty
    at = F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col(value))))
    mid = F.bround((F.get("e", at - 1) + F.get("e", at)) / 2, 1)
    return binned.withColumn("midpoint", mid).groupBy("difficulty", "midpoint").agg(r6(F.avg("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def seed_accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("model", "seed").agg(F.avg("correct").alias("acc"))


def seed_stability(results: DataFrame) -> DataFrame:
    g = seed_accuracy(results).groupBy("model").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("acc").alias("m"), F.stddev_samp("acc").alias("s"))
    return g.select("model", "n_seeds", r6(F.col("m")).alias("mean_acc"), r6(F.col("s")).alias("std_acc"), r6(100 * F.col("s") / F.col("m")).alias("cv_pct"))


def seed_quartiles(results: DataFrame) -> DataFrame:
    g = seed_accuracy(results).groupBy("model").agg(F.percentile("acc", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("model", *[r6(F.get("q", F.lit(i))).alias(f"q{i + 1}") for i in range(3)])


def model_spread(results: DataFrame) -> DataFrame:
    g = seed_accuracy(results).groupBy("seed").agg(F.avg("acc").alias("m"), F.stddev_samp("acc").alias("s")).dropna()
    return g.select("seed", r6(F.col("m")).alias("mean_acc"), r6(F.col("s")).alias("sd_acc"))


def trend(results: DataFrame) -> DataFrame:
    """Least-squares line of accuracy over depth, for models with three depths or more."""
    g = results.groupBy("model", "depth").agg(F.avg("correct").alias("acc")).groupBy("model").agg(F.regr_slope("acc", "depth").alias("a"), F.regr_intercept("acc", "depth").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3").select("model", r6(F.col("a")).alias("slope"), r6(F.col("b")).alias("intercept"))


def average_ranks(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, value, name): ranks with ties averaged, for each distinct value of a group. The window sees distinct values and
    their counts, never the rows, so a group with most of the rows is no burden to one task."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(by, value, (before + (F.col("t") + 1) / 2).alias(name))


def kruskal_wallis(results: DataFrame) -> DataFrame:
    """H (with the correction for ties) of the seeds' accuracies between models."""
    s = seed_accuracy(results).withColumn("acc", F.round("acc", 6))
    counts = s.groupBy("acc").agg(F.count(F.lit(1)).alias("t"))  # ranks of distinct values, so that no row meets all rows
    before = F.coalesce(F.sum("t").over(Window.orderBy("acc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("rk", before + (F.col("t") + 1) / 2)
    g = s.join(ranks, "acc").groupBy("model").agg(F.sum("rk").alias("r"), F.count(F.lit(1)).alias("n"))
    ties = counts.agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    t = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").alias("total")).join(ties)
    h = (12 / (F.col("total") * (F.col("total") + 1)) * F.col("q") - 3 * (F.col("total") + 1)) / (1 - F.col("ties") / (F.pow("total", F.lit(3)) - F.col("total")))
    return t.select(r6(h).alias("h"), F.col("total").cast("bigint").alias("n"))


def icc_2_1(results: DataFrame) -> DataFrame:
    """Two-way random, single rater, absolute agreement: models as targets, seeds as raters."""
    s = seed_accuracy(results)
    row, col, all_ = Window.partitionBy("model"), Window.partitionBy("seed"), Window.partitionBy()
    x = s.withColumns({"rm": F.avg("acc").over(row), "cm": F.avg("acc").over(col), "gm": F.avg("acc").over(all_)})
    a = x.agg(F.count_distinct("model").alias("n"), F.count_distinct("seed").alias("k"), F.sum(F.pow(F.col("rm") - F.col("gm"), F.lit(2))).alias("ssr"), F.sum(F.pow(F.col("cm") - F.col("gm"), F.lit(2))).alias("ssc"), F.sum(F.pow(F.col("acc") - F.col("rm") - F.col("cm") + F.col("gm"), F.lit(2))).alias("sse"))
    msr, msc, mse = F.col("ssr") / (F.col("n") - 1), F.col("ssc") / (F.col("k") - 1), F.col("sse") / ((F.col("n") - 1) * (F.col("k") - 1))
    icc = (msr - mse) / (msr + (F.col("k") - 1) * mse + F.col("k") * (msc - mse) / F.col("n"))
    return a.select(F.col("n").alias("n_models"), F.col("k").alias("n_seeds"), r6(icc).alias("icc"))


def bias_gap(results: DataFrame) -> DataFrame:
    """Accuracy on strengthening minus accuracy on weakening turns, odds ratio with a 95 % interval (0.5 added to cells)."""
    c = lambda cls, ok: F.count_if((F.col("cls") == cls) & (F.col("correct") == ok))
    g = results.groupBy("model").agg(c("C1", 1).alias("a"), c("C1", 0).alias("b"), c("C2", 1).alias("c"), c("C2", 0).alias("d"))
    lor = F.log((F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5)))
    se = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (F.col("c") + 0.5) + 1 / (F.col("d") + 0.5))
    gap = F.col("a") / (F.col("a") + F.col("b")) - F.col("c") / (F.col("c") + F.col("d"))
    return g.select("model", r6(gap).alias("bias_gap"), r6(F.exp(lor)).alias("odds_ratio"), r6(F.exp(lor - 1.96 * se)).alias("ci_low"), r6(F.exp(lor + 1.96 * se)).alias("ci_high"))


def mcnemar(results: DataFrame) -> DataFrame:
    """Seeds where one class beats the other's majority, by model: the statistic with continuity correction."""
    s = results.where(F.col("cls").isin("C1", "C2")).groupBy("model", "seed", "depth").agg(F.avg(F.when(F.col("cls") == "C1", F.col("correct"))).alias("x"), F.avg(F.when(F.col("cls") == "C2", F.col("correct"))).alias("y"))
    g = s.groupBy("model").agg(F.count_if((F.col("x") > 0.5) & (F.col("y") <= 0.5)).alias("b"), F.count_if((F.col("x") <= 0.5) & (F.col("y") > 0.5)).alias("c"))
    stat = F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2)) / (F.col("b") + F.col("c")))
    return g.select("model", "b", "c", r6(stat).alias("chi2"))


def spearman(results: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation by model."""
    pairs = results.groupBy("model", x, y).agg(F.count(F.lit(1)).alias("w"))  # equal pairs count by their number
    ranked = pairs.join(average_ranks(results, "model", x, "rx"), ["model", x]).join(average_ranks(results, "model", y, "ry"), ["model", y])
    n, s = F.sum("w"), lambda e: F.sum(F.col("w") * e)
    rx, ry = F.col("rx"), F.col("ry")
    cov, vx, vy = n * s(rx * ry) - s(rx) * s(ry), n * s(rx * rx) - s(rx) * s(rx), n * s(ry * ry) - s(ry) * s(ry)
    return ranked.groupBy("model").agg(r6(cov / F.sqrt(vx * vy)).alias("rho"), n.alias("n"))


def dataset_statistics(results: DataFrame) -> DataFrame:
    """Counts and label balance over grouping sets of topology and difficulty."""
    g = results.cube("topology", "difficulty").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("positive_share"), F.max("depth").alias("max_depth"), F.grouping_id().alias("gid"))
    return g.select(F.coalesce("topology", F.lit("all")).alias("topology"), F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n", "positive_share", "max_depth").where("gid in (0, 1, 2, 3)")


def latex_rows(results: DataFrame) -> DataFrame:
    """Table rows: model & accuracy & count."""
    g = results.groupBy("model").agg(F.avg("correct").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("model", F.concat(F.col("model"), F.lit(" & "), F.format_string("%.1f", F.col("a") * 100), F.lit(" & "), F.col("n").cast("string"), F.lit(r" \\")).alias("tex"))


def accuracy_by_task(results: DataFrame) -> DataFrame:
    """model, config and accuracy in long form: one topology has two columns, entailment and effect, the others one."""
    g = results.groupBy("model", "topology").agg(F.avg("correct").alias("all"), F.avg(F.when(F.col("cls") == "C0", F.col("correct"))).alias("entailment"), F.avg(F.when(F.col("cls") != "C0", F.col("correct"))).alias("effect"))
    two = F.col("topology") == "F"
    kinds = F.when(two, F.array(F.struct(F.lit(" entailment").alias("k"), F.col("entailment").alias("v")), F.struct(F.lit(" effect").alias("k"), F.col("effect").alias("v")))).otherwise(F.array(F.struct(F.lit("").alias("k"), F.col("all").alias("v"))))
    return g.select("model", "topology", F.explode(kinds).alias("x")).select("model", F.concat("topology", "x.k").alias("config"), r6(F.col("x.v")).alias("accuracy"))


def boxes(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the last value within 1.5 interquartile ranges) and the number of outliers of each group."""
    q = values.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    met = values.join(F.broadcast(q), by)  # a row for each group
    return met.groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("n_outliers")).select(*by, *[r6(F.col(c)).alias(c) for c in ("q1", "q2", "q3", "low", "high")], "n_outliers")


def depth_band(results: DataFrame) -> DataFrame:
    """The depth curve with its band of one standard error, cut to [0, 1]; no band where there is one value only."""
    c = depth_curve(results)
    sem = F.coalesce("sem_accuracy", F.lit(0.0))
    return c.select("model", "topology", "depth", "mean_accuracy", r6(F.greatest(F.lit(0.0), F.col("mean_accuracy") - sem)).alias("low"), r6(F.least(F.lit(1.0), F.col("mean_accuracy") + sem)).alias("high"))


def seed_bins(results: DataFrame, value: str, step: int) -> DataFrame:
    lo = (F.floor((F.col(value) - 1) / step) * step + 1).cast("int")
    return results.groupBy("model", "seed", lo.alias("lo")).agg(r6(F.avg("correct")).alias("accuracy"))


def length_trend(results: DataFrame) -> DataFrame:
    """Accuracy and mean depth of each (model, seed) and the model's least-squares line through them; rows without either
    are left out."""
    s = results.groupBy("model", "seed").agg(F.avg("correct").alias("a"), F.avg("depth").alias("d")).dropna()
    return s.groupBy("model").agg(r6(F.regr_slope("a", "d")).alias("slope"), r6(F.regr_intercept("a", "d")).alias("intercept"), F.count(F.lit(1)).alias("n")).where("n >= 3")


def chi_squared_tail(x: Column, df: int) -> Column:
    """P(chi-squared > x): finite sums for an even number of degrees of freedom, and for an odd one with the normal tail."""
    half, out = x / 2, F.lit(0.0)
    if df % 2 == 0:
        term = F.lit(1.0)
        for i in range(df // 2):
            term = term if i == 0 else term * half / i
            out = out + term
        return F.exp(-half) * out
    z = F.sqrt(x)
    term = z * (2 / 3.141592653589793) ** 0.5 * F.exp(-half)
    for i in range(1, (df + 1) // 2):
        out = out + term
        term = term * x / (2 * i + 1)
    return normal_tails(z) + out


def kruskal_test(results: DataFrame, models: int) -> DataFrame:
    """H, its p value for a number of models, and whether it is below 0.05."""
    p = chi_squared_tail(F.col("h"), models - 1)
    return kruskal_wallis(results).select("h", "n", r6(p).alias("p"), (p < 0.05).alias("significant"))


def paired_mcnemar(turns: DataFrame) -> DataFrame:
    """Pairs of turns (model, pair, first, second; 1 correct, 0 wrong): discordant counts and the corrected statistic."""
    g = turns.groupBy("model").agg(F.count_if((F.col("first") == 1) & (F.col("second") == 0)).alias("b"), F.count_if((F.col("first") == 0) & (F.col("second") == 1)).alias("c"))
    stat = F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2)) / (F.col("b") + F.col("c")))
    return g.select("model", "b", "c", r6(stat).alias("chi2"), r6(F.when(stat.isNotNull(), chi_squared_tail(stat, 1))).alias("p"))


def icc_interval(results: DataFrame, level: float = 0.95) -> DataFrame:
    """ICC(2,1) with its interval: two-way random effects, absolute agreement, Satterthwaite's degrees of freedom and exact
    quantiles of F."""
    s = seed_accuracy(results)
    by = lambda c, name: s.groupBy(c).agg(F.avg("acc").alias(name))
    x = s.join(by("model", "rm"), "model").join(by("seed", "cm"), "seed").join(F.broadcast(s.agg(F.avg("acc").alias("gm"))))  # one row
    sq = lambda e: F.sum(F.pow(e, F.lit(2.0)))
    a = x.agg(F.count_distinct("model").alias("n"), F.count_distinct("seed").alias("k"), sq(F.col("rm") - F.col("gm")).alias("r"), sq(F.col("cm") - F.col("gm")).alias("c"), sq(F.col("acc") - F.col("rm") - F.col("cm") + F.col("gm")).alias("e"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    a = a.select(n.alias("n"), k.alias("k"), (F.col("r") / (n - 1)).alias("r"), (F.col("c") / (k - 1)).alias("c"), (F.col("e") / ((n - 1) * (k - 1))).alias("e"))
    n, k, r, c, e = (F.col(x) for x in "nkrce")
    a = a.withColumn("icc", (r - e) / (r + (k - 1) * e + k * (c - e) / n))
    icc = F.col("icc")
    u, v = k * icc / (n * (1 - icc)) * c, (1 + k * icc * (n - 1) / (n * (1 - icc))) * e
    a = a.withColumn("v", F.pow(u + v, F.lit(2.0)) / (u * u / (k - 1) + v * v / ((n - 1) * (k - 1))))
    a = once(once(a, freedom=F.col("v")), lo=f_quantile((1 + level) / 2, n - 1, F.col("freedom")), hi=f_quantile((1 + level) / 2, F.col("freedom"), n - 1))
    rest, lo, hi = k * c + (k * n - k - n) * e, F.col("lo"), F.col("hi")
    return a.select(r6(icc).alias("icc"), r6(n * (r - lo * e) / (lo * rest + n * r)).alias("ci_low"), r6(n * (hi * r - e) / (rest + n * hi * r)).alias("ci_high"))


def odds_ratio(cells: DataFrame, by: list[str], z: float = 1.959963984540054) -> DataFrame:
    """by, odds ratio of right answers (a right, b wrong) in the first condition against the second (c right, d wrong), its
    interval and p value. Half a count is added to each of the four, so that none is empty."""
    g = cells.select(*by, *[(F.col(c) + 0.5).cast("double").alias(c) for c in "abcd"])
    g = g.withColumns({"log_or": F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c"))), "se": F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d"))})
    bound = lambda sign: r6(F.exp(F.col("log_or") + sign * F.lit(z) * F.col("se")))
    p = chi_squared_tail(F.pow(F.col("log_or") / F.col("se"), F.lit(2.0)), 1)
    return g.select(*by, r6(F.exp("log_or")).alias("odds_ratio"), bound(-1).alias("ci_low"), bound(1).alias("ci_high"), p.alias("p"))


def holm(tests: DataFrame, family: list[str], order: list[str], p: str = "p") -> DataFrame:
    """tests with p_holm: the step-down correction inside each family. With m tests the k-th smallest p value counts m - k + 1
    times, no less than those before it and one at most; null p values are no tests and stay null. A family is a set of
    planned tests, which one window partition holds."""
    w = Window.partitionBy(*family, F.col(p).isNull())
    ranked = w.orderBy(p, *order)
    m, k = F.count(F.lit(1)).over(w), F.row_number().over(ranked)
    steps = tests.withColumn("__step", (m - k + 1) * F.col(p))
    return steps.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__step").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))))).drop("__step")


def bias_tests(results: DataFrame) -> DataFrame:
    """(topology, model, odds_ratio, ci_low, ci_high, p_holm, significant) of congruent (C1) against incongruent (C2) items, corrected
    for the models of a topology."""
    n = lambda cls, right: F.count_if((F.col("cls") == cls) & (F.col("correct") == right))
    cells = results.groupBy("topology", "model").agg(n("C1", 1).alias("a"), n("C1", 0).alias("b"), n("C2", 1).alias("c"), n("C2", 0).alias("d"))
    tests = holm(odds_ratio(cells, ["topology", "model"]), ["topology"], ["model"])
    return tests.select("topology", "model", "odds_ratio", "ci_low", "ci_high", r6("p_holm").alias("p_holm"), (F.col("p_holm") < 0.05).alias("significant"))
