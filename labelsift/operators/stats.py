"""Statistics and evaluation measures as aggregates; every function returns a small DataFrame or a Column."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def skew_g1(x: str | Column) -> Column:
    """Bias-corrected skewness of non-null values; null under three."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def share(condition: Column) -> Column:
    """Mean of a predicate."""
    return F.avg(condition.cast("double"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(df: DataFrame, a: str, b: str, times: str | None = None) -> DataFrame:
    """(ari): agreement of two labelings of the rows, from their contingency table. A row counts as often as ``times`` says."""
    cells = df.groupBy(a, b).agg((F.sum(times) if times else F.count(F.lit(1))).cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("cols"))
    both = cells.agg(F.sum(pairs_of(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    one = both.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("rows") * F.col("cols") / pairs_of(F.col("n"))
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / (most - expected)).alias("ari"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof) of independence, from the full table of observed levels; no continuity correction."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return chi_square_of(cells, a, b)


def chi_square_of(cells: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """As chi_square, of a table (a, b, n) already counted."""
    rows = cells.groupBy(a).agg(F.sum(n).alias("_r"))
    cols = cells.groupBy(b).agg(F.sum(n).alias("_c"))
    total = cells.agg(F.sum(n).alias("_t"))
    full = rows.crossJoin(cols).crossJoin(total).join(cells, [a, b], "left")  # levels by levels
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    return full.agg(
        F.sum((F.coalesce(F.col(n), F.lit(0.0)) - expected) ** 2 / expected).alias("chi2"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).cast("long").alias("dof"),
    )


def rand_matrix(df: DataFrame, columns: list[str], times: str | None = None) -> DataFrame:
    """(a, b, ari) for each pair of labelings, over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = [adjusted_rand(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, times).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari") for a, b in pairs]
    return reduce(DataFrame.unionAll, parts)


def chi_square_p(x: Column, dof: Column) -> Column:
    """The chance of a chi-square of x or more: the closed sum for even degrees of freedom, and for odd ones the series around erfc's."""
    half = x / 2

    def summed(steps: Column, first: float, next_term: Callable[[Column, Column], Column]) -> Column:
        """The sum of 1 (or 0) and of terms, each made of the one before and its number."""
        start = F.struct(F.lit(1.0).alias("t"), F.lit(first).alias("s"))

        def add(state: Column, k: Column) -> Column:
            term = next_term(state["t"], k)
            return F.struct(term.alias("t"), (state["s"] + (term if first else state["t"])).alias("s"))

        return F.aggregate(steps, start, add, lambda state: state["s"])

    even = F.exp(-half) * summed(F.sequence(F.lit(0).cast("long"), (dof / 2).cast("long") - 1), 0.0, lambda t, k: t * half / (k + 1))
    # P(a, h) = h^a e^-h / Gamma(a + 1) * (1 + h / (a + 1) + ...), a = dof / 2
    a = dof / 2.0
    log_gamma = F.aggregate(F.sequence(F.lit(0).cast("long"), ((dof - 1) / 2).cast("long")), F.lit(0.5 * math.log(math.pi)), lambda s, k: s + F.log(k + 0.5))
    series = summed(F.sequence(F.lit(1), F.lit(600)), 1.0, lambda t, k: t * half / (a + k))
    odd = F.greatest(F.lit(0.0), 1 - F.exp(a * F.log(half) - half - log_gamma) * series)
    return F.when(x <= 0, 1.0).when(dof % 2 == 0, even).otherwise(odd)


def contrast(df: DataFrame, value: Column, inside: Column) -> DataFrame:
    """(n_in, n_out, mean_in, mean_out, difference): a value's mean where a condition holds, and where it doesn't."""
    one = df.select(value.cast("double").alias("v"), inside.alias("g")).agg(
        F.count_if(F.col("g")).alias("n_in"), F.count_if(~F.col("g")).alias("n_out"), F.avg(F.when(F.col("g"), F.col("v"))).alias("mean_in"), F.avg(F.when(~F.col("g"), F.col("v"))).alias("mean_out")
    )
    return one.withColumn("difference", F.col("mean_in") - F.col("mean_out"))


def group_residuals(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """(group, mean_residual) of the line fitted to all rows."""
    line = df.agg(F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_k"))
    return df.crossJoin(F.broadcast(line)).groupBy(group).agg(F.avg(F.col(y) - F.col("_m") * F.col(x) - F.col("_k")).alias("mean_residual"))


#: Ranges of scores that running sums are made in.
SCORE_RANGES = 256


def running_sums(per: DataFrame, score: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``per`` (one row a score) with below_<c> and all_<c>: the sums over the scores that come before, and over all.

    Scores are cut into ranges by approximate quantiles; the sums of whole ranges are where a range's own sums begin.
    """
    cuts = per.agg(F.percentile_approx(score, [i / SCORE_RANGES for i in range(1, SCORE_RANGES)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = per.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(score))))
    every = Window.partitionBy()  # of SCORE_RANGES rows at most
    order = F.col("_b").desc() if descending else F.col("_b")
    sums = ranged.groupBy(F.col("_range").alias("_b")).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    starts = sums.select(
        "_b",
        *[F.coalesce(F.sum(f"_s_{c}").over(every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"_from_{c}") for c in columns],
        *[F.sum(f"_s_{c}").over(every).alias(f"all_{c}") for c in columns],
    )
    own = Window.partitionBy("_range").orderBy(F.col(score).desc() if descending else F.col(score)).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_b"))
    return joined.select(*per.columns, *[(F.col(f"_from_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0.0))).alias(f"below_{c}") for c in columns], *[f"all_{c}" for c in columns])


def _per_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc) by average ranks, counted per distinct score first. Rows of a null score or label are left out."""
    ranked = running_sums(_per_score(df, score, label), score, ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    return ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(
        ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc")
    )


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score. Rows of a null score or label are left out."""
    per = _per_score(df, score, label).withColumn("f", F.col("n") - F.col("p"))
    sums = running_sums(per, score, ["f", "p"], descending=True)
    return sums.select(F.col(score).alias("threshold"), ((F.col("below_f") + F.col("f")) / F.col("all_f")).alias("fpr"), ((F.col("below_p") + F.col("p")) / F.col("all_p")).alias("tpr"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(tp, fp, tn, fn)."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    return df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))


def binary_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1); a ratio without cases is 0."""
    c = confusion(df, truth, guess)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def f1(t: Column, p: Column, n: Column) -> Column:
        return ratio(2 * t, 2 * t + p + n)

    return c.select(
        ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
        ((ratio(tp, tp + fp) + ratio(tn, tn + fn)) / 2).alias("macro_precision"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("macro_recall"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
    )


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r2, mse) of a line; one aggregate."""
    n = F.regr_count(y, x)
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), ((syy - sxy * sxy / sxx) / n).alias("mse"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for pairs of columns, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles, greatest."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.percentile(c, 0.25).alias("p25"), F.percentile(c, 0.5).alias("p50"), F.percentile(c, 0.75).alias("p75"), F.max(c).alias("max"),
    )
