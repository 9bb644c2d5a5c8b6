"""Neighbourhood votes: which recorded label disagrees with its group's other labels?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelsift.operators.entity import leave_one_out
from labelsift.operators.stats import chi_square_of

LEAST_OTHERS, LIFT = 10, 2.0


def lift_vote(df: DataFrame, group: list[str] | str, minority: Column, known: Column, trusted: Column | None = None, least: int = LEAST_OTHERS, lift: float = LIFT) -> DataFrame:
    """``df`` with others_n, others_hits, others_share, base and vote: 1 (minority) if the others' share is at least ``lift`` times the base, 0 if at
    most base / lift, null without enough others or in between. ``trusted`` labels vote; by default all known ones."""
    counted = known if trusted is None else known & trusted
    base = df.agg(F.avg(F.when(counted, minority.cast("double"))).alias("base"))
    out = leave_one_out(df, group, minority, counted).crossJoin(F.broadcast(base))  # one row
    share = F.col("others_hits") / F.greatest(F.col("others_n"), F.lit(1))
    enough = F.col("others_n") >= least
    return out.withColumn("others_share", F.when(enough, share)).withColumn(
        "vote", F.when(enough & (share >= F.col("base") * lift), 1).when(enough & (share <= F.col("base") / lift), 0)
    )


def suggestion(label: Column, vote: Column, names: tuple[str, str]) -> Column:
    """'no vote', 'first label x', 'keep x' or 'amend x to y'; names are those of labels 0 and 1."""
    named = F.when(vote == 1, names[1]).otherwise(names[0])
    was = F.when(label == 1, names[1]).otherwise(names[0])
    return (
        F.when(vote.isNull(), "no vote").when(label.isNull(), F.concat(F.lit("first label "), named)).when(label == vote, F.concat(F.lit("keep "), named)).otherwise(F.concat(F.lit("amend "), was, F.lit(" to "), named))
    )


def rule_comparison(df: DataFrame, label: str, rules: list[tuple[str, float, int]], group: str | list[str]) -> DataFrame:
    """(rule, coverage, agree_0, agree_1) of lift rules (name, lift, least others)."""
    out = None
    for name, lift, least in rules:
        voted = lift_vote(df, group, F.col(label) == 1, F.col(label).isNotNull(), least=least, lift=lift)
        one = voted.agg(
            F.avg(F.col("vote").isNotNull().cast("double")).alias("coverage"),
            F.avg(F.when(F.col("vote").isNotNull() & (F.col(label) == 0), (F.col("vote") == 0).cast("double"))).alias("agree_0"),
            F.avg(F.when(F.col("vote").isNotNull() & (F.col(label) == 1), (F.col("vote") == 1).cast("double"))).alias("agree_1"),
        ).select(F.lit(name).alias("rule"), "*")
        out = one if out is None else out.union(one)
    return out


def validation(voted: DataFrame, label: str, bin_col: str) -> DataFrame:
    """(label, bin, voted, disagree, disagree_pct) over labelled rows with a vote."""
    rows = voted.where(F.col(label).isNotNull() & F.col("vote").isNotNull() & F.col(bin_col).isNotNull())
    per = rows.groupBy(label, bin_col).agg(F.count(F.lit(1)).alias("voted"), F.count_if(F.col("vote") != F.col(label)).alias("disagree"))
    return per.withColumn("disagree_pct", F.bround(100.0 * F.col("disagree") / F.col("voted"), 1))


def validation_chi_square(validated: DataFrame, label: str, bin_col: str) -> DataFrame:
    """(label, chi2, dof): does disagreement depend on the bin?"""
    parts = []
    for value in (0, 1):
        rows = validated.where(F.col(label) == value)
        cells = rows.select(bin_col, F.lit("no").alias("side"), F.col("disagree").cast("double").alias("n")).union(
            rows.select(bin_col, F.lit("yes").alias("side"), (F.col("voted") - F.col("disagree")).cast("double").alias("n"))
        )
        parts.append(chi_square_of(cells, bin_col, "side").select(F.lit(value).alias("label"), "chi2", "dof"))
    return parts[0].union(parts[1])
