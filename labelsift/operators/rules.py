"""Association rules over baskets: frequent itemsets, rules for a label, rows that break them."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame, functions as F


def basket(items: dict[str, Column]) -> Column:
    """The sorted array of the names whose condition holds."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in items.items()]), lambda x: x.isNotNull()))


def itemsets(df: DataFrame, items: str, least_support: float, most: int = 4) -> tuple[DataFrame, FPGrowthModel]:
    """(items, size, freq, support) of itemsets of ``most`` items at most, and the model."""
    model = FPGrowth(itemsCol=items, minSupport=least_support, minConfidence=0.0).fit(df)
    n = df.count()
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(n)).alias("support")).where(F.col("size") <= most)
    return sets, model


def label_rules(model: FPGrowthModel, labels: list[str], most: int = 4, least_lift: float = 1.0) -> DataFrame:
    """(lhs, label, support, confidence, lift) of rules whose right side is one label and whose left side has none."""
    rules = model.associationRules.where(F.size("consequent") == 1).withColumn("label", F.col("consequent")[0])
    free = F.size(F.array_intersect("antecedent", F.array(*map(F.lit, labels)))) == 0
    return rules.where(F.col("label").isin(labels) & free & (F.size("antecedent") < most) & (F.col("lift") >= least_lift)).select(
        F.array_join(F.array_sort("antecedent"), ", ").alias("lhs"), "label", "support", "confidence", "lift"
    )


#: Thresholds of strong rules.
STRONG = {"any": (6.0, 0.8), "brand": (1.5, 0.8), "human": (1.2, 0.9)}


def strong(rules: DataFrame, label: str | None = None) -> DataFrame:
    lift, confidence = STRONG[label or "any"]
    chosen = rules if label is None else rules.where(F.col("label") == label)
    return chosen.where((F.col("lift") >= lift) & (F.col("confidence") >= confidence))


def violators(df: DataFrame, key: str, items: str, rules: DataFrame, labels: list[str]) -> DataFrame:
    """(key, n_rules_broken): rows that hold a rule's left side but carry another of the labels. Rules are few and are broadcast."""
    sides = rules.select(F.split("lhs", ", ").alias("_lhs"), F.col("label").alias("_rhs"))
    other = F.exists(items, lambda x: x.isin(labels) & (x != F.col("_rhs")))
    hit = df.join(F.broadcast(sides), (F.size(F.array_except("_lhs", items)) == 0) & other)
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("n_rules_broken"))


def item_support(df: DataFrame, items: str, label: str) -> DataFrame:
    """(item, support_0, support_1, difference) of each item among rows of label 0 and 1."""
    totals = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    per = df.select(label, F.explode(items).alias("item")).groupBy("item").agg(F.count_if(F.col(label) == 0).alias("c0"), F.count_if(F.col(label) == 1).alias("c1"))
    out = per.crossJoin(F.broadcast(totals))
    return out.select("item", (F.col("c0") / F.col("n0")).alias("support_0"), (F.col("c1") / F.col("n1")).alias("support_1"), (F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0")).alias("difference"))
