"""Raw profile judgements to the prepared table, the account table, conflicts and the dictionary: one narrow plan and one shuffle, by account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labelsift.functions import colour, text
from labelsift.functions.numeric import clip_low, flag, parse_minute, rate, recode, whole_days
from labelsift.operators import entity, quality

#: The labels and what they say of an account.
IS_HUMAN = {"female": 1, "male": 1, "brand": 0}
COUNTS = ["fav_number", "retweet_count", "tweet_count"]
DEFAULT_SIDEBAR = "C0DEED"


def _dependants() -> dict:
    """Columns computed from the counts and the age."""
    days = F.col("account_age_days")
    return {
        **{f"log_{c}": F.log1p(F.col(c)) for c in COUNTS},
        "has_retweets": flag(F.col("retweet_count") > 0),
        "tweets_per_day": rate(F.col("tweet_count"), days),
        "favs_per_day": rate(F.col("fav_number"), days),
    }


def prepare(raw: DataFrame) -> DataFrame:
    """The prepared table: 55 columns, one row per judgement of a real profile. Only an explicit 'no' drops a row."""
    rows = raw.where(~F.col("profile_yn").eqNullSafe("no"))
    group = Window.partitionBy("account_id")
    age = whole_days(parse_minute(F.col("created")), parse_minute(F.col("tweet_created")))
    base = rows.select(
        F.col("_row_id"), F.col("_unit_id").alias("unit_id"), "name", entity.account_key("name", "created").alias("account_id"), "gender", F.col("`gender:confidence`").alias("gender_confidence"),
        recode(F.col("gender"), IS_HUMAN).cast("int").alias("is_human"), *COUNTS, age.cast("long").alias("_age"), "link_color", "sidebar_color", "description", F.col("text").alias("_tweet"),
    )
    base = base.withColumnRenamed("_age", "account_age_days").withColumns(_dependants()).withColumn("log_account_age_days", F.log1p(clip_low(F.col("account_age_days"), 0)))
    keyed = base.withColumns({
        "n_rows_for_account": F.count(F.lit(1)).over(group),
        "label_known": flag(F.col("is_human").isNotNull()),
        "label_conflict_human_brand": flag(F.min("is_human").over(group) != F.max("is_human").over(group)),
        "label_conflict_gender": flag(F.min("gender").over(group) != F.max("gender").over(group)),
    })
    wide = keyed.withColumns({**colour.features(F.col("link_color"), "link_color"), **colour.features(F.col("sidebar_color"), "sidebar_color"), **text.features(F.col("description"), "description"), **text.features(F.col("_tweet"), "tweet")})
    return wide.drop("link_color", "sidebar_color", "description", "_tweet")


def accounts(prepared: DataFrame) -> DataFrame:
    """One whole row per account, of highest confidence (ties: first in the file), counts raised to the account's greatest."""
    best = entity.best_with_maxima(prepared, "account_id", "gender_confidence", "_row_id", COUNTS)
    return best.withColumns(_dependants())


def label_conflicts(prepared: DataFrame) -> DataFrame:
    keep = ["account_id", "name", "unit_id", "gender", "gender_confidence", "is_human", "label_conflict_human_brand", "tweet_raw"]
    return prepared.where("label_conflict_gender = 1").select(*keep).orderBy("account_id", F.desc_nulls_last("gender_confidence"), "unit_id")


def assertions(prepared: DataFrame, table: DataFrame) -> DataFrame:
    """Invariants of both tables, as rows (check_name, ok)."""
    ages, shares = F.col("account_age_days"), F.col("gender_confidence")
    hexes = [F.col(f"{c}_hex").isNull() | F.col(f"{c}_hex").rlike("^[0-9A-F]{6}$") for c in ("link_color", "sidebar_color")]
    plain = [~F.col(f"{c}_clean").rlike(r"(?i)https?:|www\.|[^\x00-\x7F]|\s\s") for c in ("description", "tweet")]
    first = quality.checks(prepared, {
        "unit_id unique": quality.duplicates("unit_id") == 0,
        "confidence within 0 and 1": quality.all_rows(shares.isNull() | shares.between(0, 1)),
        "age not negative": quality.all_rows(ages.isNull() | (ages >= 0)),
        "colour codes well formed": quality.all_rows(hexes[0] & hexes[1]),
        "usable agrees with code": quality.all_rows((F.col("link_color_usable") == 1) == F.col("link_color_hex").isNotNull()),
        "clean text has no link, no corrupted run": quality.all_rows(plain[0] & plain[1]),
        "label known agrees with is_human": quality.all_rows((F.col("label_known") == 1) == F.col("is_human").isNotNull()),
        "counts not negative": quality.all_rows(F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in COUNTS]) >= 0),
    })
    return first.union(quality.checks(table, {"account_id unique": quality.duplicates("account_id") == 0}))


def account_features(table: DataFrame) -> DataFrame:
    """Derived columns that clustering and rules use."""
    return table.withColumns({
        "sidebar_is_default": flag(F.col("sidebar_color_hex") == DEFAULT_SIDEBAR),
        "tweet_has_url": flag(F.col("tweet_n_urls") > 0),
        "tweet_has_hashtag": flag(F.col("tweet_n_hashtags") > 0),
        "label": F.coalesce(recode(F.col("is_human"), {1: "human", 0: "brand"}), F.lit("unknown")),
    })
