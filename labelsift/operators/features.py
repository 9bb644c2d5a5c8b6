"""Feature frames: imputation, standardisation by view, inverse transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed value: the default theme colour that stands for an unusable one.
DEFAULT_RGB = (0x00, 0x84, 0xB4)


def impute_median(df: DataFrame, columns: list[str], over: DataFrame | None = None) -> DataFrame:
    """Nulls become exact medians of ``over`` (``df`` itself by default); one aggregate, one broadcast row."""
    medians = (over if over is not None else df).agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Nulls become constants, by column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def standardise(df: DataFrame, views: dict[str, list[str]], fit_on: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """z-scores with the population deviation, times 1 / sqrt(size of the column's view). Fails, when run, on a constant column."""
    columns = [c for v in views.values() for c in v]
    weight = {c: len(v) ** -0.5 for v in views.values() for c in v}
    fit_on = df if fit_on is None else fit_on
    stats = fit_on.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        sd = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.raise_error(F.lit(f"column {c} is constant")).cast("double"))
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_mean_{c}")) / sd * weight[c])
    return out.drop(*[f"_mean_{c}" for c in columns], *[f"_sd_{c}" for c in columns])


def original_units(df: DataFrame, stats: DataFrame, columns: list[str], weights: dict[str, float], suffix: str = "_z") -> DataFrame:
    """The inverse of standardise; ``stats`` is one row of mean_<c> and sd_<c>."""
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({c: F.col(c + suffix) / weights[c] * F.col(f"sd_{c}") + F.col(f"mean_{c}") for c in columns})
    return out.drop(*[f"mean_{c}" for c in columns], *[f"sd_{c}" for c in columns])


def fit_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean_<c> and sd_<c> (population)."""
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns])
