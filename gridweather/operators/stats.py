"""Fitted statistics: moments that merge, envelopes, normalisation tables, month coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STD_FLOOR = 1e-8


def safe_std(std: Column) -> Column:
    """A missing or vanishing standard deviation scales by one."""
    return F.when(std.isNull() | F.isnan(std) | (std < STD_FLOOR), 1.0).otherwise(std)


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows (name, x) for the wanted columns."""
    return df.unpivot(keep or [], columns, "name", "x")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean and m2 (sum of squared deviations). Rows of two runs merge with ``merge_moments``."""
    x = F.col("x")
    out = long_form(df, columns).groupBy("name").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v")
    )
    return out.select("name", "n", "mean", (F.col("_v") * F.col("n")).alias("m2"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments of the union of any number of parts (same columns as ``moments``)."""
    total = F.sum("n")
    weighted = parts.withColumns({"_s": F.col("n") * F.col("mean"), "_q": F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")})
    out = weighted.groupBy("name").agg(total.alias("n"), (F.sum("_s") / total).alias("mean"), F.sum("_q").alias("_q"))
    return out.select("name", "n", "mean", F.greatest(F.lit(0.0), F.col("_q") - F.col("n") * F.col("mean") * F.col("mean")).alias("m2"))


def std_from_moments(moments_df: DataFrame, ddof: int = 1) -> DataFrame:
    n = F.col("n")
    std = F.when(n > ddof, F.sqrt(F.col("m2") / (n - ddof)))
    return moments_df.withColumn("std", safe_std(std))


def normalisation(df: DataFrame, features: list[str], targets: dict[str, Column]) -> DataFrame:
    """Long table (kind, name, mean, std): features with the sample deviation, transformed targets with the population one."""
    shaped = df.select(*features, *[col.alias(f"t_{name}") for name, col in targets.items()])
    names = features + [f"t_{name}" for name in targets]
    out = long_form(shaped, names).groupBy("name").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("_s"), F.stddev_pop("x").alias("_p")
    )
    is_target = F.col("name").isin([f"t_{name}" for name in targets])
    return out.select(
        F.when(is_target, "target").otherwise("feature").alias("kind"),
        F.when(is_target, F.substring("name", 3, 1000)).otherwise(F.col("name")).alias("name"),
        "mean",
        safe_std(F.when(is_target, F.col("_p")).otherwise(F.col("_s"))).alias("std"),
    )


def envelope(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (name, low, high)."""
    return long_form(df, columns).groupBy("name").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def wide(stats: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """A long statistics table as one row, ready to broadcast: columns ``<name>_<value>``."""
    picks = [F.max(F.when(F.col("name") == n, F.col(x))).alias(f"{n}_{x}") for n in names for x in values]
    return stats.agg(*picks)


def month_coverage(df: DataFrame, keys: list[str], month: Column) -> DataFrame:
    """Months seen per key and the annual harmonics they can carry."""
    seen = df.select(*keys, month.alias("_m")).groupBy(*keys).agg(
        F.count_distinct("_m").cast("bigint").alias("months"), F.min("_m").alias("_a"), F.max("_m").alias("_b")
    )
    few = (F.col("months") <= 1) | ((F.col("months") == 2) & (F.col("_b") - F.col("_a") <= 1))
    return seen.select(*keys, "months", F.when(few, 0).otherwise(2).alias("harmonics"))
