"""Sinks: nested JSON lines, CSV over different headers, JSON reports, fitted statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """One nested record per line."""
    df.write.mode("overwrite").json(path)


def write_csv_union(parts: list[DataFrame], path: str) -> None:
    """One CSV table over all columns in first-seen order; a cell a part does not have is empty."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    union.write.mode("overwrite").csv(path, header=True)


def write_report(metrics: DataFrame, keys: tuple[str, str], values: list[str], provenance: dict[str, str], path: str) -> None:
    """Metrics tree first key -> second key -> values, one JSON object per first key, with where it came from.

    A report has one entry per target and band, so the maps stay small.
    """
    first, second = keys
    leaf = F.struct(F.coalesce(F.col(second), F.lit("overall")).alias("k"), F.struct(*values).alias("v"))
    tree = metrics.groupBy(first).agg(F.map_from_entries(F.array_sort(F.collect_list(leaf))).alias("metrics"))
    tree.select(first, "metrics", F.struct(*[F.lit(v).alias(k) for k, v in provenance.items()]).alias("provenance")).write.mode("overwrite").json(path)


def save_statistics(stats: DataFrame, path: str, settings: dict[str, float]) -> None:
    """Fitted statistics as a long table with the settings they belong to."""
    stats.withColumns({n: F.lit(float(v)) for n, v in settings.items()}).write.mode("overwrite").parquet(path)


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
