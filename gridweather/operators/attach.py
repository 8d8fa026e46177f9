"""One-row tables as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row. The row is computed once as a scalar; nothing is joined."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_one")).scalar()
    return df.withColumn("_one", row).select(*df.columns, "_one.*")
