"""Places in a total order without one task per key: ranges of the whole order tuple, written in order, and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridweather import session


def numbered(df: DataFrame, keys: list[str], order: list[str], place: str = "_at", total: str = "_n") -> DataFrame:
    """``df`` with each row's place from 0 on within its ``keys`` along ``order``, and how many rows the keys have.

    Rows are dealt out by ranges of ``keys`` and ``order`` together, so a key of any size lies in as many ranges as it fills; each
    range is sorted and written. A row's place is its number in its file, less that of its key's first row there, plus the key's
    rows in the files before. Only one row per file and key is shuffled for that. Ranges follow the whole tuple: rows that share
    its leading part are parted by the rest, and only rows equal in all of it stay together, as they are then one value. Their
    places among themselves follow the written files, so a task that is run again sees the same ones. NULL is a key like any other
    and comes first in an order. Columns that begin with ``_metadata`` cannot be carried.
    """
    spark, one = df.sparkSession, F.lit(1)
    along = [*keys, *order]
    dealt = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id())
    path = session.new_folder(spark, "in-order")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    held = rows.groupBy(*keys, "_part", "_file").agg(F.min("_row").alias("_first"), F.count(one).alias("_held"))
    files = Window.partitionBy(*keys).orderBy("_part", "_file")
    before = F.coalesce(F.sum("_held").over(files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = held.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_file").alias("_in"),
        (before - F.col("_first")).alias("_shift"), F.sum("_held").over(Window.partitionBy(*keys)).alias(total),
    )
    same = F.col("_file") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(runs, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(place), total)
