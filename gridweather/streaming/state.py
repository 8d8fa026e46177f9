"""State tables for ``foreachBatch``: rows in buckets by the hash of a key, and a manifest per batch.

A manifest names for every bucket the batch that wrote it last. A batch reads and writes only the buckets its keys fall into; all
others are taken over by name, so the bytes written follow the batch and not the state. Batch n starts from the manifest of batch
n - 1, whose files stay until batch n + 1 has been written: a batch that is repeated after a loss starts from the same state and
writes the same files again. What neither of the two newest manifests names is removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64


def run_available(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Work through everything that has arrived, then stop; a later call goes on where this one ended."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


@dataclass(frozen=True)
class KeyedTable:
    """A table with one row per key. ``buckets`` is fixed by the first batch; size it so that one bucket fits a task."""

    folder: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS

    def update(self, batch: DataFrame, number: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Write the state after batch ``number``. ``fold`` maps the old rows of the touched buckets to their new rows."""
        spark = batch.sparkSession
        old = self._manifest(spark, number - 1)
        buckets = old[0][1] if old else self.buckets
        place = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        # At most one number per bucket comes back.
        touched = [row[0] for row in batch.select(place).distinct().collect()]
        held = {bucket: (bucket, buckets, writer) for bucket, _, writer in old if bucket >= 0}
        new = fold(self._rows(spark, [held[b] for b in touched if b in held])).select(*self.schema.names).withColumn("_bucket", place)
        out = f"{self.folder}/rows/writer={number}"
        new.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(out)
        # A fold may leave a bucket without rows; it then has no file and no place in the manifest.
        kept = {row[0] for row in self._written(spark, out).select("_bucket").distinct().collect()} if touched else set()
        now = {b: x for b, x in held.items() if b not in touched} | {b: (b, buckets, number) for b in kept}
        rows = sorted(now.values()) or [(-1, buckets, number)]
        spark.createDataFrame(rows, "bucket int, buckets int, writer bigint").coalesce(1).write.mode("overwrite").parquet(self._path(number))
        self._remove_old(spark, number)

    def before(self, spark: SparkSession, number: int, keys: DataFrame) -> DataFrame:
        """Rows of the given keys as they were before batch ``number``; only their buckets are read."""
        old = self._manifest(spark, number - 1)
        buckets = old[0][1] if old else self.buckets
        touched = {row[0] for row in keys.select(F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")).distinct().collect()}
        return self._rows(spark, [x for x in old if x[0] in touched])

    def latest(self, spark: SparkSession) -> DataFrame:
        """The newest state. It can be read until two more batches have been written."""
        return self._rows(spark, self._manifest(spark, max(self._numbers(spark), default=-1)))

    def _path(self, number: int) -> str:
        return f"{self.folder}/manifests/number={number}"

    def _manifest(self, spark: SparkSession, number: int) -> list[tuple[int, int, int]]:
        if number < 0:
            return []
        return [tuple(row) for row in spark.read.parquet(self._path(number)).select("bucket", "buckets", "writer").collect()]

    def _written(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)

    def _rows(self, spark: SparkSession, entries) -> DataFrame:
        paths = [f"{self.folder}/rows/writer={writer}/_bucket={bucket}" for bucket, _, writer in entries if bucket >= 0]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _files(self, spark: SparkSession, path: str):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, there = self._files(spark, folder)
        return [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []

    def _numbers(self, spark: SparkSession) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(spark, f"{self.folder}/manifests") if n.startswith("number=")]

    def _remove_old(self, spark: SparkSession, number: int) -> None:
        past = [n for n in self._numbers(spark) if n < number - 1]
        if not past:
            return
        wanted = {(b, w) for n in (number - 1, number) for b, _, w in self._manifest(spark, n)}
        for n in sorted(past):
            for bucket, _, writer in self._manifest(spark, n):
                if bucket >= 0 and (bucket, writer) not in wanted:
                    files, there = self._files(spark, f"{self.folder}/rows/writer={writer}/_bucket={bucket}")
                    files.delete(there, True)
            files, there = self._files(spark, self._path(n))
            files.delete(there, True)
