"""Streams: running statistics, rate windows, state changes, a live registry, and arrival of new days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridweather.operators import series, stats, tables as tb
from gridweather.streaming import state


def running_moments(stream: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """Count, mean and squared deviations of everything seen; each chunk is read once and its moments are kept."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        stats.moments(batch, columns).write.mode("overwrite").parquet(f"{folder}/parts/chunk={number}")

    state.run_available(stream, folder, step)
    return stats.merge_moments(spark.read.parquet(f"{folder}/parts").drop("chunk"))


# Requests allowed per window overall, per client, and per client on the route that creates something.
LIMITS = {"overall": 1000, "client": 120, "create": 20}


def rate_counts(requests: DataFrame, at: str, client: str, create: Column, *, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests and creating requests per client in fixed windows; on a stream, rows later than ``late`` are dropped."""
    timed = requests.withColumn(at, F.col(at).cast("timestamp"))
    if requests.isStreaming:
        timed = timed.withWatermark(at, late)
    counts = timed.groupBy(F.window(at, window), client).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.coalesce(create, F.lit(False))).alias("creates"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), client, "requests", "creates")


def rate_verdicts(counts: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Adds ``overall`` (requests of all clients in the window) and ``limit_hit``: the first limit exceeded, else NULL.

    The limits are met in the order overall, client, create. The total is a sum over the clients' counts, combined before the
    shuffle, so neither a busy client nor a busy window gathers its requests anywhere.
    """
    total = counts.groupBy("window_start").agg(F.sum("requests").alias("overall"))
    hit = F.when(F.col("overall") > limits["overall"], "overall").when(F.col("requests") > limits["client"], "client").when(F.col("creates") > limits["create"], "create")
    return counts.join(total, "window_start").withColumn("limit_hit", hit)


def rate_stream(stream: DataFrame, folder: str, at: str, client: str, create: Column, *, limits: dict[str, int] = LIMITS, **kw) -> DataFrame:
    """Closed rate windows with their verdicts, written as they close.

    The watermark closes a window for all clients in one batch, so that batch holds all the window's counts and the total needs no
    state of its own. State is partitioned by window and client, in as many parts as the session's shuffles have at the first run.
    """
    spark = stream.sparkSession
    counts = rate_counts(stream, at, client, create, **kw)
    schema = counts.schema

    def step(batch: DataFrame, number: int) -> None:
        closed = f"{folder}/closed/chunk={number}"
        batch.write.mode("overwrite").parquet(closed)
        # Written once: reading the batch again would work through the state again. Most batches close nothing.
        counted = batch.sparkSession.read.schema(schema).parquet(closed)
        if number == 0 or not counted.isEmpty():
            rate_verdicts(counted, limits).write.mode("overwrite").parquet(f"{folder}/windows/chunk={number}")

    state.run_available(counts, folder, step)
    return spark.read.parquet(f"{folder}/windows").drop("chunk")


def change_stream(stream: DataFrame, key: str, at: str, ident: str, value: str, folder: str, buckets: int = state.BUCKETS) -> DataFrame:
    """Rows at which a key's state differs from the one before, across batches.

    The last row per key is the state. It is laid in front of the batch, and the batch operator finds the changes; a busy key is
    cut into blocks there, which one state-store task could not do. Rows may lie in any order within a batch. A row of a later
    batch that is not after its key's last row (by time, then id) is late: its place has been passed, and it is dropped.
    """
    spark = stream.sparkSession
    columns = [key, at, ident, value]
    table = state.KeyedTable(f"{folder}/state", T.StructType([stream.schema[c] for c in columns]), key, buckets)

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.select(*columns)
        last = table.before(own, number, rows)
        seen = last.select(F.col(key).alias("_k"), F.struct(at, ident).alias("_seen"))
        rows = rows.join(seen, F.col(key).eqNullSafe(F.col("_k")), "left").where(F.col("_seen").isNull() | (F.struct(at, ident) > F.col("_seen"))).select(*columns)
        line = last.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        marked = series.state_changes(line, key, [at, ident], at, value)
        marked.where("_new and changed").select(*columns).write.mode("overwrite").parquet(f"{folder}/changes/chunk={number}")

        def fold(old: DataFrame) -> DataFrame:
            newest = old.unionByName(rows).groupBy(key).agg(F.max_by(F.struct(at, ident, value), F.struct(at, ident)).alias("_r"))
            return newest.select(key, f"_r.{at}", f"_r.{ident}", f"_r.{value}")

        table.update(rows, number, fold)

    state.run_available(stream, folder, step)
    return spark.read.parquet(f"{folder}/changes").drop("chunk")


def registry_stream(stream: DataFrame, ident: str, at: str, folder: str, buckets: int = state.BUCKETS) -> DataFrame:
    """Latest row per id, published anew after every batch."""
    table = state.KeyedTable(f"{folder}/state", stream.schema, ident, buckets)

    def step(batch: DataFrame, number: int) -> None:
        table.update(batch, number, lambda old: tb.upsert(old, batch, ident, at))

    state.run_available(stream, folder, step)
    return table.latest(stream.sparkSession)


def new_days(spark: SparkSession, source: str, schema, folder: str) -> DataFrame:
    """Rows of day files that no earlier call has seen; the checkpoint remembers the files."""
    out = f"{folder}/seen"
    stream = spark.readStream.schema(schema).option("basePath", source).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    state.run_available(stream, folder, step)
    return spark.read.parquet(out)
