"""Streams: limits on three levels, late rows, and state that follows the batch and not the past."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gridweather.operators import series, tables as tb
from gridweather.streaming import jobs, state

START = dt.datetime(2025, 5, 1)
ROW = "id bigint, at bigint, x string"


def at(minute, second=0):
    return START + dt.timedelta(minutes=minute, seconds=second)


def test_each_limit_is_named(spark, tmp_path):
    limits = {"overall": 10, "client": 3, "create": 1}
    # Minute 0: all clients together are too many; 1: one client is; 2: one creates too often; 3: nobody; 9: closes the others.
    minutes = {0: [("a", False)] * 6 + [("b", True)] * 5, 1: [("a", False)] * 4 + [("b", True)], 2: [("a", True)] * 2 + [("b", False)] * 2, 3: [("a", True), ("b", None)], 9: [("z", False)]}
    rows = [(at(m, i), who, create) for m, all_ in minutes.items() for i, (who, create) in enumerate(all_)]
    df = spark.createDataFrame(rows, "at timestamp, who string, creates boolean")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 2), (2, 10)):
        df.where(F.minute("at").between(low, high - 1)).write.mode("append").parquet(source)
        out = jobs.rate_stream(spark.readStream.schema(df.schema).parquet(source), folder, "at", "who", F.col("creates"), limits=limits, late="1 minute")
    got = {(r["window_start"].minute, r["who"]): (r["requests"], r["creates"], r["overall"], r["limit_hit"]) for r in out.collect()}
    assert got == {
        (0, "a"): (6, 0, 11, "overall"), (0, "b"): (5, 5, 11, "overall"), (1, "a"): (4, 0, 5, "client"), (1, "b"): (1, 1, 5, None),
        (2, "a"): (2, 2, 4, "create"), (2, "b"): (2, 0, 4, None), (3, "a"): (1, 1, 2, None), (3, "b"): (1, 0, 2, None),
    }
    whole = jobs.rate_verdicts(jobs.rate_counts(df, "at", "who", F.col("creates")), limits)
    assert {(r["window_start"].minute, r["who"]): r["limit_hit"] for r in whole.where("who <> 'z'").collect()} == {k: x[3] for k, x in got.items()}
    assert jobs.LIMITS == {"overall": 1000, "client": 120, "create": 20}


def test_shuffled_batches_and_late_rows(spark, tmp_path):
    rows = [(u, at(i), i, f"{(i // 3) % 2}") for i in range(30) for u in (1, 2, None)]
    df = spark.createDataFrame(rows, "u int, at timestamp, i int, s string")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    late = spark.createDataFrame([(1, at(2), 2, "late"), (1, at(19), 19, "again")], df.schema)
    for low, high, extra in ((0, 20, None), (20, 30, late)):
        part = df.where(F.col("i").between(low, high - 1)).orderBy(F.desc("i"))
        (part if extra is None else part.unionByName(extra)).coalesce(1).write.mode("append").parquet(source)
        out = jobs.change_stream(spark.readStream.schema(df.schema).parquet(source), "u", "at", "i", "s", folder, buckets=4)
    want = series.state_changes(df, "u", ["at", "i"], "at", "s").where("changed").select("u", "i")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(out.select("u", "i").collect()) == order(want.collect())


def held(folder):
    """Bucket files below a folder and their bytes, by the batch that wrote them."""
    out = {}
    for path, _, names in os.walk(f"{folder}/rows"):
        for name in names:
            if name.endswith(".parquet"):
                writer = int(path.split("writer=")[1].split("/")[0])
                out.setdefault(writer, []).append(os.path.getsize(f"{path}/{name}"))
    return out


@pytest.fixture
def table(spark, tmp_path):
    return state.KeyedTable(str(tmp_path / "t"), spark.createDataFrame([], ROW).schema, "id", 8)


def put(spark, table, number, rows):
    batch = spark.createDataFrame(rows, ROW)
    table.update(batch, number, lambda old: tb.upsert(old, batch, "id", "at"))


def content(spark, table):
    return sorted(map(tuple, table.latest(spark).collect()), key=str)


def test_state_follows_the_batch(spark, table):
    want = {i: (i, 0, "first") for i in range(400)}
    put(spark, table, 0, list(want.values()))
    first = held(table.folder)
    assert len(first[0]) == 8
    for n in range(1, 14):
        row = (n % 3, n, f"batch {n}")
        want[row[0]] = row
        put(spark, table, n, [row])
        assert len(held(table.folder)[n]) == 1  # one key, one bucket
    assert content(spark, table) == sorted(want.values(), key=str)
    # Two versions at most of any bucket stay: eight of the newest state, and what the one before still names.
    assert sum(map(len, held(table.folder).values())) <= 9
    assert len(os.listdir(f"{table.folder}/manifests")) <= 2


def test_repeated_batch_gives_the_same_state(spark, table):
    put(spark, table, 0, [(1, 1, "a"), (2, 1, "b")])
    put(spark, table, 1, [(1, 2, "c"), (None, 1, "n")])
    put(spark, table, 2, [(2, 2, "d")])
    once = content(spark, table)
    for _ in range(2):
        put(spark, table, 2, [(2, 2, "d")])
        assert content(spark, table) == once == [(1, 2, "c"), (2, 2, "d"), (None, 1, "n")]


def test_empty_batches_and_keys_that_go(spark, table):
    put(spark, table, 0, [])
    assert content(spark, table) == []
    put(spark, table, 1, [(1, 1, "a"), (2, 1, "b")])
    put(spark, table, 2, [])
    assert content(spark, table) == [(1, 1, "a"), (2, 1, "b")]
    gone = spark.createDataFrame([(1, 9, "gone")], ROW)
    table.update(gone, 3, lambda old: tb.remove(old, gone, "id"))
    assert content(spark, table) == [(2, 1, "b")]
    everything = spark.createDataFrame([(2, 9, "gone")], ROW)
    table.update(everything, 4, lambda old: tb.remove(old, everything, "id"))
    assert content(spark, table) == []
    put(spark, table, 5, [(7, 1, "new")])
    assert content(spark, table) == [(7, 1, "new")]
    assert sorted(r[0] for r in table.before(spark, 6, spark.createDataFrame([(7,)], "id bigint")).select("id").collect()) == [7]
