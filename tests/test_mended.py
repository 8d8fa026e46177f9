"""Cases that once gave wrong values: cut scans over times, NULL and NaN, grids with gaps, days and a seam, requests without data."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from gridweather import session
from gridweather.operators import lookup as lk, sampling as sm, tables as tb
from gridweather.operators.ordered import ordered_scan

START = dt.datetime(2025, 5, 1)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_cut_scan_of_every_order(spark, kind, keys):
    special = [None, float("nan"), float("inf"), float("-inf")]

    def value(i):
        if i % 11 == 0:
            return None
        if kind == "double":
            return special[i % 4] if i % 7 == 0 else float(i * 37 % 100)
        at = START + dt.timedelta(hours=i * 37 % 400)
        return at.date() if kind == "date" else at

    df = spark.createDataFrame([(i % 3 and 1, value(i), i) for i in range(200)], f"k int, t {kind}, i int")
    got = ordered_scan(df, keys, ["t", "i"], "t", sums={"s": F.col("i")}, rank="n", prev={"p": "i"}, fill={"f": "i"}, rows_per_block=9)
    w = Window.partitionBy(*keys).orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("i").over(upto), "n": F.row_number().over(w), "p": F.lag("i").over(w), "f": F.last("i", ignorenulls=True).over(upto)})
    columns = ["i", "s", "n", "p", "f"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def grid_of(spark, values, lons, day=None):
    rows = [(t, level, la, lo, 3600.0 * t, 10.0 * la, lons[lo], p, v, 1.0, 2.0, 9.80665 * z) for (t, la, lo), v in values.items() for level, p, z in ((1, 1000.0, 0.0), (2, 900.0, 1000.0))]
    df = spark.createDataFrame(rows, "time_i int, level_i int, lat_i int, lon_i int, t_sec double, lat double, lon double, level_hpa double, t_k double, u_mps double, v_mps double, z_m2s2 double")
    return df if day is None else df.withColumn("day", F.lit(day))


def asked(spark, *rows):
    return spark.createDataFrame(rows, "q int, lat double, lon double, t_query double, h double")


CUBE = {(t, la, lo): 280.0 for t in (0, 1) for la in (0, 1) for lo in (0, 1)}


def test_absent_corner_and_equal_queries(spark):
    q = asked(spark, (1, 5.0, 36.0, 1800.0, 500.0), (1, 5.0, 36.0, 1800.0, 500.0), (2, 0.0, 0.0, 0.0, 500.0))
    grid = grid_of(spark, CUBE, [0.0, 72.0])
    out = lk.exact_lookup(q, grid, lk.grid_axes(grid), "h").collect()
    assert sorted((r["q"], r["t_k"]) for r in out) == [(1, 280.0), (1, 280.0), (2, 280.0)]
    gap = grid.where("not (time_i = 1 and lat_i = 1 and lon_i = 1)")
    wide = {r["q"]: r["t_k_1"] for r in lk.interpolated_columns(q, gap, lk.grid_axes(gap)).collect()}
    assert math.isnan(wide[1]) and math.isnan(wide[2])  # a corner of no weight counts too


def test_seam(spark):
    grid = grid_of(spark, {(0, 0, lo): 100.0 * lo for lo in range(4)}, [0.0, 90.0, 180.0, 270.0])
    q = asked(spark, (1, 0.0, 315.0, 0.0, 0.0), (2, 0.0, -45.0, 0.0, 0.0), (3, 0.0, 135.0, 0.0, 0.0), (4, 0.0, 360.0, 0.0, 0.0))
    got = {r["q"]: r["t_k"] for r in lk.exact_lookup(q, grid, lk.grid_axes(grid), "h", wrap_lon=True).collect()}
    assert got == {1: 150.0, 2: 150.0, 3: 150.0, 4: 0.0}


def test_nearest_follows_the_grid(spark):
    grid = grid_of(spark, {(0, 0, lo): 100.0 * lo for lo in range(4)}, [-180.0, -90.0, 0.0, 90.0])
    got = lk.nearest_cells(asked(spark, (1, 0.0, -170.0, 0.0, 0.0)), lk.grid_axes(grid)).collect()
    assert got[0]["lon_i"] == 0


def test_several_days(spark):
    one, two = grid_of(spark, CUBE, [0.0, 72.0], "d1"), grid_of(spark, {k: 200.0 for k in CUBE}, [0.0, 72.0], "d2")
    grid = one.union(two)
    q = asked(spark, (1, 5.0, 36.0, 1800.0, 500.0)).withColumn("day", F.lit("d1")).union(asked(spark, (2, 5.0, 36.0, 1800.0, 500.0)).withColumn("day", F.lit("d2")))
    axes = lk.grid_axes(grid)
    assert {r["q"]: round(r["t_k"], 9) for r in lk.exact_lookup(q, grid, axes, "h").collect()} == {1: 280.0, 2: 200.0}
    assert {r["q"]: r["profile"][0]["t_k"] for r in lk.nearest_profiles(q, grid, axes).collect()} == {1: 280.0, 2: 200.0}
    with pytest.raises(Exception, match="several values for one grid cell"):
        lk.exact_lookup(q.drop("day"), grid.drop("day"), axes, "h").collect()


def test_table_with_a_gap(spark):
    table = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)], "a_i int, b_i int, x double")
    axis = lk.Axis((0.0, 1.0))
    q = spark.createDataFrame([(1, 0.5, 0.5)], "i int, a double, b double")
    assert math.isnan(lk.table_lookup(q, table, axis, axis, "a", "b", ["x"], "i").first()["x"])


def test_every_request_is_answered_or_rejected(spark):
    requests = spark.createDataFrame([(1, "api", 1), (2, "API ", 9), (3, "other", 1), (4, None, 1)], "i int, source string, day int")
    good, bad = tb.route(requests, spark.createDataFrame([("api", 1, 5.0)], "provider string, day int, x double"), "source", "day")
    assert [r["i"] for r in good.collect()] == [1]
    assert {r["i"]: r["reason"] for r in bad.collect()} == {2: "no data from source: api", 3: "unsupported source: other", 4: "unsupported source: none"}


@pytest.mark.parametrize("master, local", [("local", True), ("local[8]", True), ("local[*,2]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)])
def test_only_local_sessions_get_a_folder(master, local):
    assert session.is_local(master) == local


def test_no_folder_on_a_cluster():
    class Settings:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Settings()
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Cluster())


def test_page_past_the_end_keeps_the_totals(spark):
    df = spark.range(25).withColumn("at", F.col("id") % 3)
    past = tb.page(df, "at", "id", 9, 10).collect()
    assert [(row["id"], row["total"], row["total_pages"]) for row in past] == [(None, 25, 3)]
    second = [row["id"] for row in tb.page(df, "at", "id", 2, 10).collect()]
    assert second == sorted(range(25), key=lambda i: (-(i % 3), -i))[10:20]
    assert [(row["total"], row["total_pages"]) for row in tb.page(df.where("false"), "at", "id").collect()] == [(0, 0)]


def test_small_subset_is_the_ranked_one(spark):
    df = spark.range(3_000).withColumnRenamed("id", "i")
    ids = [sorted(row["i"] for row in sm.subset(df, "i", 70, 5, **scan).collect()) for scan in ({}, {"rows_per_block": 500})]
    assert ids[0] == ids[1] and len(ids[0]) == 70


def test_table_lookup_by_plane(spark):
    axis = lk.Axis((0.0, 1.0))
    cells = [(a, b, k, float(10 * k + a + b)) for k in (1, 2) for a in (0, 1) for b in (0, 1)]
    q = spark.createDataFrame([(1, 0.5, 0.25)], "i int, a double, b double")
    made = lambda rows: {row["k"]: row["x"] for row in lk.table_lookup(q, spark.createDataFrame(rows, "a_i int, b_i int, k int, x double"), axis, axis, "a", "b", ["x"], "i", planes=["k"]).collect()}
    assert made(cells) == {1: 10.75, 2: 20.75}
    got = made(cells[:-1])
    assert got[1] == 10.75 and math.isnan(got[2])


def test_tiles_meet_every_corner(spark):
    """Against eight corner rows and their weights, for axes up and down, with the seam closed and open, and gaps."""
    rng = random.Random(5)
    for lons in ([0.0, 90.0, 180.0, 270.0], [270.0, 180.0, 90.0, 0.0], [10.0, 20.0]):
        values = {(t, la, lo): rng.uniform(200.0, 300.0) for t in (0, 1) for la in (0, 1) for lo in range(len(lons))}
        grid = grid_of(spark, values, lons).where("not (time_i = 1 and lat_i = 0 and lon_i = 1)")
        axes = lk.grid_axes(grid)
        q = asked(spark, *[(i, rng.uniform(-5, 15), rng.uniform(0, 360), rng.uniform(0, 4000), 0.0) for i in range(60)])
        for wrap in (False, True):
            corners = lk.corner_weights(q, axes, wrap_lon=wrap).join(grid.where("level_i = 1").select(*lk.CELL, "t_k"), lk.CELL, "left")
            want = {r["q"]: r["x"] for r in corners.groupBy("q").agg(F.sum(F.col("w") * F.coalesce("t_k", F.lit(float("nan")))).alias("x")).collect()}
            got = {r["q"]: r["levels"][0]["t_k"] for r in lk.interpolated_profiles(q, grid, axes, wrap_lon=wrap).collect()}
            assert want.keys() == got.keys()
            assert all(math.isnan(got[k]) if math.isnan(x) else math.isclose(got[k], x, abs_tol=1e-9) for k, x in want.items())


def test_unmet_requests_say_why(spark):
    grid = grid_of(spark, CUBE | {(0, 0, 2): None, (1, 0, 2): None, (0, 1, 2): None, (1, 1, 2): None}, [0.0, 72.0, 144.0])
    axes = lk.grid_axes(grid)
    two_days = grid.withColumn("day", F.lit("d1"))
    q = asked(spark, (1, 5.0, 36.0, 0.0, 100.0), (2, 5.0, 144.0, 0.0, 100.0)).withColumn("day", F.lit("d1"))
    q = q.union(asked(spark, (3, 5.0, 36.0, 0.0, 100.0)).withColumn("day", F.lit("d9")))
    want = {1: None, 2: lk.NO_LEVEL, 3: lk.NO_CELL}
    exact = lk.exact_lookup(q, two_days, axes, "h").collect()
    assert {r["q"]: r["reason"] for r in exact} == want and {r["q"]: r["t_k"] is None for r in exact} == {1: False, 2: True, 3: True}
    near = lk.at_height(lk.nearest_profiles(q, two_days, axes), "h").collect()
    assert {r["q"]: r["reason"] for r in near} == want and {r["q"]: r["t_k"] is None for r in near} == {1: False, 2: True, 3: True}
    steps = lk.resampled_profiles(q, two_days, axes, [0.0, 500.0]).collect()
    assert Counter((r["q"], r["reason"]) for r in steps) == {(1, None): 2, (2, lk.NO_LEVEL): 1, (3, lk.NO_CELL): 1}
    levels = lk.nearest_columns(q, two_days, axes).collect()
    assert {r["q"]: r["reason"] for r in levels} == {1: None, 2: None, 3: lk.NO_CELL}


def test_exact_lookup_joins_once_and_aggregates_no_query(spark):
    """The queries travel in one narrow join; the only aggregates are those that build columns of air and tiles."""
    grid = grid_of(spark, CUBE, [0.0, 72.0])
    q = asked(spark, (1, 5.0, 36.0, 1800.0, 500.0))
    tiles = lk.halo_tiles(grid, lk.grid_axes(grid)).cache()
    plan = lk.exact_lookup(q, grid, lk.grid_axes(grid), "h", tiles=tiles)._jdf.queryExecution().optimizedPlan().toString()
    before_tiles = plan.split("InMemoryRelation")[0]
    assert before_tiles.count("Join") == 1 and "Aggregate" not in before_tiles


def test_two_values_are_noticed_beside_an_absent_level(spark):
    grid = grid_of(spark, CUBE, [0.0, 72.0])
    twice = grid.where("level_i = 1").union(grid.where("level_i = 1"))
    axes = lk.grid_axes(grid)
    with pytest.raises(Exception, match="several values for one grid cell"):
        lk.exact_lookup(asked(spark, (1, 5.0, 36.0, 1800.0, 500.0)), twice, axes, "h").collect()
