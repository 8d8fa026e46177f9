"""Small cases with answers worked out by hand."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridweather.functions import features as ft, scalars as s
from gridweather.operators import lookup as lk, metrics as mt, models as ml, neighbours as nn, sampling as sm, series, stats, tables as tb, validate as vd
from gridweather.sources import readers as rd
from gridweather.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize(
    "axis, x, want",
    [
        ((0, 72, 144), 90.0, (1, 2, 0.25)),
        ((0, 72, 144), 144.0, (2, 2, 0.0)),
        ((0, 72, 144), 200.0, (2, 2, 0.0)),
        ((90, 45, 0), 54.0, (1, 0, 0.2)),
        ((90, 45, 0), 95.0, (0, 0, 0.0)),
        ((0, 1, 5, 6), 4.0, (1, 2, 0.75)),
        ((7,), 3.0, (0, 0, 0.0)),
    ],
)
def test_bracket(spark, axis, x, want):
    df = lk.Axis(tuple(map(float, axis))).bracket(spark.range(1), F.lit(x), "b")
    b = df.first()["b"]
    assert (b["lo"], b["hi"]) == want[:2] and close(b["frac"], want[2])


@pytest.mark.parametrize("axis", [tuple(i * 0.25 for i in range(1440)), tuple(90 - i * 0.25 for i in range(721)), (0.0, 1.0, 1.5, 9.0)])
def test_axis_against_search(spark, axis):
    xs = [v + e for v in axis[:: max(1, len(axis) // 40)] for e in (-1e-9, 0.0, 1e-9, 0.1, 0.125)] + [-500.0, 500.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    a = lk.Axis(axis)
    out = a.nearest(a.bracket(df, "x", "b"), "x", "n").collect()
    asc = sorted(axis)
    for r in out:
        x = min(max(r["x"], asc[0]), asc[-1])
        count = sum(v <= x for v in asc)
        lo, hi = (len(asc) - 1,) * 2 if count == len(asc) else (count - 1, count)
        if a.descending:
            lo, hi = len(asc) - 1 - lo, len(asc) - 1 - hi
        assert (r["b"]["lo"], r["b"]["hi"]) == (lo, hi)
        gaps = [abs(v - r["x"]) for v in axis]
        assert r["n"] == gaps.index(min(gaps))


def test_nearest_tie_takes_lower_index(spark):
    assert lk.Axis((0.0, 72.0)).nearest(spark.range(1), F.lit(36.0), "n").first()["n"] == 0
    assert lk.Axis((72.0, 0.0)).nearest(spark.range(1), F.lit(36.0), "n").first()["n"] == 0


def test_table_bracket_top_edge(spark):
    b = lk.Axis((0.0, 1.0, 2.0)).table_bracket(spark.range(1), F.lit(2.0), "b").first()["b"]
    assert tuple(b) == (1, 2, 1.0)
    with pytest.raises(ValueError):
        lk.Axis((1.0,)).table_bracket(spark.range(1), F.lit(2.0), "b")


@pytest.mark.parametrize("pressure, want", [("log", math.sqrt(1e5 * 9e4)), ("linear", 95000.0)])
def test_vertical_pressure(spark, pressure, want):
    values = [(1, 1000.0, 280.0, 1.0, 2.0, 0.0), (2, 900.0, 270.0, 3.0, 4.0, 1000.0 * s.G0), (3, 800.0, None, 3.0, 4.0, 600.0 * s.G0), (4, 700.0, 1.0, 1.0, 1.0, 0.0)]
    rows = [(0, 0, 0, 0.0, 0.0, 0.0, *v) for v in values]
    g = spark.createDataFrame(rows, "time_i int, lat_i int, lon_i int, t_sec double, lat double, lon double, level_i int, level_hpa double, t_k double, u_mps double, v_mps double, z_m2s2 double")
    q = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 500.0)], "obs_id int, t_query double, lat double, lon double, altitude_m double")
    # The level without a temperature and the second level at height 0 do not count.
    got = lk.at_height(lk.nearest_profiles(q, g, lk.grid_axes(g)), "altitude_m", pressure).first()
    assert close(got["p_pa"], want) and close(got["t_k"], 275.0) and got["near_z_m"] == 0.0
    assert tuple(lk.exact_lookup(q, g, lk.grid_axes(g), "altitude_m", pressure=pressure).select("t_k", "p_pa").first()) == (got["t_k"], got["p_pa"])


def grid_of(spark, value):
    rows = [
        (t, lev, y, x, t * 3600.0, 10.0 - 10.0 * y, 90.0 * x, 1000.0 / lev, value(t, lev, y, x), 0.0, 0.0, 9.80665 * 1000.0 * (lev - 1))
        for t in range(3) for lev in (1, 2) for y in range(3) for x in range(4)
    ]
    names = "time_i int, level_i int, lat_i int, lon_i int, t_sec double, lat double, lon double, level_hpa double, t_k double, u_mps double, v_mps double, z_m2s2 double"
    return spark.createDataFrame(rows, names)


def test_lookup_at_a_node_returns_the_node_and_weights_sum_to_one(spark):
    g = grid_of(spark, lambda t, lev, y, x: 100.0 * t + 10.0 * lev + 3.0 * y + x)
    axes = lk.grid_axes(g)
    q = spark.createDataFrame([(1, 3600.0, 0.0, 90.0, 1000.0), (2, 9999.0, 3.3, 200.0, 10.0), (3, 1800.0, -99.0, -10.0, 5e4)], "obs_id int, t_query double, lat double, lon double, altitude_m double")
    weights = {r["obs_id"]: r["w"] for r in lk.corner_weights(q, axes).groupBy("obs_id").agg(F.sum("w").alias("w")).collect()}
    assert all(close(w, 1.0) for w in weights.values()) and len(weights) == 3
    got = {r["obs_id"]: r for r in lk.exact_lookup(q, g, axes, "altitude_m").collect()}
    assert close(got[1]["t_k"], 100.0 + 20.0 + 3.0 + 1.0)
    # Past the last hour, the southern edge and beyond 270 degrees the values are held.
    assert close(got[3]["t_k"], 50.0 + 20.0 + 6.0 + 3.0) and close(got[3]["clipped_m"], 1000.0)


def test_missing_corner_drops_the_level(spark):
    g = grid_of(spark, lambda t, lev, y, x: None if (t, lev, y, x) == (0, 1, 0, 0) else 1.0)
    q = spark.createDataFrame([(1, 0.0, 9.0, 10.0, 0.0)], "obs_id int, t_query double, lat double, lon double, altitude_m double")
    got = lk.exact_lookup(q, g, lk.grid_axes(g), "altitude_m").first()
    assert close(got["clipped_m"], 1000.0)


def test_wrapped_longitude(spark):
    axis = lk.Axis((0.0, 90.0, 180.0, 270.0))
    assert close(one(spark, lk.grid_lon(F.lit(-30.0), axis).alias("x"))["x"], 330.0)
    assert close(one(spark, lk.grid_lon(F.lit(725.0), axis, wrap=True).alias("x"))["x"], 5.0)


def test_as_of(spark):
    rec = spark.createDataFrame([(1, 10.0, "a"), (1, 20.0, "b")], "k int, x double, p string")
    ask = spark.createDataFrame([(1, 5.0, 1), (1, 10.0, 2), (1, 19.0, 3), (1, 25.0, 4)], "k int, x double, i int")
    for n in (1, 100):
        got = {r["i"]: r["record_p"] for r in series.as_of(ask, rec, "k", "x", "i", ["p"], rows_per_block=n).collect()}
        assert got == {1: "a", 2: "a", 3: "a", 4: "b"}


def test_inverse_distance(spark):
    near = spark.createDataFrame([(1, 1.0, 7.0), (1, 4.0, 0.0), (1, 16.0, 0.0)], "query_id int, sq_distance double, y double")
    assert close(nn.inverse_distance_mean(near, ["y"]).first()["y"], 4.0)


def test_budgets(spark):
    slices = spark.createDataFrame([(t, lev, w) for t in (0, 1) for lev, w in ((1, 0.5), (2, 0.3), (3, 0.2))], "time_i int, level_i int, w double")
    got = sm.level_budget(slices, [], F.lit(10), F.lit(2), "w").orderBy("time_i", "level_i").collect()
    assert [r["budget"] for r in got] == [3, 2, 1, 2, 1, 1]
    four = spark.createDataFrame([(i,) for i in range(4)], "i int")
    assert [r["budget"] for r in sm.even_budget(four, [], F.lit(10), ["i"]).orderBy("i").collect()] == [3, 3, 2, 2]


def test_splits_and_caps(spark):
    df = spark.range(10).select("id", F.lit(1).alias("day"))
    sizes = {r["split"]: r["count"] for r in sm.ratio_split(df, "day", "id", 1, 0.85, 0.10).groupBy("split").count().collect()}
    assert sizes == {"train": 8, "val": 1, "test": 1}
    days = spark.range(15).select((F.col("id") % 3).alias("day"))
    assert sorted(r["day"] for r in sm.days_until_cap(days, "day", 6).collect()) == [0, 1]


def test_bands_and_profile(spark):
    r = one(spark, mt.band_of(F.lit(2000.0)).alias("a"), mt.band_of(F.lit(32000.0)).alias("b"))
    assert r["a"] == "low_trop_2_5km" and r["b"] is None
    df = spark.range(11).select(F.lit("t").alias("k"), F.col("id").cast("double").alias("x"))
    got = {r["bin"]: r["count"] for r in mt.error_profile(df, "k", "x", F.col("x"), 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_published_event_scores(spark):
    cells = [(False, False, 21035), (False, True, 1437), (True, False, 1929), (True, True, 22099)]
    df = spark.createDataFrame(cells, "y boolean, p boolean, n int").select("y", "p", F.explode(F.sequence(F.lit(1), "n")))
    got = mt.event_scores(df, F.col("y"), F.col("p")).first()
    assert (round(got["precision"], 6), round(got["recall"], 6), round(got["f1"], 6)) == (0.938945, 0.919719, 0.929232)


def test_curve_case(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.8), (True, 0.3)], "y boolean, s double")
    curve = mt.threshold_curve(df, F.col("y"), F.col("s"))
    assert close(mt.area_under_roc(curve).first()[0], 0.5) and close(mt.average_precision(curve).first()[0], 5 / 6)


def test_envelope_case(spark):
    df = spark.createDataFrame([(10.6,), (10.4,)], "x double")
    bounds = stats.envelope(spark.createDataFrame([(0.0,), (10.0,)], "x double"), ["x"])
    got = {r["x"]: r["outside"] for r in vd.envelope_flag(df, bounds, ["x"]).collect()}
    assert got == {10.6: True, 10.4: False}


def test_resample_cases(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 3.0, 0.0)], "k int, seq int, x double, z double")
    ends = series.resample(df, "k", "seq", "x", "z", least=2, most=2).orderBy("point").collect()
    assert [r["x"] for r in ends] == [0.0, 3.0]
    assert series.resample(df, "k", "seq", "x", "z", least=3, most=3).count() == 3
    flat = spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("seq"), F.lit(5.0).alias("x"), F.lit(5.0).alias("z"))
    assert series.resample(flat, "k", "seq", "x", "z", least=4, most=4).count() == 4


def test_crossing_case(spark):
    df = spark.createDataFrame([(1, i, float(i), z) for i, z in enumerate((10.0, 4.0, -4.0))] + [(2, 0, 0.0, -1.0), (2, 1, 1.0, -2.0)], "k int, seq int, x double, z double")
    got = series.first_down_crossing(df, "k", "seq", "x", "z", 0.0).collect()
    assert [(r["k"], r["index_before"], r["index_after"], r["fraction"]) for r in got] == [(1, 1, 2, 0.5)]


def test_scalar_cases(spark):
    t, p, _ = s.standard_atmosphere(F.lit(11000.0), F.lit(288.15), F.lit(101325.0))
    east, north = s.wind_from(F.lit(10.0), F.lit(270.0))
    r = one(
        spark, s.solar_hour(F.lit(1.0), F.lit(-30.0)).alias("solar"), east.alias("east"), north.alias("north"), s.shear_exponent(F.lit(5.0), F.lit(10.0)).alias("alpha"),
        t.alias("t"), s.bucket(F.lit(31.625), 0.25).alias("bucket"), s.duration_text(F.lit(125.9)).alias("d"), s.duration_text(F.lit(0.0)).alias("d0"),
        s.wrap_angle(F.lit(math.pi)).alias("wrap"), s.round_half_up_2(F.lit(1.125)).alias("half"),
    )
    assert close(r["solar"], 23.0) and close(r["east"], 10.0) and close(r["north"], 0.0) and close(r["alpha"], math.log10(2))
    assert close(r["t"], 216.65) and r["bucket"] == 126 and (r["d"], r["d0"]) == ("2:05", "0:00") and close(r["wrap"], -math.pi) and r["half"] == 1.13


def test_feature_counts(spark):
    zero = F.lit(0.0)
    assert len(ft.weather_features(zero, zero, zero, zero, zero)) == 42
    assert len(ft.weather_features(zero, zero, zero, zero, zero, plan=ft.FeaturePlan(annual=0))) == 38
    assert len(ft.tree_features(zero, zero, zero, zero, zero, zero)) == 31
    assert [ft.annual_harmonics_for(m) for m in ([], [5], [5, 6], [5, 7], [1, 2, 3])] == [0, 0, 0, 2, 2]


def test_bad_records(spark):
    rule = vd.RecordRule({"lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}, {"src": (["a", "b"], "a")})
    bodies = {
        '{"lat":1,"lon":2}': [], '{"lon":2}': ["lat missing"], '{"lat":"1","lon":2}': ["lat not a number"], '{"lat":999,"lon":2,"x":1}': ["lat above 90", "unknown x"],
        '{"lat":null,"lon":2,"src":"c"}': ["lat not a number", "src not allowed"], "{}": ["lat missing", "lon missing"], "[1]": ["not an object"], "{bad": ["not an object"],
    }
    df = spark.createDataFrame([(b,) for b in bodies], "js string")
    for r in vd.check_records(df, "js", rule).collect():
        assert [x for x in r["reasons"] if x] == bodies[r["js"]], r["js"]
        assert (r["record"] is not None) == (not bodies[r["js"]])


@pytest.mark.parametrize("page, size", [(1, 100000), (1, -1), ("abc", 10), (0, 10), (True, 10)])
def test_bad_pages(spark, page, size):
    with pytest.raises(ValueError):
        tb.page(spark.range(3).withColumn("at", F.lit(1)), "at", "id", page, size)


def test_missing_sources(spark, tmp_path):
    assert rd.read_months(spark, str(tmp_path / "none"), 2025, [5], "a int").count() == 0
    with pytest.raises(ValueError):
        rd.held_out_day(spark.createDataFrame([(dt.date(2025, 5, 1),)], "day date"), "day", "2025-06-01")
    with pytest.raises(ValueError):
        rd.canonical_columns(spark.createDataFrame([(1,)], "a int"), ["t"])


def test_month_read_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2025, m, 1),) for m in (4, 5, 6)], "date date")
    rd.write_days(df, str(tmp_path / "days"), F.col("date"))
    found = rd.read_months(spark, str(tmp_path / "days"), 2025, [5], "date date")
    assert [r["month"] for r in found.collect()] == [5] and len(found.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()


def test_moments_merge_like_one_pass(spark):
    df = spark.range(100).select((F.col("id") * F.col("id") % 37).cast("double").alias("x"))
    parts = stats.moments(df.where("id < 30"), ["x"]).unionByName(stats.moments(df.where("id >= 30"), ["x"]))
    got = stats.std_from_moments(stats.merge_moments(parts)).first()
    want = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).first()
    assert got["n"] == 100 and close(got["mean"], want["m"]) and close(got["std"], want["sd"])


def test_model_without_fallback_is_refused(spark):
    df = spark.createDataFrame([("2025-06", 1.0)], "month string, x double")
    with pytest.raises(ValueError):
        ml.predict_by_month(df, "month", {}, ["2025-05"])


def test_stream_equals_batch_after_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(u, dt.datetime(2025, 5, 1, 0, i), i, f"{(i // 3) % 2}") for i in range(30) for u in (1, 2)]
    df = spark.createDataFrame(rows, "u int, at timestamp, i int, s string")
    for low in (0, 7, 20):
        high = {0: 7, 7: 20, 20: 30}[low]
        df.where((F.col("i") >= low) & (F.col("i") < high)).write.mode("append").parquet(source)
        out = jobs.change_stream(spark.readStream.schema(df.schema).parquet(source), "u", "at", "i", "s", folder)
    want = series.state_changes(df, "u", ["at", "i"], "at", "s").where("changed").select("u", "i")
    assert sorted(map(tuple, out.select("u", "i").collect())) == sorted(map(tuple, want.collect()))


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 500), st.lists(st.integers(0, 9), min_size=1, max_size=6).filter(any))
def test_budget_always_sums_to_total(spark, total, weights):
    slices = spark.createDataFrame([(0, i, float(w)) for i, w in enumerate(weights)], "time_i int, level_i int, w double")
    got = sm.level_budget(slices, [], F.lit(total), F.lit(1), "w").agg(F.sum("budget")).first()[0]
    assert got == total


def test_shuffled_grid_gives_the_same_values(spark, monkeypatch):
    g = grid_of(spark, lambda t, lev, y, x: 100.0 * t + 10.0 * lev + 3.0 * y + x)
    axes = lk.grid_axes(g)
    q = spark.range(200).select(
        F.col("id").alias("obs_id"), (F.col("id") * 37.0 % 7200).alias("t_query"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") % 20 - 10.0).alias("lat"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 7.0 % 360).alias("lon"), (F.col("id") * 11.0 % 1200).alias("altitude_m"),
    )

    def answers():
        exact = lk.exact_lookup(q, g, axes, "altitude_m").select("obs_id", *[F.round(n, 9) for n in ("t_k", "p_pa", "clipped_m")])
        near = lk.at_height(lk.nearest_profiles(q, g, axes), "altitude_m").select("obs_id", F.round("t_k", 9))
        return sorted(map(tuple, exact.collect())), sorted(map(tuple, near.collect())), near._jdf.queryExecution().toString()

    small = answers()
    monkeypatch.setattr(lk, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = answers()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small[2] and "SortMergeJoin" in large[2]
    assert len(small[0]) == 200 and small[:2] == large[:2]
