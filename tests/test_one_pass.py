"""Aggregates in one pass: the number of scans in the plan, and the same values as branch by branch."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweather.llm import pieces
from gridweather.operators import lookup as lk, metrics as mt, neighbours as nn, series


def scans(df):
    """How often the plan reads the files of its table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture
def errors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{i % 3}" if i % 7 else None, rng.uniform(0, 50), rng.choice([None, 0.0, 23.75, rng.uniform(-1, 25)]), rng.gauss(0, 2)) for i in range(2_000)]
    spark.createDataFrame([*rows, ("far", 10.0, 99.0, 1.0)], "k string, a double, h double, e double").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_profiles_of_all_axes(errors):
    axes = {"a": (5, None, None), "h": (24, 0.0, 24.0)}
    out = mt.error_profiles(errors, "k", axes, F.col("e"))
    got = {(r["axis"], r["k"], r["bin"]): (r["count"], r["mean_abs_error"]) for r in out.collect()}
    rows = errors.collect()
    ends = {"a": (min(r["a"] for r in rows), max(r["a"] for r in rows)), "h": (0.0, 24.0)}
    for axis, (bins, _, _) in axes.items():
        low, high = ends[axis]
        for key in (None, "k0", "k1", "k2", "far"):
            mine = [(min(bins - 1, int((r[axis] - low) / ((high - low) / bins))), abs(r["e"])) for r in rows if r["k"] == key and r[axis] is not None and low <= r[axis] <= high]
            for b in range(bins):
                here = [e for i, e in mine if i == b]
                n, mean = got.pop((axis, key, b))
                assert n == len(here) and (mean is None) == (not here) and (not here or abs(mean - np.mean(here)) < 1e-9)
    assert not got
    assert scans(out) == 2 and scans(mt.error_profile(errors, "k", "h", F.col("e"), 24, 0.0, 24.0)) == 1


def walked(points, spacing, least, most):
    """Equal distances along one line, point by point."""
    if len(points) <= most:
        wanted = len(points)
    steps = [0.0, *np.hypot(*np.diff(np.array(points), axis=0).T)]
    length = np.cumsum(steps)
    wanted = min(most, max(least, int(length[-1] / spacing) + 1))
    if len(points) <= max(most, wanted):
        return dict(enumerate(points))
    if length[-1] <= 0:
        every = max(1, -(-(len(points) - 1) // max(1, wanted - 1)))
        picked = {-(-i // every): points[i] for i in range(len(points)) if i % every == 0 or i == len(points) - 1}
        return {p: q for p, q in picked.items() if p < wanted}
    goals = [length[-1] * i / (wanted - 1) for i in range(wanted)]
    return {i: (np.interp(g, length, [p[0] for p in points]), np.interp(g, length, [p[1] for p in points])) for i, g in enumerate(goals)}


def test_resample_in_one_pass(spark, tmp_path):
    rng = random.Random(5)
    tracks = {1: [(0.0, 0.0)] * 60, 2: [(float(i), 0.0) for i in range(12)], 3: [], 4: [(2.0, 1.0)]}
    x = 0.0
    for i in range(300):
        x += rng.choice([0.0, 0.5, 7.0])
        tracks[3].append((x, rng.uniform(0, 3)))
    rows = [(k, i, *p) for k, points in tracks.items() for i, p in enumerate(points)]
    spark.createDataFrame(rows, "k int, i int, x double, z double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = series.resample(df, "k", "i", "x", "z", spacing=5.0, least=10, most=20)
    got = {}
    for r in out.collect():
        assert got.setdefault(r["k"], {}).setdefault(r["point"], (r["x"], r["z"])) == (r["x"], r["z"])
    for k, points in tracks.items():
        want = walked(points, 5.0, 10, 20)
        assert set(got[k]) == set(want), k
        assert all(np.allclose(got[k][p], want[p]) for p in want), k
    assert out.count() == sum(map(len, got.values())) and scans(out) == 2


def test_slices_of_queries_see_the_same_regions(monkeypatch):
    rng = np.random.default_rng(1)
    stats = [{"_region": c * 65 + i, "n": 5, "near": float(i), "far": float(i + 1)} for c in range(4) for i in range(3)]
    facts, q = nn._RegionFacts(rng.normal(size=(4, 3)), stats, 7), rng.normal(size=(50, 3))
    kth = rng.uniform(0.5, 2, 50)
    whole = [facts.look(q), facts.look(q, kth)]
    monkeypatch.setattr(nn, "LOOK_CELLS", 36)
    for (a, b, c), (d, e, f) in zip(whole, [facts.look(q), facts.look(q, kth)]):
        assert np.array_equal(a, d) and b == e and c == f


def test_classes_are_counted_where_the_rows_lie(errors):
    out = mt.class_confusion(errors, "k", "a", "e")
    got = {(r["k"], r["true_bin"], r["predicted_bin"]): r["count"] for r in out.collect()}
    assert sum(got.values()) == errors.where("k is not null").count() and len(got) == 9 * 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The rows meet the edges in a broadcast join; the only join after a shuffle would be one of counts.
    assert "SortMergeJoin" not in plan.split("Final Plan")[-1].split("Initial Plan")[0]


def test_permuted_values_meet_their_row_in_blocks(spark):
    """Against places by hash worked out in plain Python; ids in clusters, some absent, few copies a block."""
    rng = random.Random(4)
    ids = [i if i % 3 else 10**9 + 7 * i for i in range(400)]
    rows = [(i, rng.uniform(0, 9), float(k % 5), rng.uniform(0, 9)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows + [(None, 50.0 + i, 60.0 + i, 1.0) for i in range(30)], "i bigint, a double, b double, y double").repartition(7)
    out = mt.permutation_importance(df, "i", ["a", "b"], ["y"], lambda d: d.withColumn("pred_y", F.col("a") * 2 - F.col("b")), 5, block_copies=60)
    hashes = {(s, i): int(hashlib.md5(f"{s}|{i}".encode()).hexdigest()[:15], 16) for s in (5, 6) for i in ids}
    by_id, lone = sorted(rows), [abs(2 * (50.0 + i) - (60.0 + i) - 1.0) for i in range(30)]
    want = {"": [abs(2 * a - b - y) for _, a, b, y in by_id]}
    for s, f in ((5, "a"), (6, "b")):
        moved = sorted(rows, key=lambda r: (hashes[s, r[0]], r[0]))
        want[f] = [abs(2 * (m[1] if f == "a" else a) - (m[2] if f == "b" else b) - y) for (_, a, b, y), m in zip(by_id, moved)]
    mean = {f: np.mean(e + lone) for f, e in want.items()}
    got = {r["feature"]: r for r in out.collect()}
    assert set(got) == {"a", "b"}
    for f, r in got.items():
        assert np.isclose(r["permuted_mae"], mean[f], rtol=1e-12) and np.isclose(r["baseline_mae"], mean[""], rtol=1e-12)


def test_permuted_values_are_shuffled_alone(spark):
    """One shuffle of rows: a value and its hash travel, not a copy of the row a feature."""
    df = spark.range(2000).select(F.col("id").alias("i"), *[F.rand(k).alias(f"f{k}") for k in range(6)], F.rand(9).alias("y"))
    out = mt.permutation_importance(df, "i", [f"f{k}" for k in range(6)], ["y"], lambda d: d.withColumn("pred_y", F.col("f0") + F.col("f5")), 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and out.count() == 6
    wide = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert not wide


def test_plane_lookup_adds_up_repeated_ids_only(spark):
    axis = lk.Axis((0.0, 1.0, 2.0))
    cells = spark.createDataFrame([(a, b, k, float(10 * k + a + b)) for k in (1, 2) for a in range(3) for b in range(3) if (a, b, k) != (2, 2, 2)], "a_i int, b_i int, k int, x double")
    q = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 1.5), (3, 0.5, 0.5), (3, 0.5, 0.5), (None, 2.0, 0.0), (5, None, 1.0)], "i int, a double, b double")
    out = lk.table_lookup(q, cells, axis, axis, "a", "b", ["x"], "i", planes=["k"])
    got = {(r["i"], r["k"]): r["x"] for r in out.collect()}
    assert len(got) == out.count() == 10  # a missing coordinate is held at the axis, as everywhere
    assert got[1, 1] == 10.75 and got[1, 2] == 20.75 and got[2, 1] == 13.0 and got[None, 1] == 12.0 and got[None, 2] == 22.0
    assert all(np.isnan(got[k]) for k in ((2, 2), (3, 1), (3, 2)))
    # Corners are not exploded from the queries: the queries meet tiles, and only repeated ids are dealt out by id.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_rare_words_do_not_push_out_common_ones(monkeypatch):
    monkeypatch.setattr(pieces, "KEEP", 40)
    model = pieces.Transducer(pieces.default_model())
    text = " ".join(f"xq{i}zv zqxjkvva" for i in range(200))
    solved, solve = [], model.solve
    monkeypatch.setattr(model, "solve", lambda word: solved.append(word) or solve(word))
    ids = model.encode(text)
    assert solved.count("▁zqxjkvva") == 1 and model.decode(ids) == text
    assert max(len(model.solved), len(model.older)) <= 20
