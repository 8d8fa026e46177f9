"""The cut forms of ordered scans, quantiles, curves, thinning and neighbour search against plain or brute-force answers.

One key holds most rows and the block sizes are tiny, so every carry between blocks is used.
"""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from gridweather.operators import metrics as mt, neighbours as nn, sampling as sm, series
from gridweather.operators.ordered import block_number, exact_quantiles, ordered_scan


def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 25)
        t = rng.choice([rng.random() ** 6 * 1e5, float(rng.randrange(5))])
        rows.append((key, t, i, rng.randrange(-50, 50), None if rng.random() < 0.6 else rng.randrange(1000)))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "k int, t double, i int, x int, f int").repartition(5).cache()


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("rows_per_block", [3, 40, 10_000])
def test_ordered_scan_equals_plain_window(hot, keys, rows_per_block):
    got = ordered_scan(
        hot, keys, ["t", "i"], "t", sums={"s": F.col("x")}, rank="rn", prev={"px": "x", "pt": "t"}, fill={"lf": "f"}, rows_per_block=rows_per_block
    )
    w = Window.partitionBy(*keys).orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumns(
        {
            "s": F.sum("x").over(upto), "rn": F.row_number().over(w).cast("bigint"), "px": F.lag("x").over(w), "pt": F.lag("t").over(w),
            "lf": F.last("f", ignorenulls=True).over(upto),
        }
    )
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_blocks_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted({rng.random() ** 8 for _ in range(500)})
    cuts = [values[int(i * 499 / 12)] for i in range(13)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", block_number(F.col("x"), cuts).alias("b"))
    blocks = [r["b"] for r in df.orderBy("x").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) > 50


@pytest.mark.parametrize("rows_per_block", [7, 100_000])
def test_quantiles_equal_numpy(hot, rows_per_block):
    qs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(hot, ["k"], F.col("t"), qs, rows_per_block).collect()}
    rows = hot_rows()
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        for name, q in qs.items():
            assert math.isclose(got[key][name], np.percentile(values, q * 100), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("rows_per_block", [5, 100_000])
def test_area_under_curve(spark, rows_per_block):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    curve = mt.threshold_curve(df, F.col("y"), F.col("s"), rows_per_block)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(mt.area_under_roc(curve).first()["auc"], want, rel_tol=1e-12)
    # A monotone map of the score changes nothing.
    bent = mt.threshold_curve(df, F.col("y"), F.exp(F.col("s") * 3), rows_per_block)
    assert math.isclose(mt.area_under_roc(bent).first()["auc"], want, rel_tol=1e-12)


def thin_by_hand(xs, dx):
    kept, last = [0], xs[0]
    for i, x in enumerate(xs):
        if x - last >= dx:
            kept.append(i)
            last = x
    return sorted({*kept, len(xs) - 1})


@pytest.mark.parametrize("rows_per_block", [1, 4, 9, 1000])
@pytest.mark.parametrize("shape", ["rising", "wild", "even", "flat"])
def test_thinning_equals_hand_walk(spark, rows_per_block, shape):
    rng = random.Random(rows_per_block)
    rows, want = [], set()
    for key, n in ((0, 70), (1, 3), (2, 1), (3, 19)):
        x, xs = 0.0, []
        for i in range(n):
            x = {"rising": x + rng.random() * 2, "wild": rng.uniform(0, 30), "even": float(i), "flat": float(i // 30)}[shape]
            xs.append(x)
        rows += [(key, i, v) for i, v in enumerate(xs)]
        want |= {(key, i) for i in thin_by_hand(xs, 2.5)}
    df = spark.createDataFrame(rows, "k int, seq int, x double")
    got = {(r["k"], r["seq"]) for r in series.thin_by_distance(df, "k", "seq", "x", 2.5, rows_per_block).collect()}
    assert got == want


def test_thinning_walk_over_many_batches(spark):
    """A slow track, whose moves fill many batches, and several tracks in one partition."""
    tracks = {"slow": [i * 0.01 + (i % 7) * 0.02 for i in range(600)], "still": [0.0] * 60, "fast": [i * 2.0 for i in range(60)], "short": [1.0, 9.0]}
    df = spark.createDataFrame([(k, i, x) for k, xs in tracks.items() for i, x in enumerate(xs)], "k string, seq int, x double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = {(r["k"], r["seq"]) for r in series.thin_by_distance(df, "k", "seq", "x", 2.5, 20).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == {(k, i) for k, xs in tracks.items() for i in {*thin_by_hand(xs, 2.5), len(xs) - 1}}


def test_walks_that_end_alike_are_one_move():
    """Entries a, a + 1, a + 2 all meet at the same goal beyond them, so the block has one move for them."""
    xs = [0.0, 1.0, 2.0, 100.0]
    block = pd.DataFrame({"k": 1, "_b": 1, "seq": range(4), "x": xs, "_last": -1.0, "_most": 200.0})
    moves = series._block_moves(5.0, "k", "x", "seq")(block)
    assert moves[["low", "high", "tail"]].values.tolist() == [[-math.inf, 100.0, 100.0]]



@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20).map(float), min_size=1, max_size=40), st.sampled_from([0.5, 1.0, 3.0, 11.0]))
def test_next_kept(xs, dx):
    want = [next((j for j in range(i + 1, len(xs)) if xs[j] >= xs[i] + dx), len(xs)) for i in range(len(xs))]
    assert series._next_kept(xs, dx) == want


@pytest.mark.parametrize("block_rows", [5, 40, 20_000])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    # A third of the training rows are copies of one point, and a third of the queries sit on it.
    train = np.concatenate([rng.normal(size=(120, 3)), np.repeat([[0.5, 0.5, 0.5]], 60, axis=0)])
    asked = np.concatenate([rng.normal(size=(25, 3)), np.repeat([[0.5, 0.5, 0.5]], 12, axis=0), [[40.0, 40.0, 40.0]]])
    t = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(train)], "train_id int, vec array<double>, y double")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vec array<double>")
    got = nn.nearest_neighbours(t, q, 7, carry=["y"], block_rows=block_rows)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["train_id"], r["y"])
    for i, point in enumerate(asked):
        d = ((train - point) ** 2).sum(1)
        want = sorted(range(len(train)), key=lambda j: (round(d[j], 12), j))[:7]
        assert [found[i][k + 1][0] for k in range(7)] == want
        assert all(found[i][k + 1][1] == float(found[i][k + 1][0]) for k in range(7))


def test_neighbours_of_long_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    train, asked = rng.normal(size=(300, nn.BOX_DIMS + 4)), rng.normal(size=(20, nn.BOX_DIMS + 4))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(train)], "train_id int, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["train_id"] for r in nn.nearest_neighbours(t, q, 4, block_rows=30).collect()}
    want = {(i, k + 1): int(j) for i, point in enumerate(asked) for k, j in enumerate(((train - point) ** 2).sum(1).argsort()[:4])}
    assert got == want


def test_neighbours_meet_no_more_rows_as_the_table_grows(spark, monkeypatch):
    """Eight times the rows, the same rows compared per query; caps on pivots, reached, do not matter for short vectors."""
    monkeypatch.setattr(nn, "MOST_PIVOTS", 4), monkeypatch.setattr(nn, "MOST_RINGS", 4)
    met, run = [], nn._Meeting.run

    def counted(self, visits):
        sizes = dict(zip(self.facts.region.tolist(), self.facts.size.tolist()))
        met[-1] += sum(sizes[g] for r in visits.select("_regions").collect() for g in r[0])
        return run(self, visits)

    monkeypatch.setattr(nn._Meeting, "run", counted)
    rng = np.random.default_rng(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.uniform(size=(100, 3)))], "query_id int, vec array<double>")
    for n in (2_000, 16_000):
        met.append(0)
        t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.uniform(size=(n, 3)))], "train_id int, vec array<double>")
        assert nn.nearest_neighbours(t, q, 4, block_rows=50).count() == 400
    assert met[1] < 2 * met[0]


def test_vectors_with_nulls_are_nobodys_neighbours(spark):
    rows = [(i, [float(i), 0.0]) for i in range(40)] + [(100, [None, 0.0]), (101, [float("nan"), 1.0]), (102, None)]
    t = spark.createDataFrame(rows, "train_id int, vec array<double>")
    q = spark.createDataFrame([(1, [7.2, 0.0]), (2, [None, 1.0])], "query_id int, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["train_id"] for r in nn.nearest_neighbours(t, q, 3, block_rows=5).collect()}
    assert got == {(1, 1): 7, (1, 2): 8, (1, 3): 6}


def test_neighbour_arguments(spark):
    t = spark.createDataFrame([(1, [0.0])], "train_id int, vec array<double>")
    q = spark.createDataFrame([(1, [0.0])], "query_id int, vec array<double>")
    for k in (0, 2):
        with pytest.raises(ValueError):
            nn.nearest_neighbours(t, q, k)


def test_path_and_crossing_in_blocks(spark):
    rng = random.Random(8)
    zs = [10 - 0.02 * i + rng.random() for i in range(900)]
    df = spark.createDataFrame([(1, i, float(i), z) for i, z in enumerate(zs)] + [(2, 0, 0.0, 1.0)], "k int, seq int, x double, z double")
    whole = series.path_length(df, "k", "seq", "x", "z")
    cut = series.path_length(df, "k", "seq", "x", "z", rows_per_block=20)
    a = {(r["k"], r["seq"]): r["length"] for r in whole.collect()}
    b = {(r["k"], r["seq"]): r["length"] for r in cut.collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9, abs_tol=1e-9) for i in a)
    for n in (20, 10_000):
        hit = series.first_down_crossing(df, "k", "seq", "x", "z", 5.0, rows_per_block=n).collect()
        first = next(i for i in range(1, 900) if zs[i - 1] > 5.0 >= zs[i])
        assert len(hit) == 1 and hit[0]["index_after"] == first


def test_split_and_design_in_blocks(spark):
    df = spark.range(700).select(F.col("id").alias("i"), F.when(F.col("id") < 500, 1).otherwise(F.col("id") % 7).alias("day"))
    for n in (30, 10_000):
        split = sm.ratio_split(df, "day", "i", 5, 0.85, 0.10, rows_per_block=n)
        sizes = {r["split"]: r["count"] for r in split.where("day = 1").groupBy("split").count().collect()}
        total = df.where("day = 1").count()
        assert sizes["train"] == int(total * 0.85) and sizes["val"] == int(total * 0.10) and sum(sizes.values()) == total
        points = sm.latin_hypercube(df, "i", ["a", "b"], 1, rows_per_block=n)
        for name in ("a", "b"):
            assert points.select(F.floor(F.col(name) * 700)).distinct().count() == 700
        assert sm.subset(df, "i", 100, 3, rows_per_block=n).count() == 100


def test_budget_draws_split_large_budgets(spark):
    b = spark.createDataFrame([(0, 25_001), (1, 0), (2, 1)], "s int, budget bigint")
    draws = sm.budget_draws(b, ["s"])
    assert {r["s"]: (r["n"], r["m"]) for r in draws.groupBy("s").agg(F.count_distinct("draw").alias("n"), F.max("draw").alias("m")).collect()} == {0: (25_001, 25_000), 2: (1, 0)}


def test_numbered_places(spark):
    """One key with most rows, null keys, ties in the leading order column and rows equal in all of it: places without gaps, in order."""
    from gridweather.operators.numbered import numbered

    df = spark.range(5000).selectExpr("if(id % 10 < 7, 'hot', if(id % 10 = 7, null, string(id % 40))) as k", "if(id % 3 = 0, null, 0) as a", "int(id % 900) as b", "id % 2 as c")
    for keys in (["k"], []):
        got = numbered(df, keys, ["a", "b"]).collect()
        groups = {}
        for r in got:
            groups.setdefault(r["k"] if keys else None, []).append(r)
        for rows in groups.values():
            rows.sort(key=lambda r: r["_at"])
            assert [r["_at"] for r in rows] == list(range(len(rows))) and {r["_n"] for r in rows} == {len(rows)}
            order = [(r["a"] is not None, r["b"]) for r in rows]
            assert order == sorted(order)
    assert numbered(df.where("false"), ["k"], ["b"]).count() == 0
