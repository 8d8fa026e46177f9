"""Tracks and logs as ordered series: lengths, resampling, crossings, changes, as-of matches, training curves."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather.operators.ordered import ordered_scan, plan_blocks


def path_length(track: DataFrame, key: str, seq: str, x: str, z: str, **scan) -> DataFrame:
    """Running length of the line through the points, 0 at the first; adds ``length`` and the point before."""
    blocks = plan_blocks(track, [key], seq, **scan)
    stepped = ordered_scan(track, [key], [seq], seq, prev={"x_before": x, "z_before": z}, blocks=blocks)
    dx, dz = F.col(x) - F.col("x_before"), F.col(z) - F.col("z_before")
    step = F.coalesce(F.sqrt(dx * dx + dz * dz), F.lit(0.0))
    return ordered_scan(stepped.withColumn("step", step), [key], [seq], seq, sums={"length": F.col("step")}, blocks=blocks)


def resample(
    track: DataFrame, key: str, seq: str, x: str, z: str, *, spacing: float = 25.0, least: int = 350, most: int = 700, **scan
) -> DataFrame:
    """Points at equal distances along each track, ends kept.

    Tracks of at most ``most`` points stay as they are. Others get clamp(length / spacing + 1, least, most) points. Each stretch
    between two points yields the targets that fall into it, so a long track is worked on in many tasks. A track of zero length
    keeps every n-th point.
    """
    measured = path_length(track, key, seq, x, z, **scan)
    whole = measured.groupBy(key).agg(F.max("length").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    wanted = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("_total") / spacing) + 1))
    whole = whole.withColumn("_n", wanted).withColumn("_n", F.when(F.col("_rows") <= F.greatest(F.lit(most), F.col("_n")), F.col("_rows")).otherwise(F.col("_n")))
    rows, parts, at = measured.join(whole, key), F.col("_n") - 1, F.col(seq).cast("bigint")
    long, moving = F.col("_rows") > F.col("_n"), F.col("_total") > 0
    # The points each row yields, as a list of numbers, all branches in one pass; none where its branch gives none.
    start = F.col("length") - F.col("step")
    # One target too many on each side guards against rounding; the exact test follows.
    low = F.greatest(F.lit(1), F.floor(start * parts / F.col("_total")) - 1).cast("bigint")
    high = F.least(F.col("_n") - 2, F.floor(F.col("length") * parts / F.col("_total")) + 1).cast("bigint")
    stretch = F.filter(F.sequence(low, high), lambda p: (F.col("_total") * p / parts <= F.col("length")) & (F.col("_total") * p / parts > start))
    inner = F.when((F.col(seq) > 0) & (F.col("step") > 0) & (low <= high), stretch)
    ends = F.when(F.col(seq) == 0, F.array(F.lit(0).cast("bigint"))), F.when(F.col(seq) == F.col("_rows") - 1, F.array(parts.cast("bigint")))
    every = F.greatest(F.lit(1), F.ceil((F.col("_rows") - 1) / F.greatest(F.lit(1), parts)))
    nth = F.ceil(F.col(seq) / every).cast("bigint")
    picked = F.when(((F.col(seq) % every == 0) | (F.col(seq) == F.col("_rows") - 1)) & (nth < F.col("_n")), F.array(nth))
    none = F.array().cast("array<bigint>")
    between = F.concat(*[F.coalesce(x, none) for x in (ends[0], inner, ends[1])])
    points = F.when(~long, F.array(at)).when(moving, between).otherwise(F.coalesce(F.when(F.col(seq) == 0, F.array(F.lit(0).cast("bigint"))), picked, none))
    rows = rows.withColumns({"_start": start, "_between": long & moving}).withColumn("point", F.explode(points))
    inside = F.col("_between") & (F.col("point") > 0) & (F.col("point") < parts)
    # The running length before this stretch is the length up to it, not its end minus the step: take it from the row before.
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_total") * F.col("point") / parts - F.col("_start")) / F.col("step")))
    moved = [F.when(inside, F.col(f"{n}_before") + (F.col(c) - F.col(f"{n}_before")) * share).otherwise(F.col(c)).alias(c) for n, c in (("x", x), ("z", z))]
    return rows.select(key, "point", *moved)


def first_down_crossing(series: DataFrame, key: str, seq: str, x: str, z: str, level: float, **scan) -> DataFrame:
    """First place where a series falls to a level, interpolated; none for a series that starts at or below it."""
    stepped = ordered_scan(series, [key], [seq], seq, prev={"x_before": x, "z_before": z}, **scan)
    down = (F.col("z_before") > level) & (F.col(z) <= level)
    hit = F.struct(F.col(seq).alias("seq"), "x_before", "z_before", F.col(x).alias("x"), F.col(z).alias("z"))
    found = stepped.groupBy(key).agg(F.min_by(hit, F.when(down, F.col(seq))).alias("hit"), F.min_by(z, seq).alias("_z0"))
    a, b = F.col("hit.z_before"), F.col("hit.z")
    drop = a - b
    share = F.when(F.abs(drop) < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a - level) / F.when(drop == 0, 1.0).otherwise(drop))))
    out = found.where((F.col("_z0") > level) & F.col("hit").isNotNull()).withColumn("fraction", share)
    at = F.col("hit.x_before") + (F.col("hit.x") - F.col("hit.x_before")) * F.col("fraction")
    return out.select(key, (F.col("hit.seq") - 1).alias("index_before"), F.col("hit.seq").alias("index_after"), "fraction", at.alias("x_at"))


def state_changes(df: DataFrame, key: str, order: list[str], by: str, state: str, **scan) -> DataFrame:
    """Marks rows whose state differs from the one before and numbers the runs; ``refreshes`` counts changes after the first."""
    blocks = plan_blocks(df, [key], by, **scan)
    stepped = ordered_scan(df, [key], order, by, prev={"_before": state}, blocks=blocks)
    changed = F.col("_before").isNull() | (F.col(state) != F.col("_before"))
    marked = stepped.withColumn("changed", changed)
    out = ordered_scan(marked, [key], order, by, sums={"run_id": F.col("changed").cast("bigint")}, blocks=blocks)
    return out.withColumn("refreshes", F.col("run_id") - 1).drop("_before")


def as_of(queries: DataFrame, records: DataFrame, key: str, x: str, ident: str, payload: list[str], **scan) -> DataFrame:
    """Last record at or before each query position, else the first record of the key.

    Both sides are laid into one series; the value is carried along it, which needs no range join.
    """
    rec = records.select(key, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast(queries.schema[ident].dataType).alias(ident), F.struct(x, *payload).alias("_rec"))
    ask = queries.select(key, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), ident).withColumn("_rec", F.lit(None).cast(rec.schema["_rec"].dataType))
    tie = F.when(F.col("_kind") == 1, F.col(ident)).otherwise(F.lit(0))
    line = rec.unionByName(ask).withColumn("_tie", tie)
    carried = ordered_scan(line, [key], ["_x", "_kind", "_tie"], "_x", fill={"_last": "_rec"}, **scan)
    first = records.groupBy(key).agg(F.min_by(F.struct(x, *payload), x).alias("_first"))
    out = carried.where("_kind = 1").join(first, key, "left").withColumn("_r", F.coalesce("_last", "_first"))
    return out.select(key, ident, F.col("_x").alias(x), F.col(f"_r.{x}").alias(f"record_{x}"), *[F.col(f"_r.{p}").alias(f"record_{p}") for p in payload])


def time_axis(track: DataFrame, key: str, seq: str, duration: Column) -> DataFrame:
    """Evenly spaced times from 0 to the duration over a track's rows."""
    size = track.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return track.join(size, key).withColumn("time_s", F.col(seq) * (duration / F.greatest(F.col("_rows") - 1, F.lit(1)))).drop("_rows")


# Training logs have one row per epoch, a few hundred at most, so the windows below need no key.


def overfit_onset(log: DataFrame, patience: int = 8) -> DataFrame:
    """First epoch (from 1) where training loss falls and validation loss rises over ``patience`` epochs; NULL without one."""
    w = Window.orderBy("epoch")
    rows = log.select(
        (F.row_number().over(w) - 1).alias("i"),
        (F.lead("train_loss", patience - 1).over(w) - F.col("train_loss")).alias("dt"),
        (F.lead("val_loss", patience - 1).over(w) - F.col("val_loss")).alias("dv"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    hit = (F.col("i") >= 1) & (F.col("i") < F.col("n") - patience) & (F.col("n") >= patience + 2) & (F.col("dt") < 0) & (F.col("dv") > 0)
    return rows.agg(F.min(F.when(hit, F.col("i") + 1)).alias("overfit_epoch"))


def learning_rate(log: DataFrame, base: float, least: float, warmup: int, schedule: str = "cosine", logged: str | None = None) -> DataFrame:
    """Rate per epoch: the logged one if complete, else constant, else a linear rise and a cosine fall."""
    w = Window.orderBy("epoch")
    rows = log.withColumns({"_e": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    e, n = F.col("_e"), F.col("_n")
    if schedule == "cosine":
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (e - warmup) / F.greatest(F.lit(1), n - warmup)))
        rate = F.when((e <= warmup) & F.lit(warmup > 0), e * (base / max(1, warmup))).otherwise(
            F.lit(least) + (F.cos(part * math.pi) + 1.0) * (0.5 * (base - least))
        )
    else:
        rate = F.lit(base)
    if logged:
        whole = F.count(logged).over(Window.partitionBy()) == n
        rate = F.when(whole, F.col(logged)).otherwise(rate)
    return rows.withColumn("learning_rate", rate).drop("_e", "_n")


def clean_curve(log: DataFrame, value: str) -> DataFrame:
    """A curve logged with the wrong sign is turned round; its first (baseline) entry is dropped."""
    w = Window.orderBy("epoch")
    rows = log.withColumns({"_i": F.row_number().over(w), "_m": F.avg(value).over(Window.partitionBy())})
    return rows.where("_i > 1").withColumn(value, F.when(F.col("_m") < 0, -F.col(value)).otherwise(F.col(value))).drop("_i", "_m")


def gap_curve(log: DataFrame) -> DataFrame:
    """Validation minus training loss where both exist."""
    return log.where("train_loss is not null and val_loss is not null").select("epoch", (F.col("val_loss") - F.col("train_loss")).alias("gap"))


# Thinning by distance depends on the last kept row, so it runs row by row inside blocks of bounded size.

THIN_BLOCK_ROWS = 100_000


def _next_kept(x: list[float], dx: float) -> list[int]:
    """For each row the first later one at least ``dx`` beyond it, the length where there is none."""
    out, stack, values = [len(x)] * len(x), [], []
    for i in range(len(x) - 1, -1, -1):
        # ``values`` are the negated heights a walker from i+1 on would meet as new maxima, the nearest last.
        at = bisect_right(values, -(x[i] + dx))
        out[i] = stack[at - 1] if at else len(x)
        while values and -values[-1] <= x[i]:
            values.pop(), stack.pop()
        values.append(-x[i]), stack.append(i)
    return out


def _block_moves(dx: float, key: str, x: str, seq: str):
    """Where a walk that enters a block ends in it, for every way of entering that the rows before allow."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq, ignore_index=True)
        xs, last, most = rows[x].tolist(), rows["_last"].iloc[0], rows["_most"].iloc[0]
        after = _next_kept(xs, dx)
        end: dict[int, float] = {}
        for i in range(len(xs) - 1, -1, -1):
            end[i] = xs[i] if after[i] == len(xs) else end[after[i]]
        low, moves, first = -math.inf, [], pd.isna(last)
        for i, value in enumerate(xs):
            if value > low:
                if first:
                    moves.append((-math.inf, math.inf, end[i]))
                    break
                # Entered here by a walk whose next goal lies in (low, value]; goals outside (last, most + dx] cannot be.
                if value > last and low <= most + dx:
                    if moves and moves[-1][1:] == (low, end[i]):
                        low = moves.pop()[0]  # walks that end alike are one move
                    moves.append((low, value, end[i]))
                low = value
        out = pd.DataFrame(moves, columns=["low", "high", "tail"])
        return out.assign(**{key: rows[key].iloc[0], "_b": rows["_b"].iloc[0]})

    return run


def _walk(dx: float, key: str):
    """Last kept position before each block, over partitions of moves sorted by (key, block, height); only that position is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at, goal, met = None, None, math.inf, False
        for part in batches:
            out = []
            for k, block, low, high, tail in zip(*(part[c].tolist() for c in (key, "_b", "low", "high", "tail"))):
                if (k, block) != group:
                    at = at if group and group[0] == k else None
                    group, goal, met = (k, block), math.inf if at is None else at + dx, False
                    out.append((block, at, k))
                if not met and low < goal <= high:
                    at, met = tail, True
            yield pd.DataFrame(out, columns=["_b", "_enter", key]).astype({"_enter": "float64"})

    return run


def _thin(dx: float, key: str, x: str):
    """Greedy walk over partitions sorted by (key, block, row); only the last kept position is carried from row to row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, None
        for part in batches:
            kept = []
            for i, (k, block, value, enter) in enumerate(zip(part[key].tolist(), part["_b"].tolist(), part[x].tolist(), part["_enter"].tolist())):
                if (k, block) != group:
                    group, last = (k, block), None if enter != enter or enter is None else enter
                if last is None or value - last >= dx:
                    kept.append(i)
                    last = value
            yield part.iloc[kept]

    return run


def thin_by_distance(track: DataFrame, key: str, seq: str, x: str, dx: float, rows_per_block: int = THIN_BLOCK_ROWS) -> DataFrame:
    """Rows that moved at least ``dx`` since the last kept one; the first and the last row of a track stay.

    ``seq`` counts from 0 without gaps. A track longer than a block is thinned in three steps: per block the possible entries and
    where they lead, per track one walk over those, per block the thinning from its own entry. Only the rows within ``dx`` of a
    block's start can be entries, and entries from which walks end alike are one move. The walk reads the moves of a track in
    order and holds one batch of them, whatever the track's length.
    """
    if dx <= 0:
        raise ValueError("the distance must be positive")
    rows = track.select(key, seq, F.col(x).cast("double").alias(x)).withColumn("_b", F.floor(F.col(seq) / rows_per_block).cast("bigint"))
    ktype, stype = (rows.schema[c].dataType.simpleString() for c in (key, seq))
    blocks = rows.groupBy(key, "_b").agg(F.max_by(x, seq).alias("_end"), F.max(x).alias("_top"), F.max(seq).alias("_s"))
    along = Window.partitionBy(key).orderBy("_b")
    blocks = blocks.withColumns(
        {"_last": F.lag("_end").over(along), "_most": F.max("_top").over(along.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.max("_b").over(Window.partitionBy(key))}
    ).where("_n > 0")
    long = rows.join(blocks.select(key, "_b", "_last", "_most"), [key, "_b"])
    moves = long.groupBy(key, "_b").applyInPandas(_block_moves(dx, key, x, seq), f"low double, high double, tail double, {key} {ktype}, _b bigint")
    along_track = moves.repartition(F.col(key)).sortWithinPartitions(key, "_b", "high")
    enter = along_track.mapInPandas(_walk(dx, key), f"_b bigint, _enter double, {key} {ktype}")
    # A block that no walk can enter has no moves and keeps nothing; the first block always has one.
    staged = rows.join(blocks.select(key, "_b", F.lit(True).alias("_long")), [key, "_b"], "left").join(enter.withColumn("_reached", F.lit(True)), [key, "_b"], "left")
    work = staged.where("_long is null or _reached").select(key, "_b", seq, x, "_enter")
    sorted_rows = work.repartition(key, "_b").sortWithinPartitions(key, "_b", seq)
    kept = sorted_rows.mapInPandas(_thin(dx, key, x), f"{key} {ktype}, _b bigint, {seq} {stype}, {x} double, _enter double")
    last = rows.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(x, seq).alias(x))
    return kept.select(key, seq, x).unionByName(last.select(key, seq, x)).distinct()
