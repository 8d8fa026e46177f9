"""Repeatable samples and splits: every draw is a hash of a seed and an id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather.operators.attach import attach
from gridweather.functions.hashing import h, u01
from gridweather.operators.ordered import ordered_scan

DRAWS_PER_TASK_ROW = 10_000
# Share and range of the altitude mixture for spot checks.
CHECK_MIXTURE = [(0.5, 0.0, 3000.0), (0.8, 3000.0, 8000.0), (0.95, 8000.0, 16000.0), (1.0, 16000.0, 30000.0)]

#: Rows up to which a subset is taken as the least of every task, merged in one.
SMALL_SUBSET = 100_000


def axis_draw(seed: Column | int, axis: str, ident: Column, size: int) -> Column:
    """Index drawn evenly and with replacement on one axis."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return (h(F.concat(seed.cast("string"), F.lit(axis)), ident) % size).cast("int")


def area_weights(lats: tuple[float, ...]) -> list[float]:
    """Running share of each latitude row, weighted by the area of its cells."""
    weights = [max(math.cos(math.radians(x)), 1e-6) for x in lats]
    total, run, out = sum(weights), 0.0, []
    for w in weights:
        run += w / total
        out.append(run)
    return out


def weighted_index(u: Column, running: list[float]) -> Column:
    """Index whose share of [0, 1) holds u."""
    below = F.size(F.filter(F.array(*[F.lit(x) for x in running]), lambda edge: edge <= u))
    return F.least(below, F.lit(len(running) - 1))


def day_seed(seed: int, day: Column) -> Column:
    """Seed of a day's own sample, so that other days do not change it."""
    return F.lit(seed) + F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def largest_remainder(slices: DataFrame, keys: list[str], total: Column, share: Column, order: list[str], last_wins: bool = False) -> DataFrame:
    """Whole-number budgets per slice that sum to the total.

    ``slices`` has one row per slice of each key (axis sizes, not data); equal fractions go by position, from the back where
    ``last_wins``.
    """
    exact = slices.withColumn("_exact", total * share).withColumn("budget", F.floor("_exact"))
    by = Window.partitionBy(*keys)
    position = [F.desc(o) for o in order] if last_wins else [F.col(o) for o in order]
    ranked = exact.withColumns(
        {
            "_left": total - F.sum("budget").over(by),
            "_place": F.row_number().over(by.orderBy(F.desc(F.col("_exact") - F.col("budget")), *position)),
        }
    )
    extra = F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    return ranked.withColumn("budget", (F.col("budget") + extra).cast("bigint")).drop("_exact", "_left", "_place")


def even_budget(slices: DataFrame, keys: list[str], total: Column, order: list[str]) -> DataFrame:
    """Equal budgets, the remainder to the first slices."""
    by = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order))
    staged = slices.withColumns({"_n": n, "_i": i, "_t": total.cast("bigint")})
    extra = F.when(F.col("_i") <= F.col("_t") % F.col("_n"), 1).otherwise(0)
    return staged.withColumn("budget", F.floor(F.col("_t") / F.col("_n")).cast("bigint") + extra).drop("_n", "_i", "_t")


def level_budget(slices: DataFrame, keys: list[str], total: Column, n_time: Column, weight: str) -> DataFrame:
    """Budgets over (time, level) slices by level weight; negative weights count as none."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    staged = slices.withColumn("_w", w).withColumn("_sum", F.sum("_w").over(Window.partitionBy(*keys, "time_i")))
    return largest_remainder(staged, keys, total, F.lit(1.0) / n_time * (F.col("_w") / F.col("_sum")), ["time_i", "level_i"]).drop("_w", "_sum")


def budget_draws(budgets: DataFrame, columns: list[str]) -> DataFrame:
    """One row per draw with its number inside the slice. Large budgets are first cut into pieces that spread over tasks."""
    size = F.lit(DRAWS_PER_TASK_ROW)
    pieces = budgets.where("budget > 0").select(*columns, "budget", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("budget") - 1) / size))).alias("_p"))
    spread = pieces.repartition(*columns, "_p")
    last = F.least(F.col("budget"), (F.col("_p") + 1) * size) - 1
    return spread.select(*columns, F.explode(F.sequence(F.col("_p") * size, last)).alias("draw"))


def ratio_split(df: DataFrame, day: str, ident: str, seed: Column | int, train: float, val: float, **scan) -> DataFrame:
    """Exact split of every day's rows after a shuffle by hash: the first share trains, the next validates, the rest tests."""
    marked = df.withColumn("_h", h(seed, F.col(ident)))
    ranked = ordered_scan(marked, [day], ["_h", ident], "_h", rank="_rn", **scan)
    sizes = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")
    return ranked.join(sizes, day).withColumn("split", split).drop("_h", "_rn", "_n")


def day_split(day_of_month: Column, train_end: int = 23, val_end: int = 27) -> Column:
    return F.when(day_of_month <= train_end, "train").when(day_of_month <= val_end, "val").otherwise("test")


def subset(df: DataFrame, ident: str, most: int, seed: int, **scan) -> DataFrame:
    """At most ``most`` rows, picked by hash; all of them where there are no more.

    A small subset keeps the least hashes of every task; only a large one is worth a rank over all rows.
    """
    marked = df.withColumn("_h", h(seed, F.col(ident)))
    if most <= SMALL_SUBSET and not scan:
        return marked.orderBy("_h", ident).limit(most).drop("_h")
    return ordered_scan(marked, [], ["_h", ident], "_h", rank="_rn", **scan).where(F.col("_rn") <= most).drop("_h", "_rn")


def days_until_cap(df: DataFrame, day: str, cap: int) -> DataFrame:
    """Days in order, each taken whole, until the rows so far reach the cap. One row per day, so the window is small."""
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("rows_before", before).where(F.col("rows_before") < cap)


def latin_hypercube(df: DataFrame, ident: str, dimensions: list[str], seed: int, **scan) -> DataFrame:
    """A design point per row: in every dimension each of the n equal strata is hit exactly once."""
    dims = F.explode(F.array(*[F.lit(x) for x in dimensions])).alias("dim")
    long = df.select(ident, dims).withColumn("_h", h(F.concat(F.lit(f"{seed}-"), "dim"), F.col(ident)))
    ranked = ordered_scan(long, ["dim"], ["_h", ident], "_h", rank="_rn", **scan)
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    inside = u01(F.concat(F.lit(f"{seed}+"), "dim"), F.col(ident))
    placed = attach(ranked, size).withColumn("_u", (F.col("_rn") - 1 + inside) / F.col("_n"))
    return placed.groupBy(ident).agg(*[F.max(F.when(F.col("dim") == x, F.col("_u"))).alias(x) for x in dimensions])


def scale(u: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return low + u * (high - low)


def pick_from(u: Column, values: list) -> Column:
    """Element of a list at the share u of its length."""
    at = F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in values]), at)


def class_plan(df: DataFrame, ident: str, weights: dict[str, float], seed: int, **scan) -> DataFrame:
    """Class per row: counts by largest remainder (ties to the later class), dealt out in hash order."""
    total = sum(weights.values())
    classes = df.agg(F.count(F.lit(1)).alias("_n")).select(
        "_n", F.posexplode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(w / total).alias("_w")) for c, w in weights.items()])).alias("_pos", "_c")
    )
    shares = classes.select("_n", "_pos", "_c.*")
    counts = largest_remainder(shares, [], F.col("_n"), F.col("_w"), ["_pos"], last_wins=True)
    upto = F.sum("budget").over(Window.orderBy("_pos"))
    ends = counts.withColumn("_end", upto).agg(F.array_sort(F.collect_list(F.struct("_end", "class"))).alias("_ends"))
    marked = df.withColumn("_h", h(seed, F.col(ident)))
    ranked = ordered_scan(marked, [], ["_h", ident], "_h", rank="_rn", **scan)
    hit = F.get(F.filter("_ends", lambda e: F.col("_rn") <= e["_end"]), F.lit(0))
    return attach(ranked, ends).withColumn("class", hit["class"]).drop("_h", "_rn", "_ends")


def mixture_altitude(pick: Column, u: Column) -> Column:
    """Altitude from the check mixture: ``pick`` chooses the band, ``u`` the place in it."""
    out = F.lit(None).cast("double")
    for edge, low, high in reversed(CHECK_MIXTURE):
        out = F.when(pick < edge, scale(u, low, high)).otherwise(out)
    return out
