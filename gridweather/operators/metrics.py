"""Error metrics: basic, detailed, by band, by bin, as classes and as events."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather import session
from gridweather.functions.hashing import h
from gridweather.operators.attach import attach
from gridweather.operators.ordered import block_number, exact_quantiles, order_number, ordered_scan, plan_blocks

# Altitude bands in metres, half open.
BANDS = [
    ("surface_0_2km", 0.0, 2000.0),
    ("low_trop_2_5km", 2000.0, 5000.0),
    ("mid_trop_5_8km", 5000.0, 8000.0),
    ("upper_trop_8_12km", 8000.0, 12000.0),
    ("lower_strato_12_18km", 12000.0, 18000.0),
    ("strato_18_32km", 18000.0, 32000.0),
]


def band_of(altitude: Column) -> Column:
    """Band name, NULL outside all bands."""
    out = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        out = F.when((altitude >= lo) & (altitude < hi), name).otherwise(out)
    return out


def band_sql(altitude: str) -> str:
    return "(case " + " ".join(f"when {altitude} >= {lo} and {altitude} < {hi} then '{name}'" for name, lo, hi in BANDS) + " end)"


def basic(error: Column) -> list[Column]:
    """n, MAE, RMSE and largest absolute error as aggregates; n is 0 and the rest NULL without rows."""
    return [
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.max(F.abs(error)).alias("max_abs"),
    ]


QUANTILES = {"median_abs": 0.5, "p90_abs": 0.9, "p95_abs": 0.95, "p99_abs": 0.99}


def error_of(truth: str = "y_true", guess: str = "y_pred") -> Column:
    return F.col(guess) - F.col(truth)


def basic_by(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*basic(error))


def detailed_by(df: DataFrame, keys: list[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Basic metrics, absolute-error quantiles, bias, spread and R2 = 1 - SSE / SST per key."""
    e = error_of(truth, guess)
    sst = F.var_pop(F.col(truth)) * F.count(F.lit(1))
    plain = df.groupBy(*keys).agg(
        *basic(e),
        F.avg(e).alias("bias"),
        F.stddev_pop(e).alias("std_error"),
        (1.0 - F.sum(e * e) / F.greatest(F.lit(1e-12), sst)).alias("r2"),
    )
    quantiles = exact_quantiles(df, keys, F.abs(e), QUANTILES)
    return plain.join(quantiles, keys)


def by_band(df: DataFrame, keys: list[str], altitude: str, error: Column) -> DataFrame:
    """Basic metrics per key and altitude band, every band present; rows above the bands are left out."""
    found = df.withColumn("band", band_of(F.col(altitude))).where("band is not null").groupBy(*keys, "band").agg(*basic(error))
    frame = df.select(*keys).distinct().withColumn("band", F.explode(F.array(*[F.lit(name) for name, _, _ in BANDS])))
    return frame.join(found, [*keys, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overall_and_bands(df: DataFrame, key: str, altitude: str, error: Column) -> DataFrame:
    """Both levels in one pass over the rows."""
    banded = df.withColumn("band", band_of(F.col(altitude))).withColumn("_e", error)
    sets = banded.groupingSets([[key], [key, "band"]], key, "band").agg(F.grouping("band").alias("_all"), *basic(F.col("_e")))
    level = F.when(F.col("_all") == 1, "overall").otherwise("band").alias("level")
    return sets.where("_all = 1 or band is not null").select(key, level, "band", "n", "mae", "rmse", "max_abs")


def error_profile(
    df: DataFrame, key: str, axis: str, error: Column, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """``error_profiles`` of one axis."""
    return error_profiles(df, key, {axis: (bins, low, high)}, error)


def error_profiles(df: DataFrame, key: str, axes: dict[str, tuple[int, float | None, float | None]], error: Column) -> DataFrame:
    """Mean absolute error in equal-width bins along each axis (bins, low, high); the last bin is closed, empty ones have a NULL mean.

    Without given ends an axis runs from its own least to its largest value. All axes are counted in one pass over the rows; open
    ends take one more before.
    """
    ends = [(f"_{end}_{i}", given, f(axis)) for i, (axis, (_, *pair)) in enumerate(axes.items()) for end, given, f in zip(("low", "high"), pair, (F.min, F.max))]
    rows, open_ends = df, [f.cast("double").alias(name) for name, given, f in ends if given is None]
    if open_ends:
        rows = attach(rows, df.agg(*open_ends))
    rows = rows.withColumns({name: F.lit(float(given)) for name, given, _ in ends if given is not None})
    places = [
        F.struct(F.lit(axis).alias("axis"), F.lit(n).alias("bins"), F.col(axis).cast("double").alias("x"), F.col(f"_low_{i}").alias("low"), F.col(f"_high_{i}").alias("high"))
        for i, (axis, (n, _, _)) in enumerate(axes.items())
    ]
    rows = rows.select(key, F.abs(error).alias("_e"), F.explode(F.array(*places)).alias("_p")).select(key, "_e", "_p.*")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    guess = F.floor((F.col("x") - F.col("low")) / F.when(width > 0, width).otherwise(1.0))
    # Rows outside the ends count in no bin, but their key is kept.
    place = F.when(F.col("x").between(F.col("low"), F.col("high")), F.greatest(F.lit(0), F.least(guess, F.col("bins") - 1)).cast("int"))
    counted = rows.groupBy("axis", key, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("_e").alias("mean_abs_error"), *[F.first(c).alias(c) for c in ("bins", "low", "high")]
    )
    # At most one entry a bin comes together per axis and key.
    entry = F.struct("bin", F.struct("count", "mean_abs_error"))
    one = counted.groupBy("axis", key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), entry))).alias("_m"), *[F.first(c).alias(c) for c in ("bins", "low", "high")]
    )
    out = one.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).withColumn("_r", F.col("_m")[F.col("bin")])
    start, end = F.col("low") + F.col("bin") * width, F.col("low") + (F.col("bin") + 1) * width
    return out.select(
        "axis", key, "bin", start.alias("bin_start"), end.alias("bin_end"), ((start + end) / 2.0).alias("bin_center"),
        F.coalesce("_r.count", F.lit(0)).alias("count"), F.col("_r.mean_abs_error").alias("mean_abs_error"),
    )


def quantile_edges(df: DataFrame, keys: list[str], x: Column, bins: int) -> DataFrame:
    """Edges e0..e<bins> at equal shares, pushed up by 1e-6 where one does not exceed the edge before."""
    raw = exact_quantiles(df, keys, x, {f"e{i}": i / bins for i in range(bins + 1)})
    for i in range(1, bins + 1):
        here, before = F.col(f"e{i}"), F.col(f"e{i - 1}")
        raw = raw.withColumn(f"e{i}", F.when(here <= before, before + 1e-6).otherwise(here))
    return raw


CLASS_NAMES = ("low", "mid", "high")


def class_confusion(df: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Counts of true against predicted class, classes cut at the truth's thirds; all nine cells per key.

    The edges, a row per key, are written: they are found once, and Spark sees their size. While they are small they go to the
    rows, which then meet no shuffle; rows of a busy key are counted where they lie.
    """
    path = session.new_folder(df.sparkSession, "class-edges")
    quantile_edges(df, [key], F.col(truth), 3).write.parquet(path)
    edges = df.sparkSession.read.parquet(path)

    def cut(x: str) -> Column:
        return (F.col(x) >= F.col("e1")).cast("int") + (F.col(x) >= F.col("e2")).cast("int")

    counted = df.join(edges, key).groupBy(key, cut(truth).alias("t"), cut(guess).alias("p")).agg(F.count(F.lit(1)).alias("count"))
    cell = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(j).alias("p")) for i in range(3) for j in range(3)])
    frame = edges.withColumn("_c", F.explode(cell)).select("*", "_c.*")
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    low, high = F.array("e0", "e1", "e2"), F.array("e1", "e2", "e3")
    return frame.join(counted, [key, "t", "p"], "left").select(
        key, F.get(names, "t").alias("true_bin"), F.get(names, "p").alias("predicted_bin"), F.coalesce("count", F.lit(0)).alias("count"),
        F.get(low, "t").alias("bin_edge_low"), F.get(high, "t").alias("bin_edge_high"),
    )


def event_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Confusion of a yes/no event and its scores; empty denominators count as one."""
    counts = df.agg(
        F.count_if(~truth & ~guess).alias("tn"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"), F.avg(truth.cast("double")).alias("positive_rate"),
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    one = F.lit(1)
    precision, recall = tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn)
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / F.greatest(one, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": tn / F.greatest(one, tn + fp),
        }
    ).withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall")))


def threshold_curve(df: DataFrame, event: Column, score: Column, rows_per_block: int | None = None) -> DataFrame:
    """Running true and false positives down the distinct scores, with the rates at and before each score.

    Equal scores count together, so the curve does not depend on the order of ties.
    """
    per_score = df.select(event.alias("_y"), (-score).alias("_s")).groupBy("_s").agg(
        F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_q")
    )
    run = ordered_scan(
        per_score, [], ["_s"], "_s", sums={"tp": F.col("_p"), "fp": F.col("_q")}, rows_per_block=rows_per_block
    )
    totals = per_score.agg(F.greatest(F.lit(1), F.sum("_p")).alias("_np"), F.greatest(F.lit(1), F.sum("_q")).alias("_nq"))
    tp, fp = F.col("tp"), F.col("fp")
    return attach(run, totals).select(
        (-F.col("_s")).alias("threshold"), "tp", "fp", (tp / F.col("_np")).alias("tpr"), (fp / F.col("_nq")).alias("fpr"),
        ((tp - F.col("_p")) / F.col("_np")).alias("tpr_before"), ((fp - F.col("_q")) / F.col("_nq")).alias("fpr_before"),
        (tp / F.greatest(F.lit(1), tp + fp)).alias("precision"),
    )


def area_under_roc(curve: DataFrame) -> DataFrame:
    step = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2.0
    return curve.agg(F.sum(step).alias("auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum((F.col("tpr") - F.col("tpr_before")) * F.col("precision")).alias("average_precision"))


#: Rows, copies counted, that one block of places holds; blocks at most; parts of an order per block, counted before places are known.
BLOCK_COPIES, MOST_BLOCKS, PARTS = 1_000_000, 1024, 8


def permutation_importance(df: DataFrame, ident: str, features: list[str], targets: list[str], score, seed: int, block_copies: int = BLOCK_COPIES) -> DataFrame:
    """MAE per target with one feature at a time shuffled, against the unshuffled baseline.

    ``score`` maps a DataFrame with the feature columns to one with ``pred_<target>`` columns; truth columns carry the target
    names. All copies (none shuffled, then each feature) are scored in one pass. The shuffle pairs the row at place k by id
    with the row at place k by hash, so it is a true permutation. Rows without an id keep their own values.

    Places are cut into blocks. Every order (by id, and by each feature's hash) is counted in small parts first, so each row knows
    the block that holds its place, or the blocks its part touches; a value goes there as (feature, hash, id, value) and whole rows
    go once. Places are numbered in the block, where value and row meet: nothing else is shuffled.
    """
    spark, n = df.sparkSession, len(features)
    rows = df.count()
    blocks = max(1, min(MOST_BLOCKS, ceil(rows * (n + 1) / block_copies)))
    size = max(1, ceil(rows / blocks))
    bits = (PARTS * blocks - 1).bit_length()
    by_id = block_number(order_number(df, ident), plan_blocks(df, [], ident, size).cuts)

    one = F.col(ident)
    # Rows without an id come first in all orders, in the order of their contents.
    whole = df.select(one.alias("_id"), F.struct(ident, *features, *targets).alias("_own"), by_id.alias("_at"))
    # Written once: read by the counts and by the copies, and the features' own terms stay out of their plans.
    folder = session.new_folder(spark, "places")
    whole.write.parquet(f"{folder}/rows")
    whole = spark.read.schema(whole.schema).parquet(f"{folder}/rows")
    whole = whole.withColumn("_row", F.when(F.col("_id").isNull(), F.xxhash64("_own")))
    hashed = h((F.col("_j") + seed), F.col("_id"))
    without = F.shiftright("_row", 64 - bits) - (1 << bits)

    def part(other):
        return F.coalesce(without, other).cast("bigint")

    each = F.array(*[F.col(f"_own.{f}").cast("double") for f in features])
    values = whole.select("_id", "_row", F.posexplode(each).alias("_j", "_x")).withColumn("_h", hashed)
    values = values.withColumn("_part", part(F.shiftright("_h", 60 - bits)))
    own = whole.withColumn("_part", part(F.col("_at"))).withColumn("_j", F.lit(-1))
    counted = own.groupBy("_j", "_part").agg(F.count(F.lit(1)).alias("_n")).unionByName(values.groupBy("_j", "_part").agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy("_j").orderBy("_part"))
    counted.withColumn("_end", upto).write.parquet(f"{folder}/parts")
    counted = spark.read.schema("_j int, _part bigint, _n bigint, _end bigint").parquet(f"{folder}/parts")
    start = F.col("_end") - F.col("_n")
    touched = F.sequence(F.floor(start / size).cast("int"), F.floor((F.col("_end") - 1) / size).cast("int"))
    # At most PARTS + 1 numbers a block and feature (and 128 x 128 of the ids) go to every task.
    parts = counted.select("_j", "_part", start.alias("_start"), touched.alias("_blocks"))
    firsts = parts.select("_j", "_start", F.explode("_blocks").alias("_block")).groupBy("_block", "_j").agg(F.min("_start").alias("_start"))

    none = F.lit(None)
    copies = own.select("_j", "_part", none.cast("bigint").alias("_h"), "_id", "_row", none.cast("double").alias("_x"), "_own").unionByName(
        values.select("_j", "_part", "_h", "_id", "_row", "_x", none.cast(whole.schema["_own"].dataType).alias("_own"))
    )
    sent = copies.join(F.broadcast(parts.drop("_start")), ["_j", "_part"]).withColumn("_block", F.explode("_blocks")).drop("_part", "_blocks")
    sent = sent.repartition(blocks, "_block")
    # Rows alike in all of this order are one value.
    number = F.row_number().over(Window.partitionBy("_block", "_j").orderBy("_h", "_id", "_row", "_x", "_own"))
    placed = sent.withColumn("_number", number).join(F.broadcast(firsts), ["_block", "_j"])
    placed = placed.select("_block", "_j", "_x", "_own", (F.col("_start") + F.col("_number") - 1).alias("_place")).where(F.floor(F.col("_place") / size) == F.col("_block"))
    # The row of a place comes before the values that go there.
    met = placed.withColumn("_own", F.first("_own").over(Window.partitionBy("_block", "_place").orderBy("_j").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    swapped = [F.when(F.col("_j") == j, F.col("_x")).otherwise(F.col(f"_own.{f}")).alias(f) for j, f in enumerate(features)]
    named = F.when(F.col("_j") < 0, "").otherwise(F.get(F.array(*[F.lit(f) for f in features]), F.col("_j"))).alias("feature")
    both = met.select(F.col(f"_own.{ident}").alias(ident), named, *swapped, *[F.col(f"_own.{t}").alias(t) for t in targets])
    errors = score(both).select(
        "feature", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.abs(F.col(f"pred_{t}") - F.col(t)).alias("e")) for t in targets])).alias("_r")
    )
    mae = errors.groupBy("feature", F.col("_r.target").alias("target")).agg(F.avg("_r.e").alias("mae"))
    base = F.max(F.when(F.col("feature") == "", F.col("mae"))).over(Window.partitionBy("target"))
    delta = F.col("permuted_mae") - F.col("baseline_mae")
    return (
        mae.withColumn("baseline_mae", base)
        .where("feature <> ''")
        .withColumnRenamed("mae", "permuted_mae")
        .select("target", "feature", "permuted_mae", "baseline_mae")
        .withColumn("delta_mae", delta)
        .withColumn("relative_delta", F.col("delta_mae") / F.greatest(F.lit(1e-12), F.col("baseline_mae")))
    )


def feature_group(name: Column) -> Column:
    """Group of a feature by its name; the first rule that fits counts."""
    return (
        F.when(name.contains("altitude"), "altitude")
        .when(name.startswith("utc") | name.startswith("solar") | name.contains("hour"), "time_of_day")
        .when(name.startswith("doy") | name.contains("day_of_year"), "day_of_year")
        .when(name.contains("lat") | name.contains("lon") | name.startswith("sphere"), "location")
        .otherwise("other")
    )


def importance_by_group(importance: DataFrame) -> DataFrame:
    return (
        importance.withColumn("feature_group", feature_group(F.col("feature")))
        .groupBy("target", "feature_group")
        .agg(F.sum("delta_mae").alias("sum_delta_mae"), F.avg("delta_mae").alias("mean_delta_mae"))
    )


def distribution_summary(long: DataFrame, name: str = "name", x: str = "x") -> DataFrame:
    """Count, moments, 1/50/99 % quantiles and shares of small, large and non-positive values per name."""
    v = F.col(x)
    plain = long.groupBy(name).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg((F.abs(v) < 1e-3).cast("double")).alias("share_small"), F.avg((F.abs(v) > 1.0).cast("double")).alias("share_above_1"),
        F.avg((v <= 0.0).cast("double")).alias("share_not_positive"),
    )
    return plain.join(exact_quantiles(long, [name], v, {"p01": 0.01, "p50": 0.5, "p99": 0.99}), name)


def compare_models(df: DataFrame, target: str, model: str, models: list[str], error: Column) -> DataFrame:
    """One row per metric and target, one column per model, and the difference where there are exactly two."""
    per = df.groupBy(target, model).agg(*basic(error))
    long = per.unpivot([target, model], ["mae", "rmse", "max_abs"], "metric", "value")
    wide = long.groupBy("metric", target).pivot(model, models).agg(F.max("value"))
    if len(models) == 2:
        wide = wide.withColumn("delta", F.col(models[1]) - F.col(models[0]))
    return wide


def training_summary(log: DataFrame, patience: int = 8) -> DataFrame:
    """One row on a training log (epoch, train_loss, val_loss): counts, best, last and the overfit onset."""
    from gridweather.operators.series import overfit_onset

    best = F.struct("val_loss", "epoch")
    last = F.max_by(F.struct("train_loss", "val_loss"), "epoch")
    summary = log.agg(
        F.count(F.lit(1)).alias("epochs"), F.min_by("epoch", best).alias("best_epoch"), F.min("val_loss").alias("best_val_loss"), last.alias("_l")
    )
    out = summary.select("epochs", "best_epoch", "best_val_loss", F.col("_l.train_loss").alias("final_train_loss"), F.col("_l.val_loss").alias("final_val_loss"))
    return attach(out, overfit_onset(log, patience))


def point_check(df: DataFrame, deltas: list[str]) -> DataFrame:
    """Valid and skipped points, and basic metrics of each delta over the valid ones."""
    valid = F.lit(True)
    for name in deltas:
        valid = valid & F.col(name).isNotNull()
    per = []
    for name in deltas:
        e = F.when(valid, F.col(name))
        per += [m.alias(f"{name}_{k}") for m, k in zip(basic(e)[1:], ("mae", "rmse", "max_abs"))]
    return df.agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_skipped"), *per)


ACCESS_LINE = r"^(\S+) /(\S+) (\d{3}) ([0-9.]+)ms$"


def access_summary(lines: DataFrame, ts: str, line: str) -> DataFrame:
    """Requests, status classes and latency quantiles per route and minute from access lines."""
    parsed = lines.select(
        F.date_trunc("minute", ts).alias("minute"),
        F.regexp_extract(line, ACCESS_LINE, 2).alias("route"),
        F.regexp_extract(line, ACCESS_LINE, 3).cast("int").alias("status"),
        F.regexp_extract(line, ACCESS_LINE, 4).cast("double").alias("ms"),
    )
    keys = ["minute", "route"]
    counts = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") < 300).alias("ok"),
        F.count_if(F.col("status").between(400, 499)).alias("refused"), F.count_if(F.col("status") >= 500).alias("failed"),
    )
    return counts.join(exact_quantiles(parsed, keys, F.col("ms"), {"p50_ms": 0.5, "p95_ms": 0.95}), keys)
