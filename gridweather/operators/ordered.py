"""Ordered series: ranks, running sums, previous and last-known values, without one task per series.

A plain window puts a whole key into one task. Here a key with more than ``rows_per_block`` rows is cut into blocks along its
order; every block is scanned by itself and the state at its start is joined back from a table of block totals. Small inputs
and small keys keep the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather.operators.attach import attach

ROWS_PER_BLOCK = 1_000_000
CUTS = 128
SLICES = 128
BLOCK = "_blk"


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    by: str,
    *,
    sums: dict[str, Column] | None = None,
    rank: str | None = None,
    prev: dict[str, str] | None = None,
    fill: dict[str, str] | None = None,
    rows_per_block: int | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``.

    ``order`` is ascending and total within ``keys``; ``by`` names its leading column (number or time).
    ``sums``: output -> column, running sum including the row. ``rank``: output name of the 1-based position.
    ``prev``: output -> column of the row before. ``fill``: output -> column, last non-null value up to the row.
    ``blocks`` comes from ``plan_blocks`` where several scans go along the same order; else it is planned here.
    """
    sums, prev, fill = sums or {}, prev or {}, fill or {}
    blocks = blocks or plan_blocks(df, keys, by, rows_per_block)
    blocked = bool(blocks.cuts)
    base = _mark(df, keys, by, blocks) if blocked else df
    for name, column in sums.items():
        base = base.withColumn(f"_in_{name}", column)
    part = [*keys, BLOCK] if blocked else keys
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added: dict[str, Column] = {name: F.sum(f"_in_{name}").over(upto) for name in sums}
    if rank:
        added[rank] = F.row_number().over(w).cast("bigint")
    if prev:
        added["_prev"] = F.lag(F.struct(*[F.col(c).alias(o) for o, c in prev.items()])).over(w)
    for name, column in fill.items():
        added[name] = F.last(column, ignorenulls=True).over(upto)
    local = base.withColumns(added)
    if blocked:
        local = _add_carry(local, base, keys, order, sums, rank, prev, fill)
    if prev:
        local = local.withColumns({name: F.col(f"_prev.{name}") for name in prev})
    return local.drop("_prev", BLOCK, "_hot", *[f"_in_{name}" for name in sums])


def _add_carry(local, base, keys, order, sums, rank, prev, fill):
    """State before each block of a cut key, joined on (keys, block): the partitioning the window already has."""
    position = F.struct(*order)
    totals = [F.sum(f"_in_{name}").alias(f"_t_{name}") for name in sums] + [F.count(F.lit(1)).alias("_rows")]
    if prev:
        totals.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in prev.items()]), position).alias("_tail"))
    totals += [F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_f_{name}") for name, c in fill.items()]
    blocks = base.where("_hot").groupBy(*keys, BLOCK).agg(*totals)
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums]
    carried += [F.sum("_rows").over(before).alias("_c_rank")] if rank else []
    carried += [F.lag("_tail").over(along).alias("_c_prev")] if prev else []
    carried += [F.last(f"_f_{name}", ignorenulls=True).over(before).alias(f"_c_{name}") for name in fill]
    carry = blocks.select(*keys, BLOCK, *carried)
    out = local.join(carry, [*keys, BLOCK], "left")
    fixed = {name: F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)) for name in sums}
    if rank:
        fixed[rank] = F.col(rank) + F.coalesce(F.col("_c_rank"), F.lit(0))
    if prev:
        fixed["_prev"] = F.coalesce("_prev", "_c_prev")
    fixed.update({name: F.coalesce(name, f"_c_{name}") for name in fill})
    extra = [f"_c_{name}" for name in [*sums, *fill]] + ["_c_rank", "_c_prev"]
    return out.withColumns(fixed).drop(*extra)


@dataclass(frozen=True)
class Blocks:
    """Where to cut along an order, and the keys large enough to be cut; no cuts where no key can be too large."""

    cuts: list[float]
    hot: DataFrame | None = None


def plan_blocks(df: DataFrame, keys: list[str], by: str, rows_per_block: int | None = None) -> Blocks:
    rows_per_block = rows_per_block or ROWS_PER_BLOCK
    rows = df.count()
    if rows <= rows_per_block:
        return Blocks([])
    parts = min(CUTS, max(2, ceil(rows / rows_per_block)))
    probes = F.array(*[F.lit(i / parts) for i in range(parts + 1)])
    # At most 129 numbers come back; they are the same for every later use, so a re-run task sees the same blocks.
    cuts = df.agg(F.percentile_approx(order_number(df, by), probes, F.lit(10000)).alias("c")).first()["c"]
    cuts = [x for x in cuts or [] if x == x]
    if not cuts:  # only NULL or NaN to order by
        cuts = [0.0]
    if not keys:
        return Blocks(sorted(set(cuts)))
    # At most rows / rows_per_block keys can pass the filter, so this side is small enough to send everywhere.
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_block)
    return Blocks(sorted(set(cuts)), hot.select(*keys, F.lit(True).alias("_hot")))


def _mark(df: DataFrame, keys: list[str], by: str, blocks: Blocks) -> DataFrame:
    """Add the block number, 0 for keys that need no cutting."""
    block = block_number(order_number(df, by), blocks.cuts)
    if not keys:
        return df.withColumn(BLOCK, block).withColumn("_hot", F.lit(True))
    return (
        df.join(F.broadcast(blocks.hot), keys, "left")
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        .withColumn(BLOCK, F.when(F.col("_hot"), block).otherwise(F.lit(0)))
    )


def order_number(df: DataFrame, by: str) -> Column:
    """The leading order column as a double in the same order: microseconds of both kinds of timestamps, days of dates."""
    kind = df.schema[by].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    return (F.unix_date(by) if kind == "date" else F.col(by)).cast("double")


def block_number(x: Column, cuts: list[float]) -> Column:
    """Order-preserving block of ``x``: a search tree over quantile cuts, each part cut again into equal widths.

    NULL comes first, as in an ascending window, and NaN last.
    """
    if len(cuts) < 2:
        return F.when(x.isNull(), -1).otherwise(0)
    spans = list(zip(cuts[:-1], cuts[1:]))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < spans[mid][1], search(lo, mid)).otherwise(search(mid + 1, hi))

    part = search(0, len(spans) - 1)
    low = F.element_at(F.array(*[F.lit(float(a)) for a, _ in spans]), part + 1)
    width = F.element_at(F.array(*[F.lit(float(b - a)) for a, b in spans]), part + 1)
    # NaN, which also comes of endless widths, counts as the largest.
    piece = F.greatest(F.lit(0.0), F.least((x - low) / width * SLICES, F.lit(SLICES - 1.0)))
    return F.when(x.isNull(), -1).otherwise(part * SLICES + F.floor(piece).cast("int"))


def exact_quantiles(
    df: DataFrame, groups: list[str], x: Column, qs: dict[str, float], rows_per_block: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any size.

    Equal values collapse first, positions come from the blocked running count, and only the two neighbours of each wanted
    position survive to the last aggregate. No group is held in one buffer, unlike ``percentile``.
    """
    values = df.select(*groups, x.alias("_x")).where("_x is not null").groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = ordered_scan(values, groups, ["_x"], "_x", sums={"_cum": F.col("_c")}, rows_per_block=rows_per_block)
    sizes = values.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    joined = placed.join(sizes, groups) if groups else attach(placed, sizes)
    at = {q: F.lit(q) * (F.col("_n") - 1) for q in qs.values()}

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum")), F.col("_x")))

    picks = [F.max("_n").alias("_n")]
    for name, q in qs.items():
        low = F.floor(at[q])
        picks += [value_at(low).alias(f"_lo_{name}"), value_at(F.least(low + 1, F.col("_n") - 1)).alias(f"_hi_{name}")]
    found = joined.groupBy(*groups).agg(*picks)
    out = []
    for name, q in qs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at[q] - F.floor(at[q]))).alias(name))
    return found.select(*groups, *out)
