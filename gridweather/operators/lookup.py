"""Grid lookups: position on an axis by arithmetic, then an equi-join on the cell.

Axis values are few (a day's hours, a grid's rows and columns), so they are read once and placed in the plan as constants; no
range join is ever needed. A grid is first folded to one wide row per column of air, so a lookup meets one row per column and
not one per level. Columns are matched on integer keys, where a crowded one is split by the skew-join rule. What follows the
match is arithmetic inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridweather import session
from gridweather.functions.scalars import G0, c, clip, fold_lon_360, is_finite

AXIS_LIMIT = 100_000
BROADCAST_BYTES = 64 << 20
VALUES = ["t_k", "u_mps", "v_mps"]
CELL = ["time_i", "lat_i", "lon_i"]
DAY = "day"
#: Why a request has no values.
NO_CELL, NO_LEVEL = "no grid cell", "no usable level"


@dataclass(frozen=True)
class Axis:
    """Stored coordinate values by index; ascending or descending."""

    values: tuple[float, ...]

    @property
    def descending(self) -> bool:
        return self.values[0] > self.values[-1]

    @property
    def ascending_values(self) -> list[float]:
        return list(reversed(self.values)) if self.descending else list(self.values)

    def _literal(self) -> Column:
        return F.array(*[F.lit(float(a)) for a in self.ascending_values])

    def _step(self) -> float | None:
        a = self.ascending_values
        if len(a) < 2:
            return None
        step = (a[-1] - a[0]) / (len(a) - 1)
        even = all(abs(a[i] - (a[0] + i * step)) < 0.25 * step for i in range(len(a)))
        return step if even else None

    def _at_or_below(self, x: Column) -> Column:
        """How many ascending values are <= x, for x within the axis."""
        a, n, lit = self.ascending_values, len(self.values), self._literal()
        step = self._step()
        if step is None:
            return F.size(F.filter(lit, lambda v: v <= x))
        # Even axis: take one place below the division's answer, then step up past the stored values <= x.
        guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - a[0]) / step).cast("int") - 1))
        up = [(F.get(lit, guess + k) <= x) for k in (1, 2)]
        return guess + 1 + F.when(up[1], 2).when(up[0], 1).otherwise(0)

    # The three methods below add columns step by step, so that no expression is written out (and computed) several times.

    def bracket(self, df: DataFrame, x: Column | str, out: str) -> DataFrame:
        """Add struct ``out`` (lo, hi, frac): stored indices around x and the part of the way; held at the ends."""
        n, a, lit = len(self.values), self.ascending_values, self._literal()
        if n == 1:
            return df.withColumn(out, _bracket_struct(F.lit(0), F.lit(0), F.lit(0.0)))
        xc, count = F.col("_xc"), F.col("_count")
        df = df.withColumn("_xc", clip(x, a[0], a[-1])).withColumn("_count", self._at_or_below(xc))
        last = count >= n
        low, high = F.get(lit, count - 1), F.get(lit, count)
        frac = F.when(last, 0.0).otherwise((xc - low) / (high - low))
        lo, hi = F.when(last, n - 1).otherwise(count - 1), F.when(last, n - 1).otherwise(count)
        if self.descending:
            lo, hi = F.lit(n - 1) - lo, F.lit(n - 1) - hi
        return df.withColumn(out, _bracket_struct(lo, hi, frac)).drop("_xc", "_count")

    def table_bracket(self, df: DataFrame, x: Column | str, out: str) -> DataFrame:
        """As ``bracket`` for an ascending axis, but the top edge is (n-2, n-1, 1.0)."""
        n, b = len(self.values), F.col("_b")
        if n < 2 or self.descending:
            raise ValueError("a table axis needs at least two ascending values")
        top = b["lo"] == n - 1
        fixed = _bracket_struct(F.when(top, n - 2).otherwise(b["lo"]), b["hi"], F.when(top, 1.0).otherwise(b["frac"]))
        return self.bracket(df, x, "_b").withColumn(out, fixed).drop("_b")

    def nearest(self, df: DataFrame, x: Column | str, out: str) -> DataFrame:
        """Add the stored index of the nearest value; of two equally near the lower index."""
        if len(self.values) == 1:
            return df.withColumn(out, F.lit(0))
        lit = F.array(*[F.lit(float(a)) for a in self.values])
        b = F.col("_b")
        df = self.bracket(df.withColumn("_x", c(x)), "_x", "_b").withColumns(
            {"_dl": F.abs(F.get(lit, b["lo"]) - F.col("_x")), "_dh": F.abs(F.get(lit, b["hi"]) - F.col("_x"))}
        )
        near = F.when(F.col("_dl") < F.col("_dh"), b["lo"]).when(F.col("_dh") < F.col("_dl"), b["hi"])
        return df.withColumn(out, near.otherwise(F.least(b["lo"], b["hi"]))).drop("_x", "_b", "_dl", "_dh")


def _bracket_struct(lo, hi, frac) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), frac.cast("double").alias("frac"))


def read_axis(df: DataFrame, index: str, value: str) -> Axis:
    """Axis of a grid table. Only distinct (index, value) pairs come back; more than a fixed number is an error."""
    pairs = df.select(index, value).distinct().limit(AXIS_LIMIT + 1).collect()
    if not pairs:
        raise ValueError(f"the grid has no {value} axis")
    if len(pairs) > AXIS_LIMIT:
        raise ValueError(f"{value} has more than {AXIS_LIMIT} values; it is not an axis")
    by_index = {row[0]: float(row[1]) for row in pairs}
    if sorted(by_index) != list(range(len(by_index))) or len(by_index) != len(pairs):
        raise ValueError(f"{index} must run from 0 without gaps, one {value} each")
    return Axis(tuple(by_index[i] for i in range(len(by_index))))


@dataclass(frozen=True)
class GridAxes:
    time: Axis
    lat: Axis
    lon: Axis
    levels: dict[int, float]
    """Pressure in hPa by level index."""


def grid_axes(grid: DataFrame) -> GridAxes:
    """The axes of a long grid in one pass; the time axis is that of a day."""
    pairs = (
        grid.select(
            F.explode(
                F.array(
                    F.struct(F.lit("time").alias("axis"), F.col("time_i").alias("i"), F.col("t_sec").cast("double").alias("x")),
                    F.struct(F.lit("lat").alias("axis"), F.col("lat_i").alias("i"), F.col("lat").alias("x")),
                    F.struct(F.lit("lon").alias("axis"), F.col("lon_i").alias("i"), F.col("lon").alias("x")),
                    F.struct(F.lit("level").alias("axis"), F.col("level_i").alias("i"), F.col("level_hpa").alias("x")),
                )
            ).alias("p")
        )
        .select("p.*")
        .distinct()
        .limit(AXIS_LIMIT + 1)
        .collect()
    )
    if len(pairs) > AXIS_LIMIT:
        raise ValueError("the grid's axes have too many values")
    found = {name: {p["i"]: p["x"] for p in pairs if p["axis"] == name} for name in ("time", "lat", "lon")}
    for name, axis in found.items():
        if sorted(axis) != list(range(len(axis))):
            raise ValueError(f"the {name} index must run from 0 without gaps")
    levels = {p["i"]: p["x"] for p in pairs if p["axis"] == "level"}
    return GridAxes(*[Axis(tuple(found[n][i] for i in range(len(found[n])))) for n in ("time", "lat", "lon")], dict(sorted(levels.items())))


def grid_lon(lon: Column | str, axis: Axis, wrap: bool = False) -> Column:
    """Query longitude in the grid's own range; ``wrap`` also closes the seam by whole turns."""
    x = fold_lon_360(lon) if max(axis.values) > 180.0 else c(lon)
    if wrap:
        x = F.pmod(c(lon) - min(axis.values), F.lit(360.0)) + min(axis.values)
    return x


def cell_keys(grid: DataFrame) -> list[str]:
    """What names a column of air: its place and hour, and the day where the grid holds several (then queries name it too)."""
    return [DAY, *CELL] if DAY in grid.columns else CELL


def grid_profiles(grid: DataFrame, axes: GridAxes) -> DataFrame:
    """One row per (time, lat, lon) with a column per level and variable, named like ``t_k_3``.

    Worth writing once, bucketed by the three indices, where many lookups follow. Several values for one level of a column of air,
    as of several days without a ``day``, are an error.
    """
    picks = [
        F.max(F.when(F.col("level_i") == level, F.col(name))).alias(f"{name}_{level}") for level in axes.levels for name in [*VALUES, "z_m2s2"]
    ]
    # Counted for each level by itself, so that another level that is absent hides nothing.
    most = [F.count_if(F.col("level_i") == level) for level in axes.levels]
    clash = F.when(F.greatest(*most, F.lit(0)) > 1, F.raise_error(F.lit("several values for one grid cell; give the grid a day column")).cast("boolean"))
    wide = grid.groupBy(*cell_keys(grid)).agg(*picks, clash.alias("_clash"))
    return wide.where("_clash is null").drop("_clash")


def _match_cells(queries: DataFrame, profiles: DataFrame, axes: GridAxes, entries: int | None = None, how: str = "inner") -> DataFrame:
    """Join the columns of air on their indices. The axes bound their size: small grids are broadcast, others shuffled.

    ``entries`` is the length of a column, the number of levels if not given.
    """
    cells = len(axes.time.values) * len(axes.lat.values) * len(axes.lon.values)
    size = cells * ((entries or len(axes.levels)) * (len(VALUES) + 3) + len(CELL)) * 8
    bounded = size <= BROADCAST_BYTES and DAY not in profiles.columns  # the axes do not bound the number of days
    return queries.join(F.broadcast(profiles) if bounded else profiles, cell_keys(profiles), how)


def _entry(level: int, hpa: float) -> Column:
    """A level's values as a struct in height order, NULL where one is not a number."""
    names = [f"{n}_{level}" for n in [*VALUES, "z_m2s2"]]
    whole = is_finite(names[0])
    for n in names[1:]:
        whole = whole & is_finite(n)
    fields = [(F.col(names[3]) / G0).alias("z"), F.lit(level).alias("level_i"), *[F.col(n).alias(v) for n, v in zip(names, VALUES)]]
    return F.when(whole, F.struct(*fields, F.lit(hpa * 100.0).alias("p")))


def sorted_profiles(grid: DataFrame, axes: GridAxes) -> DataFrame:
    """One row per column of air with the array ``profile`` of its usable levels in height order.

    Of equal heights only the first level counts; a column without any usable level has an empty one.
    """
    wide, cell = grid_profiles(grid, axes), cell_keys(grid)
    every = F.array_sort(F.array_compact(F.array(*[_entry(level, hpa) for level, hpa in axes.levels.items()])))
    new = F.filter("_all", lambda e, i: (i == 0) | (e["z"] > F.get(F.col("_all"), i - 1)["z"]))
    return wide.select(*cell, every.alias("_all")).select(*cell, new.alias("profile"))


def nearest_cells(queries: DataFrame, axes: GridAxes, t_sec: str = "t_query") -> DataFrame:
    """Add the nearest hour, latitude and longitude index, each chosen by itself."""
    keyed = axes.time.nearest(queries, t_sec, "time_i")
    keyed = axes.lat.nearest(keyed, "lat", "lat_i")
    return axes.lon.nearest(keyed, grid_lon("lon", axes.lon), "lon_i")


def nearest_columns(queries: DataFrame, grid: DataFrame, axes: GridAxes, *, t_sec="t_query") -> DataFrame:
    """Levels of the nearest column, one row each; a query whose column is not there has one row with null levels and a ``reason``."""
    cells = grid.select(*cell_keys(grid), "level_i", "level_hpa", *VALUES, "z_m2s2")
    met = nearest_cells(queries, axes, t_sec).join(cells, cell_keys(grid), "left")
    return met.withColumn("reason", F.when(F.col("level_i").isNull(), NO_CELL))


def nearest_profiles(queries: DataFrame, grid: DataFrame, axes: GridAxes, *, t_sec="t_query") -> DataFrame:
    """Every query with the sorted profile of its nearest column, or null and the ``reason``."""
    met = _match_cells(nearest_cells(queries, axes, t_sec), sorted_profiles(grid, axes), axes, how="left")
    reason = F.when(F.col("profile").isNull(), NO_CELL).when(F.size("profile") == 0, NO_LEVEL)
    return met.withColumns({"reason": reason, "profile": F.when(F.size("profile") > 0, F.col("profile"))})


def resampled_profiles(queries: DataFrame, grid: DataFrame, axes: GridAxes, heights: list[float], *, t_sec="t_query") -> DataFrame:
    """Queries with the values of their nearest column at fixed heights, one row per height (``step``, ``altitude_m``).

    A column is resampled once, in its own row, however many queries meet it. A query whose column is not there, or has no usable
    level, has one row with null values and a ``reason``.
    """
    cell, p = cell_keys(grid), F.col("profile")

    def at(h: Column, step: Column) -> Column:
        """As ``at_height`` with linear pressure."""
        below = F.size(F.filter(p, lambda e: e["z"] <= h))
        low, high = F.get(p, F.greatest(below - 1, F.lit(0))), F.get(p, F.least(below, F.size(p) - 1))
        gap = high["z"] - low["z"]
        part = F.when(gap > 0, (F.greatest(low["z"], F.least(high["z"], h)) - low["z"]) / F.when(gap > 0, gap).otherwise(1.0)).otherwise(0.0)
        values = [(low[n] + (high[n] - low[n]) * part).alias(n if n != "p" else "p_pa") for n in [*VALUES, "p"]]
        return F.struct(step.alias("step"), h.alias("altitude_m"), *values)

    steps = F.transform(F.array(*[F.lit(float(x)) for x in heights]), at)
    packed = sorted_profiles(grid, axes).select(*cell, F.when(F.size(p) > 0, steps).otherwise(F.slice(steps, 1, 0)).alias("_rows"))
    met = _match_cells(nearest_cells(queries, axes, t_sec), packed, axes, len(heights), how="left")
    reason = F.when(F.col("_rows").isNull(), NO_CELL).when(F.size("_rows") == 0, NO_LEVEL)
    return met.select(*queries.columns, reason.alias("reason"), F.inline_outer("_rows"))


def _placed(queries: DataFrame, axes: GridAxes, t_sec: str, wrap_lon: bool) -> DataFrame:
    """Queries with their brackets ``_t``, ``_y`` and ``_x`` on the three axes."""
    placed = axes.time.bracket(queries, t_sec, "_t")
    placed = axes.lat.bracket(placed, "lat", "_y")
    lon = grid_lon("lon", axes.lon, wrap_lon)
    placed = axes.lon.bracket(placed, lon, "_x")
    if wrap_lon and len(axes.lon.values) > 1:
        # East of the last value the first one follows, a whole turn on.
        ends = axes.lon.ascending_values
        gap = ends[0] + 360.0 - ends[-1]
        low, high = (0, len(ends) - 1) if axes.lon.descending else (len(ends) - 1, 0)
        over = _bracket_struct(F.lit(low), F.lit(high), (lon - ends[-1]) / gap) if gap > 0 else F.col("_x")
        placed = placed.withColumn("_x", F.when(lon > ends[-1], over).otherwise(F.col("_x")))
    return placed


def corner_weights(queries: DataFrame, axes: GridAxes, *, t_sec="t_query", wrap_lon: bool = False) -> DataFrame:
    """One row per query and surrounding (time, lat, lon) corner with its weight: up to eight, fewer on an edge."""
    placed = _placed(queries, axes, t_sec, wrap_lon)

    def corner(picks: tuple[int, int, int]) -> Column:
        """One corner; the upper end of a bracket counts only where it differs from the lower."""
        there, weight, index = F.lit(True), F.lit(1.0), []
        for name, upper in zip(("_t", "_y", "_x"), picks):
            b = F.col(name)
            inside = b["lo"] != b["hi"]
            there = there & inside if upper else there
            weight = weight * (b["frac"] if upper else F.when(inside, 1.0 - b["frac"]).otherwise(1.0))
            index.append(b["hi"] if upper else b["lo"])
        t, y, x = index
        return F.when(there, F.struct(t.alias("time_i"), y.alias("lat_i"), x.alias("lon_i"), weight.alias("w")))

    corners = F.array_compact(F.array(*[corner((i, j, k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    return (
        placed.withColumn("_c", F.explode(corners))
        .withColumns({"time_frac": F.col("_t.frac"), "time_lo": F.col("_t.lo"), "time_hi": F.col("_t.hi"), "corners": F.size(corners)})
        .select("*", "_c.*")
        .drop("_c", "_t", "_y", "_x")
    )


CORNERS = 8


def halo_tiles(grid: DataFrame, axes: GridAxes) -> DataFrame:
    """One row per cell with its 2 x 2 x 2 neighbours in it, so that an interpolation meets one row: worth writing once.

    ``levels`` is an array over the levels, each with an array of eight values per variable, in the order of the corner's bits
    (time, latitude, longitude; 0 for the cell itself, 1 for the next index). A column of air stands in the tiles of up to eight
    cells. East of the last longitude the first one follows; whether that corner counts is up to the query.
    """
    cell, wide = cell_keys(grid), grid_profiles(grid, axes)
    names = [*VALUES, "z_m2s2"]
    column = F.array(*[F.struct(*[F.col(f"{n}_{level}").alias(n) for n in names]) for level in axes.levels])
    last = len(axes.lon.values) - 1

    def seat(t: int, y: int, x: int) -> Column:
        east = F.when((F.col("lon_i") == 0) & F.lit(last > 0), F.lit(last)).otherwise(F.col("lon_i") - 1) if x else F.col("lon_i")
        own = F.struct((F.col("time_i") - t).alias("time_i"), (F.col("lat_i") - y).alias("lat_i"), east.cast("int").alias("lon_i"), F.lit(4 * t + 2 * y + x).alias("corner"))
        return F.when((own["time_i"] >= 0) & (own["lat_i"] >= 0) & (own["lon_i"] >= 0), own)

    seats = F.array_compact(F.array(*[seat(t, y, x) for t in (0, 1) for y in (0, 1) for x in (0, 1)]))
    rest = [k for k in cell if k not in CELL]
    seated = wide.select(*rest, column.alias("_column"), F.explode(seats).alias("_s")).select(*rest, "_s.*", "_column")
    met = seated.groupBy(*cell).agg(*[F.max(F.when(F.col("corner") == i, F.col("_column"))).alias(f"_{i}") for i in range(CORNERS)])

    def level(i: int, number: int, hpa: float) -> Column:
        values = [F.array(*[F.get(F.col(f"_{k}"), F.lit(i))[n] for k in range(CORNERS)]).alias(n) for n in names]
        return F.struct(F.lit(number).alias("level_i"), F.lit(float(hpa)).alias("level_hpa"), *values)

    return met.select(*cell, F.array(*[level(i, number, hpa) for i, (number, hpa) in enumerate(axes.levels.items())]).alias("levels"))


def corner_cells(queries: DataFrame, axes: GridAxes, *, t_sec="t_query", wrap_lon: bool = False) -> DataFrame:
    """Queries with the cell whose tile they need and ``_w``, the weights of its eight corners: null where a corner does not count."""
    placed = _placed(queries, axes, t_sec, wrap_lon)
    ends = {}
    for name, index in zip(("_t", "_y", "_x"), CELL):
        b = F.col(name)
        one, seam = b["lo"] == b["hi"], F.abs(b["lo"] - b["hi"]) > 1
        first = F.when(seam, F.greatest(b["lo"], b["hi"])).otherwise(F.least(b["lo"], b["hi"]))
        # The bracket's upper end is the tile's far corner on an ascending axis and its near one on a descending one.
        far = F.when(b["hi"] == first, 1.0 - b["frac"]).otherwise(b["frac"])
        ends[index] = (first, F.when(one, 1.0).otherwise(1.0 - far), F.when(~one, far))
    placed = placed.withColumns({i: e[0] for i, e in ends.items()} | {f"_near_{i}": e[1] for i, e in ends.items()} | {f"_far_{i}": e[2] for i, e in ends.items()})

    def weight(bits: tuple[int, int, int]) -> Column:
        t, y, x = [F.col(f"_far_{i}" if bit else f"_near_{i}") for bit, i in zip(bits, CELL)]
        return t * y * x

    weights = F.array(*[weight((t, y, x)) for t in (0, 1) for y in (0, 1) for x in (0, 1)])
    out = placed.withColumn("_w", weights).withColumns({"time_frac": F.col("_t.frac"), "time_lo": F.col("_t.lo"), "time_hi": F.col("_t.hi")})
    return out.drop("_t", "_y", "_x", *[f"_{end}_{i}" for end in ("near", "far") for i in CELL])


def interpolated_profiles(queries: DataFrame, grid: DataFrame, axes: GridAxes, *, t_sec="t_query", wrap_lon: bool = False, tiles: DataFrame | None = None) -> DataFrame:
    """Bilinear in place and linear in time for all levels at once: every query with ``levels``, an array of structs by level.

    One equi-join with the halo tiles, arithmetic over arrays in the row, no aggregate: a query travels once. A value with a
    missing corner is NaN, also where that corner's weight is zero. ``levels`` is null where the grid has no cell there.
    """
    tiles = halo_tiles(grid, axes) if tiles is None else tiles
    names = [*VALUES, "z_m2s2"]
    met = _match_cells(corner_cells(queries, axes, t_sec=t_sec, wrap_lon=wrap_lon), tiles, axes, CORNERS * len(axes.levels), how="left")

    def blend(values: Column) -> Column:
        terms = F.zip_with(F.col("_w"), values, lambda w, x: F.when(w.isNull(), 0.0).otherwise(w * F.coalesce(x, F.lit(float("nan")))))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    each = F.transform("levels", lambda v: F.struct(v["level_i"].alias("level_i"), v["level_hpa"].alias("level_hpa"), *[blend(v[n]).alias(n) for n in names]))
    return met.select(*queries.columns, "time_frac", "time_lo", "time_hi", each.alias("levels"))


def interpolated_columns(queries: DataFrame, grid: DataFrame, axes: GridAxes, *, t_sec="t_query", wrap_lon: bool = False) -> DataFrame:
    """``interpolated_profiles`` with a column per level and variable, named like ``t_k_3``; NaN where there is no cell."""
    met = interpolated_profiles(queries, grid, axes, t_sec=t_sec, wrap_lon=wrap_lon)
    values = [F.coalesce(F.get("levels", F.lit(i))[n], F.lit(float("nan"))).alias(f"{n}_{level}") for i, level in enumerate(axes.levels) for n in [*VALUES, "z_m2s2"]]
    return met.select(*queries.columns, "time_frac", "time_lo", "time_hi", *values)


def level_rows(profiles: DataFrame, keep: list[str]) -> DataFrame:
    """One row per level of ``interpolated_profiles``."""
    return profiles.select(*keep, F.inline("levels"))


def usable_levels(levels: Column) -> Column:
    """The levels whose values are all numbers, in height order; of equal heights the first level counts."""
    entry = lambda v: F.struct((v["z_m2s2"] / G0).alias("z"), v["level_i"].alias("level_i"), *[v[n].alias(n) for n in VALUES], (v["level_hpa"] * 100.0).alias("p"))
    number = lambda v, n: v[n].isNotNull() & ~F.isnan(v[n]) & (F.abs(v[n]) < float("inf"))
    whole = lambda v: number(v, "t_k") & number(v, "u_mps") & number(v, "v_mps") & number(v, "z_m2s2")
    return F.array_sort(F.transform(F.filter(levels, whole), entry))


def at_height(df: DataFrame, height: str, pressure: str = "log") -> DataFrame:
    """Values of the row's profile at a height: linear, pressure linear or logarithmic, held at the ends.

    Adds the four values, the height as held (``clipped_m``) and the nearer level's height and pressure.
    """
    p, h = F.col("profile"), F.col(height)
    df = df.withColumns({"_below": F.size(F.filter(p, lambda e: e["z"] <= h)), "_size": F.size(p)})
    df = df.withColumns(
        {"_lo": F.get(p, F.greatest(F.col("_below") - 1, F.lit(0))), "_hi": F.get(p, F.least(F.col("_below"), F.col("_size") - 1))}
    )
    df = df.withColumn("clipped_m", F.greatest(F.col("_lo.z"), F.least(F.col("_hi.z"), h)))
    return between(df, "clipped_m", pressure).drop("_below", "_size")


def exact_lookup(queries: DataFrame, grid: DataFrame, axes: GridAxes, height: str, *, t_sec="t_query", wrap_lon=False, pressure="log", tiles: DataFrame | None = None):
    """Values at any place, time and height: bilinear, linear in time and height, pressure by its logarithm.

    Every query has its row. Where the grid cannot answer, the values are null and ``reason`` says why; else it is null.
    """
    met = interpolated_profiles(queries, grid, axes, t_sec=t_sec, wrap_lon=wrap_lon, tiles=tiles)
    sorted_levels = met.withColumn("_all", usable_levels(F.col("levels")))
    new = F.filter("_all", lambda e, i: (i == 0) | (e["z"] > F.get(F.col("_all"), i - 1)["z"]))
    staged = sorted_levels.withColumn("profile", F.when(F.size("_all") > 0, new))
    reason = F.when(F.col("levels").isNull(), NO_CELL).when(F.col("profile").isNull(), NO_LEVEL)
    return at_height(staged.withColumn("reason", reason).drop("levels", "_all"), height, pressure).drop("profile")


def between(df: DataFrame, at: str, pressure: str) -> DataFrame:
    """The four values at height ``at`` between the entries ``_lo`` and ``_hi``, and the nearer entry's height and pressure."""
    a, b, f = F.col("_lo"), F.col("_hi"), F.col("_f")
    gap = b["z"] - a["z"]
    df = df.withColumn("_f", F.when(gap > 0, (F.col(at) - a["z"]) / F.when(gap > 0, gap).otherwise(1.0)).otherwise(0.0))
    if pressure == "log":
        la, lb = F.ln(F.greatest(a["p"], F.lit(1.0))), F.ln(F.greatest(b["p"], F.lit(1.0)))
        p = F.exp(la + (lb - la) * f)
    else:
        p = a["p"] + (b["p"] - a["p"]) * f
    nearer = F.when(F.abs(a["z"] - F.col(at)) <= F.abs(b["z"] - F.col(at)), a).otherwise(b)
    return df.withColumns(
        {n: a[n] + (b[n] - a[n]) * f for n in VALUES} | {"p_pa": p, "near_z_m": nearer["z"], "near_p_pa": nearer["p"]}
    ).drop("_lo", "_hi", "_f")


def table_lookup(queries: DataFrame, table: DataFrame, a: Axis, b: Axis, x: str, y: str, values: list[str], id_col: str, planes: list[str] | None = None) -> DataFrame:
    """Bilinear lookup in a two-axis value table with columns a_i, b_i and any number of value columns.

    ``id_col`` names each query. A value with an absent corner is NaN. ``planes`` names columns that tell several tables over the
    same axes apart: a query then has a row for each of them that holds any of its corners.
    """
    placed = b.table_bracket(a.table_bracket(queries, x, "_p"), y, "_q")
    p, q = F.col("_p"), F.col("_q")
    places = [(i, j) for i in (0, 1) for j in (0, 1)]
    weights = [(p["frac"] if i else 1.0 - p["frac"]) * (q["frac"] if j else 1.0 - q["frac"]) for i, j in places]
    if planes:
        return _plane_lookup(placed, table, places, weights, values, id_col, planes)
    corners = F.array(
        *[F.struct((p["hi"] if i else p["lo"]).alias("a_i"), (q["hi"] if j else q["lo"]).alias("b_i"), w.alias("w")) for (i, j), w in zip(places, weights)]
    )
    keyed = placed.select(id_col, F.explode(corners).alias("_c")).select(id_col, "_c.*")
    joined = keyed.join(table.select("a_i", "b_i", *values), ["a_i", "b_i"], "left")
    return joined.groupBy(id_col).agg(*[F.sum(F.col("w") * F.coalesce(F.col(n), F.lit(float("nan")))).alias(n) for n in values])


def _plane_lookup(placed, table, places, weights, values, id_col, planes):
    """Queries meet the four corners of their place, plane by plane, in one row; corners of a query are never shuffled.

    The corner tiles and the ids that come more than once are written, so Spark sees their size and sends them to the queries while
    they are small. Only rows of a repeated id are added up by id.
    """
    spark, folder = placed.sparkSession, session.new_folder(placed.sparkSession, "planes")
    # The upper index of a table bracket is always the lower one plus one.
    corner = F.array(*[F.struct((F.col("a_i") - i).alias("_a"), (F.col("b_i") - j).alias("_b"), F.lit(k).alias("_k")) for k, (i, j) in enumerate(places)])
    nan, found = F.lit(float("nan")), F.col("_k")
    sums = [F.coalesce(F.sum(F.when(found == k, F.coalesce(F.col(n).cast("double"), nan))), F.lit(0.0)).alias(f"_{n}_{k}") for n in values for k in range(4)]
    tiles = table.select(*planes, *values, F.explode(corner).alias("_c")).select(*planes, *values, "_c.*")
    tiles.groupBy("_a", "_b", *planes).agg(F.count(F.lit(1)).alias("_corners"), *sums).write.parquet(f"{folder}/tiles")
    placed.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id").write.parquet(f"{folder}/repeated")
    tiles, repeated = spark.read.parquet(f"{folder}/tiles"), spark.read.parquet(f"{folder}/repeated")

    keyed = placed.select(F.col(id_col), F.col("_p.lo").alias("_a"), F.col("_q.lo").alias("_b"), *[w.alias(f"_w_{k}") for k, w in enumerate(weights)])
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    part = [sum((F.col(f"_w_{k}") * F.col(f"_{n}_{k}") for k in range(1, 4)), F.col("_w_0") * F.col(f"_{n}_0")).alias(n) for n in values]

    def met(rows):
        return rows.join(tiles, ["_a", "_b"]).select(id_col, *planes, "_corners", *part)

    def whole(corners, value, name):
        return F.when(corners == 4, value).otherwise(nan).alias(name)

    once = met(keyed.join(repeated, same, "left_anti")).select(id_col, *planes, *[whole(F.col("_corners"), F.col(n), n) for n in values])
    more = met(keyed.join(repeated, same, "left_semi")).groupBy(id_col, *planes).agg(*[whole(F.sum("_corners"), F.sum(n), n) for n in values])
    return once.unionByName(more)


def exact_or_model(requests: DataFrame, exact: DataFrame, model: DataFrame, days: DataFrame, *, id_col: str, day: str, mode: str) -> DataFrame:
    """Answer each request by its mode: the exact value, the model value, or the exact one where its day exists.

    ``exact`` and ``model`` hold (id, value struct); ``days`` the stored days. An exact request without a value gets no answer
    and a reason.
    """
    known = days.select(F.col(day)).distinct().withColumn("_day", F.lit(True))
    joined = (
        requests.join(known, day, "left")
        .join(exact.select(id_col, F.col("value").alias("_e")), id_col, "left")
        .join(model.select(id_col, F.col("value").alias("_m")), id_col, "left")
    )
    has_day = F.coalesce("_day", F.lit(False))
    use_exact = (F.col(mode) == "exact") | ((F.col(mode) == "hybrid") & has_day)
    return joined.select(
        *requests.columns,
        F.when(use_exact, F.when(has_day, F.col("_e"))).otherwise(F.col("_m")).alias("value"),
        F.when(use_exact & has_day & F.col("_e").isNotNull(), "exact")
        .when(use_exact & has_day, "no value for the point")
        .when(use_exact, "day missing")
        .otherwise("model")
        .alias("source"),
    )
