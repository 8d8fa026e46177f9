"""Readers: day tables by month, header aliases, nested cubes, hourly payloads, tolerant logs, synthetic grids, calendars."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweather.functions import scalars as s
from gridweather.functions.hashing import u01

# Accepted headers, the first that exists counts.
ALIASES = {
    "t": ["t", "temperature"],
    "u": ["u", "u_component_of_wind"],
    "v": ["v", "v_component_of_wind"],
    "z": ["z", "geopotential"],
    "time": ["valid_time", "time"],
    "level": ["pressure_level", "level"],
    "lat": ["latitude", "lat"],
    "lon": ["longitude", "lon"],
}
DAY_FILE = r"era5_(\d{4})_(\d{2})_(\d{2})\.nc$"
# Pressure levels of the daily download.
DOWNLOAD_LEVELS = [1000, 925, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30, 20, 10]
PRESSURE_EXPONENT = 5.2561


def write_days(df: DataFrame, root: str, day: Column) -> None:
    """Day table: one folder per date, so later reads touch only the wanted dates."""
    staged = df.withColumn("_d", day).withColumns({"year": F.year("_d"), "month": F.month("_d"), "day": F.dayofmonth("_d")})
    staged.drop("_d").write.mode("append").partitionBy("year", "month", "day").parquet(root)


def read_months(spark: SparkSession, root: str, year: int, months: list[int], schema: str) -> DataFrame:
    """Rows of the wanted months only (other folders are never opened); a missing root is an empty table."""
    try:
        days = spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return days.where((F.col("year") == year) & F.col("month").isin(months))


def first_days(df: DataFrame, day: str, most: int) -> DataFrame:
    """Rows of the first ``most`` days in order; 0 means all."""
    if most == 0:
        return df
    # At most ``most`` dates are broadcast.
    return df.join(F.broadcast(df.select(day).distinct().orderBy(day).limit(most)), day, "left_semi")


def held_out_day(df: DataFrame, day: str, wanted: str | None = None) -> DataFrame:
    """Rows of the named date, else of the newest one; a date without rows is an error."""
    pick = wanted or df.agg(F.max(day).cast("string")).first()[0]
    rows = df.where(F.col(day) == F.lit(pick).cast("date"))
    if pick is None or (wanted and rows.isEmpty()):
        raise ValueError(f"no rows for {wanted or 'any day'}")
    return rows


def file_date(name: Column) -> Column:
    """Date in a day file's name, NULL where there is none."""
    parts = [F.regexp_extract(name, DAY_FILE, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def canonical_columns(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Rename known headers to their short names; other columns stay."""
    renames = {}
    for name in wanted or list(ALIASES):
        found = next((a for a in ALIASES[name] if a in df.columns), None)
        if found is None:
            raise ValueError(f"none of the columns exist: {', '.join(ALIASES[name])}")
        renames[found] = name
    return df.withColumnsRenamed(renames)


def cube_to_rows(df: DataFrame, cube: str, order: list[str]) -> DataFrame:
    """Long rows from nested arrays; ``order`` names the index of each nesting, outermost first, in whatever order it comes."""
    keep, out = [c for c in df.columns if c != cube], df
    for depth, name in enumerate(order):
        inner = cube if depth == len(order) - 1 else "_inner"
        out = out.select(*keep, F.posexplode(cube if depth == 0 else "_inner").alias(name, inner))
        keep = [*keep, name]
    return out.select(*keep, f"{cube}.*")


HOURLY = "hourly struct<time: array<string>, temperature_2m: array<double>, wind_speed_10m: array<double>>"


def hourly_rows(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row per hour from payloads of parallel arrays."""
    parsed = df.select(*keep, F.from_json(json, HOURLY).alias("_p"))
    zipped = F.arrays_zip(F.col("_p.hourly.time").alias("hour_key"), F.col("_p.hourly.temperature_2m").alias("temperature_c"), F.col("_p.hourly.wind_speed_10m").alias("wind_speed_mps"))
    return parsed.select(*keep, F.inline(zipped))


def at_hour(queries: DataFrame, hours: DataFrame, hour_key: str) -> tuple[DataFrame, DataFrame]:
    """Queries with the record of their hour, and those whose hour is missing."""
    return queries.join(hours, hour_key), queries.join(hours.select(hour_key), hour_key, "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated log: rows of another width than the header are dropped, bad or empty cells are NULL."""
    lines = spark.read.text(path)
    header = lines.first()["value"]
    names = header.split(",")
    cells = F.split("value", ",", -1)
    rows = lines.where(F.col("value") != header).where(F.size(cells) == len(names))
    return rows.select(*[F.get(cells, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def log_history(log: DataFrame, lists: DataFrame | None, position: str) -> DataFrame:
    """Long history (metric, pos, value): the JSON lists if there are any, else the log's columns without their empty cells.

    ``lists`` is a table of one JSON text per row, each an object of number lists. Columns may differ in length.
    """
    from gridweather.operators.ordered import ordered_scan

    if lists is not None:
        parsed = lists.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("metric", "_v"))
        return parsed.select("metric", F.posexplode("_v").alias("_i", "value")).select("metric", (F.col("_i") + 1).cast("bigint").alias("pos"), "value")
    columns = [c for c in log.columns if c != position]
    long = log.unpivot([position], columns, "metric", "value").where("value is not null")
    return ordered_scan(long, ["metric"], [position], position, rank="pos").select("metric", "pos", "value")


def linspace(i: Column, low: float, high: float, count: int, endpoint: bool = True) -> Column:
    parts = max(1, count - 1) if endpoint else count
    return F.lit(low) + i * ((high - low) / parts)


def synthetic_grid(
    spark: SparkSession, lat: tuple, lon: tuple, alt: tuple, day: tuple, hour: tuple, *, seed: int = 42, jitter: float = 0.5
) -> DataFrame:
    """Regular grid in a standard atmosphere; every axis is (low, high, count) and longitude leaves its end out.

    Pressure follows the temperature before the jitter, so it is constant above the tropopause.
    """
    counts = [axis[2] for axis in (lat, lon, alt, day, hour)]
    rows = spark.range(math.prod(counts))
    left, index = F.col("id"), []
    for n in reversed(counts):
        index.insert(0, left % n)
        left = F.floor(left / n)
    places = [linspace(i, *axis, endpoint=name != "lon") for i, axis, name in zip(index, (lat, lon, alt, day, hour), ("lat", "lon", "alt", "day", "hour"))]
    out = rows.select("id", *[p.alias(n) for p, n in zip(places, ("lat", "lon", "altitude_m", "day_of_year", "utc_hour"))])
    still = F.greatest(s.SEA_LEVEL_K - F.col("altitude_m") * s.LAPSE_RATE, F.lit(s.STRATOSPHERE_K))
    # Two hashed uniforms give a normal draw.
    noise = F.sqrt(F.ln(1.0 - u01(seed, "id")) * -2.0) * F.cos(u01(seed + 1, "id") * (2.0 * math.pi)) * jitter
    return out.withColumns(
        {
            "temperature_k": still + noise,
            "pressure_pa": F.pow(F.greatest(still / s.SEA_LEVEL_K, F.lit(1e-3)), F.lit(PRESSURE_EXPONENT)) * s.SEA_LEVEL_PA,
            "wind_u": F.sin(F.radians("lat")) * 5.0,
            "wind_v": F.cos(F.radians("lat")) * 2.0,
        }
    )


def real_or_synthetic(real: DataFrame, synthetic: DataFrame, label: str = "grid") -> DataFrame:
    """The real rows if there are any, else the synthetic ones; ``source`` says which."""
    columns = [c for c in synthetic.columns if c in real.columns]
    if real.isEmpty():
        return synthetic.select(*columns, F.lit("synthetic").alias("source"))
    return real.select(*columns, F.lit(label).alias("source"))


def download_slots(months: DataFrame, year: str, month: str, levels: list[int] = DOWNLOAD_LEVELS) -> DataFrame:
    """Every date, hour and level of the given months; leap years are honoured."""
    start = F.make_date(F.col(year), F.col(month), F.lit(1))
    days = months.select(F.explode(F.sequence(start, F.last_day(start))).alias("day"))
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.withColumn("level_hpa", F.explode(F.array(*[F.lit(p) for p in levels])))


def not_yet_stored(wanted: DataFrame, manifest: DataFrame, day: str) -> DataFrame:
    """Rows of days that the manifest does not list."""
    return wanted.join(manifest.select(day).distinct(), day, "left_anti")
