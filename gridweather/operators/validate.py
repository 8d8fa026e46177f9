"""Record checks: range, finiteness, strict JSON records with reasons, point lists, fallback rows, envelopes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridweather.operators.attach import attach
from gridweather.functions import scalars as s

# Accepted range of a query.
QUERY_RANGES = {
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
    "altitude_m": (0.0, 32000.0),
    "day_of_year": (1.0, 366.0),
    "utc_hour": (0.0, 24.0),
    "year": (1900.0, 2100.0),
}
# Believable surface conditions and what stands in for others.
SURFACE_K, SURFACE_PA = (150.0, 350.0), (50000.0, 120000.0)
MAX_POINTS = 30000
OBJECT_ID = "(?i)^[a-f0-9]{24}$"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(all_of([s.is_finite(c) for c in columns]))


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    return all_of([F.coalesce(F.col(n).between(lo, hi), F.lit(False)) for n, (lo, hi) in ranges.items()])


@dataclass(frozen=True)
class RecordRule:
    """Shape of a JSON record: bounded numbers, one-of texts with a default, and nothing else."""

    numbers: dict[str, tuple[float, float]]
    choices: dict[str, tuple[list[str], str]] = field(default_factory=dict)


def check_records(df: DataFrame, json: str, rule: RecordRule) -> DataFrame:
    """Add ``reasons`` (all faults, sorted) and ``record`` (typed, with defaults; NULL where there is a fault)."""
    staged = df.withColumn("_v", F.try_parse_json(json)).withColumn("_keys", F.json_object_keys(json))
    number = F.lit("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
    kinds = {f"_k_{n}": F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")) for n in rule.numbers}
    staged = staged.withColumns(kinds | {f"_x_{n}": F.try_variant_get("_v", f"$.{n}", "double") for n in rule.numbers})
    staged = staged.withColumns({f"_k_{n}": F.coalesce(F.regexp_like(f"_k_{n}", number), F.lit(False)) for n in rule.numbers})
    reasons: list[Column] = [F.when(F.col("_v").isNull() | F.col("_keys").isNull(), F.lit("not an object"))]
    typed = []
    for name, (low, high) in rule.numbers.items():
        is_number, value = F.col(f"_k_{name}"), F.col(f"_x_{name}")
        present = F.array_contains("_keys", name)
        reasons += [
            F.when(~present, F.lit(f"{name} missing")),
            F.when(present & ~is_number, F.lit(f"{name} not a number")),
            F.when(is_number & ~s.is_finite(value), F.lit(f"{name} not finite")),
            F.when(is_number & (value < low), F.lit(f"{name} below {low:g}")),
            F.when(is_number & (value > high), F.lit(f"{name} above {high:g}")),
        ]
        typed.append(F.when(is_number, value).alias(name))
    for name, (allowed, default) in rule.choices.items():
        value = F.try_variant_get("_v", f"$.{name}", "string")
        present = F.array_contains("_keys", name)
        reasons.append(F.when(present & ~F.coalesce(value.isin(allowed), F.lit(False)), F.lit(f"{name} not allowed")))
        typed.append(F.when(present, value).otherwise(default).alias(name))
    known = F.array(*[F.lit(n) for n in [*rule.numbers, *rule.choices]])
    extra = F.transform(F.array_except(F.coalesce("_keys", F.array().cast("array<string>")), known), lambda k: F.concat(F.lit("unknown "), k))
    found = F.array_sort(F.concat(F.array_compact(F.array(*reasons)), extra))
    out = staged.withColumn("reasons", found).withColumn("record", F.when(F.size("reasons") == 0, F.struct(*typed)))
    return out.drop("_v", "_keys", *[f"_{c}_{n}" for c in "kx" for n in rule.numbers])


def points_ok(points: str, duration: str, limit: int = MAX_POINTS) -> Column:
    """A run document is whole: 1 to ``limit`` points, each with finite lon, lat and alt, and a finite duration."""
    good = F.forall(points, lambda p: s.is_finite(p["lon"]) & s.is_finite(p["lat"]) & s.is_finite(p["alt"]))
    return F.coalesce(F.size(points).between(1, limit) & good, F.lit(False)) & s.is_finite(duration)


def surface_or_fallback(df: DataFrame, fields: list[str]) -> DataFrame:
    """Surface conditions from (t_c, p_hpa, east, north, ...) or, if any is missing or out of bounds, the standard row as a whole."""
    kelvin, pa = s.celsius_to_kelvin("t_c"), s.hpa_to_pa("p_hpa")
    missing = ~all_of([F.col(f).isNotNull() for f in fields])
    note = (
        F.when(missing, "field missing")
        .when(~kelvin.between(*SURFACE_K), "temperature out of bounds")
        .when(~pa.between(*SURFACE_PA), "pressure out of bounds")
    )
    own = F.struct(kelvin.alias("temperature_k"), pa.alias("pressure_pa"), F.col("east"), F.col("north"))
    still = F.struct(F.lit(s.SEA_LEVEL_K).alias("temperature_k"), F.lit(s.SEA_LEVEL_PA).alias("pressure_pa"), F.lit(0.0).alias("east"), F.lit(0.0).alias("north"))
    out = df.withColumn("note", note)
    return out.withColumn("conditions", F.when(F.col("note").isNull(), own).otherwise(still))


def envelope_flag(df: DataFrame, bounds: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """How far each row lies outside the training envelope, in units of its span, and whether that is too far.

    ``bounds`` is the long (name, low, high) table of ``stats.envelope``: one row per column.
    """
    from gridweather.operators.stats import wide

    one = wide(bounds.where(F.col("name").isin(columns)), columns, ["low", "high"])
    parts = []
    for n in columns:
        x, low, high = F.col(n), F.col(f"{n}_low"), F.col(f"{n}_high")
        span = F.when(high > low, high - low).otherwise(1.0)
        parts.append(F.greatest(F.lit(0.0), low - x, x - high) / span)
    out = attach(df, one).withColumn("excursion", F.greatest(F.lit(0.0), *parts))
    return out.withColumn("outside", F.col("excursion") > threshold).drop(*one.columns)


def sane_state(limits: dict[str, float]) -> Column:
    """Every column is finite and within its magnitude."""
    return all_of([s.is_finite(n) & (F.abs(n) <= limit) for n, limit in limits.items()])


def complete_override(given: dict[str, str], default: dict[str, Column]) -> dict[str, Column]:
    """The given fields count only if all of them are present."""
    whole = all_of([F.col(c).isNotNull() for c in given.values()])
    return {n: F.when(whole, F.col(c)).otherwise(default[n]) for n, c in given.items()} | {"overridden": whole}
