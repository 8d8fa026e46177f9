"""Units, angles, time parts, wind and standard-atmosphere arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of the data model; results depend on them.
G0 = 9.80665
ISA_G = 9.81
R_DRY_AIR = 287.05
LAPSE_RATE = 0.0065
TROPOPAUSE_M = 11000.0
ISA_TOP_M = 20000.0
STRATOSPHERE_K = 216.65
SEA_LEVEL_K = 288.15
SEA_LEVEL_PA = 101325.0
EARTH_RADIUS_M = 6371000.0
ALTITUDE_MIN_M, ALTITUDE_MAX_M = 0.0, 32000.0
YEAR_DAYS = 365.25
ROW_YEAR_DAYS = 365.0
MIN_WIND_MPS = 0.1
KELVIN_OFFSET = 273.15


def c(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x, low, high) -> Column:
    return F.greatest(c(low), F.least(c(high), c(x)))


def is_finite(x) -> Column:
    """True for an ordinary number; false for NULL, NaN and the infinities."""
    x = c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def fold_lon_180(lon) -> Column:
    lon = c(lon)
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def fold_lon_360(lon) -> Column:
    lon = c(lon)
    return F.when(lon < 0.0, lon + 360.0).otherwise(lon)


def altitude_from_geopotential(z) -> Column:
    return clip(c(z) / G0, ALTITUDE_MIN_M, ALTITUDE_MAX_M)


def hpa_to_pa(p) -> Column:
    return c(p) * 100.0


def celsius_to_kelvin(t) -> Column:
    return c(t) + KELVIN_OFFSET


def solar_hour(utc_hour, lon) -> Column:
    return F.pmod(c(utc_hour) + fold_lon_180(lon) / 15.0, F.lit(24.0))


def utc_hour(ts) -> Column:
    """Fractional hour of the day, whole seconds."""
    ts = c(ts)
    return F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0


def time_parts(ts, now: Column) -> dict[str, Column]:
    """Day of year, fractional hour and year; an absent time means the given ``now``."""
    when = F.coalesce(c(ts), now)
    return {"day_of_year": F.dayofyear(when), "utc_hour": utc_hour(when), "year": F.year(when)}


def time_from_day(year, day_of_year, hour) -> Column:
    """Time from year, day of year (fraction dropped, 1..366) and hour; NULL outside the range."""
    day = F.floor(c(day_of_year)).cast("int")
    start = F.make_timestamp(c(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    micros = F.floor((day - 1) * 86400.0 + c(hour) * 3600.0).cast("bigint")
    return F.when(day.between(1, 366), F.timestamp_seconds(F.unix_timestamp(start) + micros))


def harmonics(x, period: float, count: int, name: str) -> dict[str, Column]:
    out = {}
    for k in range(1, count + 1):
        angle = c(x) * (2.0 * math.pi * k / period)
        out[f"{name}_sin_{k}"], out[f"{name}_cos_{k}"] = F.sin(angle), F.cos(angle)
    return out


def log_target(x, eps: float = 1e-6) -> Column:
    return F.ln(F.greatest(c(x), F.lit(eps)))


def unlog_target(x, floor: float = 1.0) -> Column:
    return F.greatest(F.exp(c(x)), F.lit(floor))


def z_score(x, mean, std, eps: float = 0.0) -> Column:
    return (c(x) - c(mean)) / (c(std) + eps)


def un_z_score(z, mean, std, eps: float = 0.0) -> Column:
    return c(z) * (c(std) + eps) + c(mean)


def min_max(x, low, high) -> Column:
    span = c(high) - c(low)
    return (c(x) - c(low)) / F.when(span > 0, span).otherwise(1.0)


def wind_from(speed, direction_from) -> tuple[Column, Column]:
    """East and north parts of a wind given by the direction it comes from."""
    angle = F.radians(c(direction_from))
    return -c(speed) * F.sin(angle), -c(speed) * F.cos(angle)


def wind_towards(speed, direction_from) -> tuple[Column, Column]:
    """Same wind by turning the direction half a circle first."""
    angle = F.radians(F.pmod(c(direction_from) + 180.0, F.lit(360.0)))
    return c(speed) * F.sin(angle), c(speed) * F.cos(angle)


def wind_speed(u, v) -> Column:
    return F.sqrt(c(u) * c(u) + c(v) * c(v))


def along_bearing(u, v, bearing_rad) -> Column:
    return c(u) * F.sin(c(bearing_rad)) + c(v) * F.cos(c(bearing_rad))


def from_along(along, bearing_rad) -> tuple[Column, Column]:
    return c(along) * F.sin(c(bearing_rad)), c(along) * F.cos(c(bearing_rad))


def shear_exponent(v10, v100) -> Column:
    low, high = F.greatest(F.abs(c(v10)), F.lit(MIN_WIND_MPS)), F.greatest(F.abs(c(v100)), F.lit(MIN_WIND_MPS))
    return clip(F.ln(high / low) / math.log(10.0), -1.0, 1.0)


def wind_at_height(v10, alpha, height) -> Column:
    sign = F.when(c(v10) >= 0.0, 1.0).otherwise(-1.0)
    base = F.greatest(F.abs(c(v10)), F.lit(MIN_WIND_MPS))
    return sign * base * F.pow(F.greatest(c(height), F.lit(1.0)) / 10.0, c(alpha))


def standard_atmosphere(height, surface_k, surface_pa) -> tuple[Column, Column, Column]:
    """Temperature, pressure and density from 0 to 20 km."""
    exponent = ISA_G / (R_DRY_AIR * LAPSE_RATE)
    h, t0, p0 = clip(height, 0.0, ISA_TOP_M), c(surface_k), c(surface_pa)
    low = h <= TROPOPAUSE_M
    t_low = t0 - LAPSE_RATE * h
    t_top = t0 - LAPSE_RATE * TROPOPAUSE_M
    decay = F.exp((h - TROPOPAUSE_M) * (-ISA_G) / (R_DRY_AIR * STRATOSPHERE_K))
    t = F.when(low, t_low).otherwise(STRATOSPHERE_K)
    p = F.when(low, p0 * F.pow(t_low / t0, F.lit(exponent))).otherwise(p0 * F.pow(t_top / t0, F.lit(exponent)) * decay)
    return t, p, p / (t * R_DRY_AIR)


def speed_of_sound(t) -> Column:
    return F.sqrt(c(t) * (1.4 * R_DRY_AIR))


def bucket(x, width: float) -> Column:
    """Nearest multiple, ties to even."""
    return F.rint(c(x) / width).cast("bigint")


def state_key(provider, ts, lat, lon, alt) -> Column:
    """Text key that changes when hour, place or height bucket changes."""
    hour = F.date_format(F.date_trunc("hour", c(ts)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(
        F.lit("provider="), c(provider), F.lit("|time="), hour, F.lit("+00:00|lat_bucket="), bucket(lat, 0.25).cast("string"),
        F.lit("|lon_bucket="), bucket(lon, 0.25).cast("string"), F.lit("|alt_bucket="), bucket(alt, 250.0).cast("string"),
    )


def offset_lat_lon(east, north, lat, lon) -> tuple[Column, Column]:
    """Place after a small move in metres; no longitude change at a pole."""
    cos_lat = F.cos(F.radians(c(lat)))
    d_lon = F.when(F.abs(cos_lat) < 1e-12, 0.0).otherwise(
        F.degrees(c(east) / F.when(F.abs(cos_lat) < 1e-12, 1.0).otherwise(cos_lat * EARTH_RADIUS_M))
    )
    return c(lat) + F.degrees(c(north) / EARTH_RADIUS_M), c(lon) + d_lon


def short_distance(lat0, lon0, lat1, lon1) -> Column:
    """Metres between near points, equirectangular."""
    a, b = F.radians(c(lat0)), F.radians(c(lat1))
    x = F.radians(c(lon1) - c(lon0)) * F.cos((a + b) * 0.5) * EARTH_RADIUS_M
    y = (b - a) * EARTH_RADIUS_M
    return F.sqrt(x * x + y * y)


def wrap_angle(a) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(c(a) + math.pi, F.lit(2.0 * math.pi)) - math.pi


def normal_direction(bearing, elevation) -> tuple[Column, Column]:
    """Bearing in [0, 2 pi) and elevation within a quarter turn; beyond it the bearing flips."""
    e = wrap_angle(elevation)
    over, under = e > 0.5 * math.pi, e < -0.5 * math.pi
    turned = F.when(over | under, c(bearing) + math.pi).otherwise(c(bearing))
    elev = F.when(over, math.pi - e).when(under, -math.pi - e).otherwise(e)
    return F.pmod(turned, F.lit(2.0 * math.pi)), elev


def first_number(json, keys: list[str]) -> Column:
    """First of several JSON keys that holds a number."""
    return F.coalesce(*[F.get_json_object(c(json), f"$.{k}").try_cast("double") for k in keys])


def key_digest(key) -> Column:
    return F.sha2(F.trim(c(key)), 256)


def duration_text(seconds) -> Column:
    """m:ss, fractions dropped; nothing or zero gives 0:00."""
    s = F.floor(F.coalesce(c(seconds), F.lit(0.0))).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def round_half_up_2(x) -> Column:
    return F.floor(c(x) * 100.0 + 0.5) / 100.0


def hour_text(ts) -> Column:
    return F.date_format(F.date_trunc("hour", c(ts)), "yyyy-MM-dd'T'HH:mm:ss")


def surface_wind(row: dict[str, str], bearing_rad) -> dict[str, Column]:
    """Wind at 10 m and 100 m from the best given fields, with notes on what stood in.

    ``row`` names the columns e10, n10, e100, n100, east, north, along and note.
    """
    col = {k: F.col(v) for k, v in row.items()}
    own = col["e10"].isNotNull() & col["n10"].isNotNull()
    general = col["east"].isNotNull() & col["north"].isNotNull()
    high = col["e100"].isNotNull() & col["n100"].isNotNull()
    along = F.coalesce(col["along"], F.lit(0.0))
    east, north = from_along(along, bearing_rad)
    e10 = F.when(own, col["e10"]).when(general, col["east"]).otherwise(east)
    n10 = F.when(own, col["n10"]).when(general, col["north"]).otherwise(north)
    notes = F.concat_ws(
        " | ",
        F.when(~own & general, F.lit("10m wind from general wind")),
        F.when(~own & ~general, F.lit("10m wind from along-track wind")),
        F.when(~high, F.lit("100m wind missing, 10m reused")),
        col["note"],
    )
    return {
        "east_10": e10, "north_10": n10, "east_100": F.when(high, col["e100"]).otherwise(e10),
        "north_100": F.when(high, col["n100"]).otherwise(n10), "notes": notes,
    }
