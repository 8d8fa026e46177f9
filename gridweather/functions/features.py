"""Feature vectors: named columns in a fixed order, all plain column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gridweather.functions.scalars import YEAR_DAYS, c, fold_lon_180, harmonics, solar_hour


@dataclass(frozen=True)
class FeaturePlan:
    annual: int = 2
    utc: int = 2
    solar: int = 2
    place: int = 2
    sphere: bool = True
    altitude_powers: bool = True
    altitude_by_direction: bool = True


def annual_harmonics_for(months: list[int]) -> int:
    """Two annual harmonics, none where the months cover too little of the year to tell them from a constant."""
    seen = sorted(set(months))
    if len(seen) <= 1 or (len(seen) == 2 and seen[1] - seen[0] <= 1):
        return 0
    return 2


def weather_features(
    lat, lon, altitude_m, day_of_year, hour, local_hour=None, plan: FeaturePlan = FeaturePlan()
) -> dict[str, Column]:
    """The normalised feature columns, 42 with the default plan."""
    lat, lon, hour = c(lat), fold_lon_180(lon), c(hour)
    local = c(local_hour) if local_hour is not None else solar_hour(hour, lon)
    phi, lam = F.radians(lat), F.radians(lon)
    km = F.greatest(c(altitude_m), F.lit(0.0)) / 1000.0
    polar = F.abs(lat) / 90.0
    out: dict[str, Column] = {
        "lat_norm": lat / 90.0,
        "lon_norm": lon / 180.0,
        "abs_lat_norm": polar,
        "altitude_km": km,
        "log1p_altitude_km": F.log1p(km),
    }
    if plan.altitude_powers:
        out |= {"altitude_km_sq": km * km, "altitude_km_cu": km * km * km}
    trig = {"sin_lat": F.sin(phi), "cos_lat": F.cos(phi), "sin_lon": F.sin(lam), "cos_lon": F.cos(lam)}
    out |= trig
    if plan.sphere:
        out |= _sphere(trig)
    if plan.altitude_by_direction:
        out |= {f"altitude_x_{name}": km * value for name, value in (trig | {"abs_lat_norm": polar}).items()}
    out |= {
        "day_of_year_norm": (c(day_of_year) - 1.0) / YEAR_DAYS,
        "utc_hour_norm": hour / 24.0,
        "local_solar_hour_norm": local / 24.0,
    }
    out |= _cycles(day_of_year, hour, local, plan)
    for k in range(1, plan.place + 1):
        for name, angle in (("lat", phi), ("lon", lam)):
            out[f"{name}_sin_{k}"], out[f"{name}_cos_{k}"] = F.sin(angle * float(k)), F.cos(angle * float(k))
    return out


def tree_features(lat, lon, altitude_m, day_of_year, hour, local_hour, plan: FeaturePlan = FeaturePlan()) -> dict[str, Column]:
    """The columns for tree models, 31 with the default plan; longitude is taken as it comes."""
    lat, lon = c(lat), c(lon)
    phi, lam = F.radians(lat), F.radians(lon)
    km = F.greatest(c(altitude_m), F.lit(0.0)) / 1000.0
    out: dict[str, Column] = {
        "lat_deg": lat, "lon_deg": lon, "abs_lat_deg": F.abs(lat), "alt_km": km, "log1p_alt_km": F.log1p(km),
    }
    if plan.altitude_powers:
        out |= {"alt_km_sq": km * km, "alt_km_cu": km * km * km}
    trig = {"sin_lat": F.sin(phi), "cos_lat": F.cos(phi), "sin_lon": F.sin(lam), "cos_lon": F.cos(lam)}
    out |= trig
    if plan.sphere:
        out |= _sphere(trig)
    if plan.altitude_by_direction:
        out |= {f"alt_x_{name}": km * value for name, value in (trig | {"abs_lat": F.abs(lat) / 90.0}).items()}
    return out | _cycles(day_of_year, hour, local_hour, plan)


def cyclic_features(lat, lon, altitude_m, day_of_year, hour) -> dict[str, Column]:
    """Seven columns for neighbour search: day and hour become points on a circle."""
    day, turn = c(day_of_year) * (2.0 * math.pi / YEAR_DAYS), c(hour) * (2.0 * math.pi / 24.0)
    return {
        "lat": c(lat), "lon": c(lon), "altitude_m": c(altitude_m), "day_of_year_sin": F.sin(day), "day_of_year_cos": F.cos(day),
        "utc_hour_sin": F.sin(turn), "utc_hour_cos": F.cos(turn),
    }


def _sphere(trig: dict[str, Column]) -> dict[str, Column]:
    return {
        "sphere_x": trig["cos_lat"] * trig["cos_lon"],
        "sphere_y": trig["cos_lat"] * trig["sin_lon"],
        "sphere_z": trig["sin_lat"],
    }


def _cycles(day_of_year, hour, local, plan: FeaturePlan) -> dict[str, Column]:
    return (
        harmonics(day_of_year, YEAR_DAYS, plan.annual, "doy")
        | harmonics(hour, 24.0, plan.utc, "utc")
        | harmonics(local, 24.0, plan.solar, "solar")
    )
