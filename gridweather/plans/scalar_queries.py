"""Scalar functions over the observation, grid, track and run views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridweather.operators.attach import attach
from gridweather.functions import features as ft, scalars as s
from gridweather.operators.stats import month_coverage
from gridweather.plans.registry import query, r, rounded
from gridweather.sources import views as v

PI2 = repr(2.0 * math.pi)
PI = repr(math.pi)
LON180 = "(case when lon > 180e0 then lon - 360e0 else lon end)"
HOUR = "(extract(hour from valid_time) + extract(minute from valid_time)/6e1 + floor(extract(second from valid_time))/36e2)"


def solar(hour: str, lon: str = LON180) -> str:
    x = f"({hour} + {lon}/15e0)"
    return f"((({x}) % 24e0) + 24e0) % 24e0"


def rows(df, *cols, digits=6, **named):
    """Select the plain columns and the named ones, doubles rounded for comparison."""
    return df.select(*cols, *[rounded(col, digits).alias(name) for name, col in named.items()])


@query("scl1_longitude_fold", f"""select obs_id, {r(LON180)} as lon_180,
    {r(f"(case when {LON180} < 0 then {LON180} + 360e0 else {LON180} end)")} as lon_360 from v_obs""")
def longitude_fold(spark, d):
    return rows(v.obs(spark, d), "obs_id", lon_180=s.fold_lon_180("lon"), lon_360=s.fold_lon_360(s.fold_lon_180("lon")))


@query("scl2_geopotential_altitude", f"""select time_i, level_i, lat_i, lon_i,
    {r("greatest(0e0, least(32e3, z_m2s2/9.80665e0))")} as altitude_m from v_grid""")
def geopotential_altitude(spark, d):
    return rows(v.grid(spark, d), "time_i", "level_i", "lat_i", "lon_i", altitude_m=s.altitude_from_geopotential("z_m2s2"))


@query("scl3_unit_conversions", f"""select time_i, level_i, lat_i, lon_i, level_hpa*1e2 as pressure_pa,
    {r("(t_k - 273.15e0) + 273.15e0")} as temperature_k from v_grid""")
def unit_conversions(spark, d):
    g = v.grid(spark, d)
    return rows(
        g, "time_i", "level_i", "lat_i", "lon_i",
        pressure_pa=s.hpa_to_pa("level_hpa"), temperature_k=s.celsius_to_kelvin(F.col("t_k") - 273.15),
    )


@query("scl4_solar_hour", f"select obs_id, {r(solar(HOUR))} as local_solar_hour from v_obs")
def local_solar_hour(spark, d):
    return rows(v.obs(spark, d), "obs_id", local_solar_hour=s.solar_hour(s.utc_hour("valid_time"), "lon"))


@query("scl5_time_parts", f"""with a as (select obs_id, case when obs_id % 50 = 0 then timestamp '2024-06-01 06:30:00'
      else valid_time end as valid_time from v_obs)
    select obs_id, extract(doy from valid_time) as day_of_year, {r(HOUR)} as utc_hour, extract(year from valid_time) as "year" from a""")
def time_parts(spark, d):
    o = v.obs(spark, d).withColumn("given", F.when(F.col("obs_id") % 50 != 0, F.col("valid_time")))
    now = F.lit("2024-06-01 06:30:00").cast("timestamp_ntz")
    p = s.time_parts("given", now)
    return o.select("obs_id", p["day_of_year"].alias("day_of_year"), rounded(p["utc_hour"]).alias("utc_hour"), p["year"].alias("year"))


@query("scl6_time_from_day", """select obs_id, case when obs_id % 370 between 1 and 366 then
    strftime(timestamp '2024-01-01' + to_seconds((obs_id % 370 - 1) * 86400 + (obs_id % 24) * 3600 + 1800), '%Y-%m-%dT%H:%M:%S') end as valid_at
    from v_obs""")
def time_from_day(spark, d):
    o = v.obs(spark, d)
    at = s.time_from_day(F.lit(2024), (F.col("obs_id") % 370).cast("double") + 0.25, (F.col("obs_id") % 24).cast("double") + 0.5)
    return o.select("obs_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("valid_at"))


def _angle(k: int, x: str, period: str) -> str:
    return f"{PI2}e0*{k}*{x}/{period}"


@query("scl7_harmonics", f"""with a as (select obs_id, extract(doy from valid_time) as doy, {HOUR} as hr, extract(hour from valid_time) as hh from v_obs)
    select obs_id, {", ".join(f"{r(f'{fn}({_angle(k, x, p)})')} as {n}_{fn}_{k}"
        for n, x, p, top in (("doy", "doy", "365.25e0", 2), ("utc", "hr", "24e0", 2), ("row_day", "doy", "365e0", 1), ("row_hour", "hh", "24e0", 1))
        for k in range(1, top + 1) for fn in ("sin", "cos"))} from a""")
def harmonic_encoding(spark, d):
    o = v.obs(spark, d)
    doy = F.dayofyear("valid_time")
    named = s.harmonics(doy, s.YEAR_DAYS, 2, "doy") | s.harmonics(s.utc_hour("valid_time"), 24.0, 2, "utc")
    named |= s.harmonics(doy, s.ROW_YEAR_DAYS, 1, "row_day") | s.harmonics(F.hour("valid_time"), 24.0, 1, "row_hour")
    return rows(o, "obs_id", **named)


@query("scl8_cyclic_encoding", f"""select obs_id, {r("lat")} as lat, {r("lon")} as lon, {r("altitude_m")} as altitude_m,
    {r(f"sin({_angle(1, 'extract(doy from valid_time)', '365.25e0')})")} as day_of_year_sin,
    {r(f"cos({_angle(1, 'extract(doy from valid_time)', '365.25e0')})")} as day_of_year_cos,
    {r(f"sin({_angle(1, HOUR, '24e0')})")} as utc_hour_sin, {r(f"cos({_angle(1, HOUR, '24e0')})")} as utc_hour_cos from v_obs""")
def cyclic_encoding(spark, d):
    named = ft.cyclic_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), s.utc_hour("valid_time"))
    return rows(v.obs(spark, d), "obs_id", **named)


_BASE = f"""with a as (select obs_id, lat, lon as lon_raw, {LON180} as lon, greatest(altitude_m, 0e0)/1e3 as km,
      cast(extract(doy from valid_time) as double) as doy, {HOUR} as hr, {solar(HOUR)} as sh from v_obs)"""


def _cycle_sql() -> list[str]:
    return [
        f"{r(f'{fn}({_angle(k, x, p)})', 9)} as {n}_{fn}_{k}"
        for n, x, p in (("doy", "doy", "365.25e0"), ("utc", "hr", "24e0"), ("solar", "sh", "24e0"))
        for k in (1, 2) for fn in ("sin", "cos")
    ]


def _trig_sql(lon: str) -> dict[str, str]:
    return {"sin_lat": "sin(radians(lat))", "cos_lat": "cos(radians(lat))", "sin_lon": f"sin(radians({lon}))", "cos_lon": f"cos(radians({lon}))"}


def _feature_sql(lon: str, named: dict[str, str], prefix: str, polar: tuple[str, str]) -> str:
    trig = _trig_sql(lon)
    cols = dict(named) | trig
    cols |= {"sphere_x": f"{trig['cos_lat']}*{trig['cos_lon']}", "sphere_y": f"{trig['cos_lat']}*{trig['sin_lon']}", "sphere_z": trig["sin_lat"]}
    cols |= {f"{prefix}_x_{n}": f"km*{e}" for n, e in (trig | {polar[0]: polar[1]}).items()}
    return ", ".join(f"{r(e, 9)} as {n}" for n, e in cols.items())


_WEATHER_SQL = _feature_sql("lon", {
    "lat_norm": "lat/90e0", "lon_norm": "lon/180e0", "abs_lat_norm": "abs(lat)/90e0", "altitude_km": "km", "log1p_altitude_km": "ln(1e0+km)",
    "altitude_km_sq": "km*km", "altitude_km_cu": "km*km*km"}, "altitude", ("abs_lat_norm", "abs(lat)/90e0"))
_PLACE_SQL = ", ".join(f"{r(f'{fn}({k}*radians({x}))', 9)} as {x}_{fn}_{k}" for k in (1, 2) for x in ("lat", "lon") for fn in ("sin", "cos"))


WEATHER_FEATURES_SQL = f"""{_BASE} select obs_id, {_WEATHER_SQL}, {r("(doy-1)/365.25e0", 9)} as day_of_year_norm, {r("hr/24e0", 9)} as utc_hour_norm,
    {r("sh/24e0", 9)} as local_solar_hour_norm, {", ".join(_cycle_sql())}, {_PLACE_SQL} from a"""


@query("scl9_weather_features", WEATHER_FEATURES_SQL)
def weather_feature_vector(spark, d):
    named = ft.weather_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), s.utc_hour("valid_time"))
    return rows(v.obs(spark, d), "obs_id", digits=9, **named)


_TREE_SQL = _feature_sql("lon_raw", {
    "lat_deg": "lat", "lon_deg": "lon_raw", "abs_lat_deg": "abs(lat)", "alt_km": "km", "log1p_alt_km": "ln(1e0+km)",
    "alt_km_sq": "km*km", "alt_km_cu": "km*km*km"}, "alt", ("abs_lat", "abs(lat)/90e0"))


@query("scl10_tree_features", f"{_BASE} select obs_id, {_TREE_SQL}, {', '.join(_cycle_sql())} from a")
def tree_feature_vector(spark, d):
    hour = s.utc_hour("valid_time")
    named = ft.tree_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), hour, s.solar_hour(hour, "lon"))
    return rows(v.obs(spark, d), "obs_id", digits=9, **named)


@query("scl11_annual_harmonics", """with m as (select event_type as feed, count(distinct extract(month from ts)) as n, max(extract(month from ts)) - min(extract(month from ts)) as span
      from events group by event_type)
    select feed, n as months, case when n <= 1 or (n <= 2 and span <= 1) then 0 else 2 end as harmonics from m""")
def annual_harmonics(spark, d):
    e = v.table(spark, d, "events").withColumnRenamed("event_type", "feed")
    return month_coverage(e, ["feed"], F.month("ts"))


@query("scl12_target_transform", f"""select time_i, level_i, lat_i, lon_i, {r("ln(greatest(level_hpa*1e2, 1e-6))")} as log_pressure,
    {r("greatest(exp(ln(greatest(level_hpa*1e2, 1e-6))), 1e0)")} as pressure_back from v_grid""")
def target_transform(spark, d):
    log_p = s.log_target(s.hpa_to_pa("level_hpa"))
    return rows(v.grid(spark, d), "time_i", "level_i", "lat_i", "lon_i", log_pressure=log_p, pressure_back=s.unlog_target(log_p))


@query("scl13_z_score", f"""with st as (select avg(altitude_m) as m, stddev_samp(altitude_m) as s0 from v_obs)
    select obs_id, {r("(altitude_m - m)/s0")} as z, {r("(altitude_m - m)/(s0+1e-8)")} as z_eps, {r("((altitude_m - m)/s0)*s0 + m")} as back
    from v_obs, st""")
def z_scores(spark, d):
    o = v.obs(spark, d)
    one = o.agg(F.avg("altitude_m").alias("m"), F.stddev_samp("altitude_m").alias("sd"))
    z = s.z_score("altitude_m", "m", "sd")
    return rows(attach(o, one), "obs_id", z=z, z_eps=s.z_score("altitude_m", "m", "sd", 1e-8), back=s.un_z_score(z, "m", "sd"))


@query("scl14_min_max", f"""with b as (select min(altitude_m) as lo, max(altitude_m) as hi from v_obs)
    select obs_id, {r("(altitude_m - lo)/(case when hi > lo then hi - lo else 1e0 end)")} as scaled from v_obs, b""")
def min_max_scale(spark, d):
    o = v.obs(spark, d)
    one = o.agg(F.min("altitude_m").alias("lo"), F.max("altitude_m").alias("hi"))
    return rows(attach(o, one), "obs_id", scaled=s.min_max("altitude_m", "lo", "hi"))


@query("scl15_wind_components", f"""select obs_id, {r("-wind_speed_mps*sin(radians(wind_dir_deg))")} as east, {r("-wind_speed_mps*cos(radians(wind_dir_deg))")} as north,
    {r("wind_speed_mps*sin(radians((wind_dir_deg+180e0)%360e0))")} as east_2, {r("wind_speed_mps*cos(radians((wind_dir_deg+180e0)%360e0))")} as north_2 from v_obs""")
def wind_components(spark, d):
    (e, n), (e2, n2) = s.wind_from("wind_speed_mps", "wind_dir_deg"), s.wind_towards("wind_speed_mps", "wind_dir_deg")
    return rows(v.obs(spark, d), "obs_id", east=e, north=n, east_2=e2, north_2=n2)


@query("scl16_wind_speed", f"select row_id, {r('sqrt(u_true*u_true+v_true*v_true)')} as true_speed, {r('sqrt(u_pred*u_pred+v_pred*v_pred)')} as pred_speed from v_uv")
def speeds(spark, d):
    return rows(v.uv(spark, d), "row_id", true_speed=s.wind_speed("u_true", "v_true"), pred_speed=s.wind_speed("u_pred", "v_pred"))


_EN = "with a as (select *, radians(cast(obs_id % 360 as double)) as b, -wind_speed_mps*sin(radians(wind_dir_deg)) as e, -wind_speed_mps*cos(radians(wind_dir_deg)) as n from v_obs)"


@query("scl17_bearing_projection", f"""{_EN} select obs_id, {r("e*sin(b)+n*cos(b)")} as along, {r("(e*sin(b)+n*cos(b))*sin(b)")} as east_back,
    {r("(e*sin(b)+n*cos(b))*cos(b)")} as north_back from a""")
def bearing_projection(spark, d):
    e, n = s.wind_from("wind_speed_mps", "wind_dir_deg")
    o = v.obs(spark, d).select("obs_id", e.alias("e"), n.alias("n"), F.radians((F.col("obs_id") % 360).cast("double")).alias("b"))
    along = s.along_bearing("e", "n", "b")
    east, north = s.from_along(along, "b")
    return rows(o, "obs_id", along=along, east_back=east, north_back=north)


_ALPHA = "greatest(-1e0, least(1e0, ln(greatest(abs(v100),1e-1)/greatest(abs(v10),1e-1))/ln(10e0)))"
_V = "with a as (select *, wind_speed_mps as v10, cast((obs_id*7) % 500 as double)/1e1 as v100 from v_obs)"


def _two_heights(spark, d):
    return v.obs(spark, d).withColumns({"v10": F.col("wind_speed_mps"), "v100": ((F.col("obs_id") * 7) % 500).cast("double") / 10.0})


@query("scl18_shear_exponent", f"{_V} select obs_id, {r(_ALPHA)} as alpha from a")
def shear(spark, d):
    return rows(_two_heights(spark, d), "obs_id", alpha=s.shear_exponent("v10", "v100"))


@query("scl19_wind_at_height", f"""{_V} select obs_id, {r(f"(case when v10-20 >= 0 then 1e0 else -1e0 end)*greatest(abs(v10-20),1e-1)*pow(greatest(altitude_m/1e2,1e0)/1e1, {_ALPHA.replace('abs(v10)', 'abs(v10-20)')})", 5)} as wind_mps from a""")
def wind_profile(spark, d):
    o = _two_heights(spark, d).withColumn("v10", F.col("v10") - 20.0)
    wind = s.wind_at_height("v10", s.shear_exponent("v10", "v100"), F.col("altitude_m") / 100.0)
    return o.select("obs_id", rounded(wind, 5).alias("wind_mps"))


_ISA_N = repr(s.ISA_G / (s.R_DRY_AIR * s.LAPSE_RATE))


@query("scl20_standard_atmosphere", f"""with a as (select obs_id, least(2e4, greatest(0e0, altitude_m)) as hh, 280e0 + obs_id % 20 as t0, 1e5 + obs_id % 2000 as p0 from v_obs),
    b as (select *, case when hh <= 11e3 then t0 - 0.0065e0*hh else 216.65e0 end as t,
      case when hh <= 11e3 then p0*pow((t0-0.0065e0*hh)/t0, {_ISA_N}e0) else p0*pow((t0-0.0065e0*11e3)/t0, {_ISA_N}e0)*exp(-9.81e0*(hh-11e3)/(287.05e0*216.65e0)) end as p from a)
    select obs_id, {r("t")} as temperature_k, {r("p", 4)} as pressure_pa, {r("p/(287.05e0*t)")} as density from b""")
def atmosphere(spark, d):
    i = F.col("obs_id")
    t, p, rho = s.standard_atmosphere("altitude_m", (i % 20) + 280.0, (i % 2000) + 100000.0)
    return v.obs(spark, d).select("obs_id", rounded(t).alias("temperature_k"), rounded(p, 4).alias("pressure_pa"), rounded(rho).alias("density"))


@query("scl21_speed_of_sound", f"select time_i, level_i, lat_i, lon_i, {r('sqrt(1.4e0*287.05e0*t_k)')} as sound_mps from v_grid")
def sound(spark, d):
    return rows(v.grid(spark, d), "time_i", "level_i", "lat_i", "lon_i", sound_mps=s.speed_of_sound("t_k"))


STATE_KEY_SQL = """concat('provider=', 'grid', '|time=', strftime(date_trunc('hour', valid_time), '%Y-%m-%dT%H:%M:%S'), '+00:00|lat_bucket=', cast(cast(round_even(lat/0.25e0, 0) as bigint) as varchar),
    '|lon_bucket=', cast(cast(round_even(lon/0.25e0, 0) as bigint) as varchar), '|alt_bucket=', cast(cast(round_even(altitude_m/250e0, 0) as bigint) as varchar))"""


@query("scl22_state_key", f"select obs_id, {STATE_KEY_SQL} as state_key from v_obs")
def state_keys(spark, d):
    return v.obs(spark, d).select("obs_id", s.state_key(F.lit("grid"), "valid_time", "lat", "lon", "altitude_m").alias("state_key"))


@query("scl23_metres_to_degrees", f"""with a as (select track_id, seq, case when seq % 5 = 0 then 90e0 else cast(track_id % 160 as double) - 80e0 end as lat0, cast(track_id % 360 as double) as lon0, x_m, z_m from v_track)
    select track_id, seq, {r("lat0 + degrees(z_m/6371000e0)")} as lat,
      {r("lon0 + case when abs(cos(radians(lat0))) < 1e-12 then 0e0 else degrees(x_m/(6371000e0*cos(radians(lat0)))) end")} as lon from a""")
def metres_to_degrees(spark, d):
    t = v.track(spark, d).withColumns({
        "lat0": F.when(F.col("seq") % 5 == 0, 90.0).otherwise((F.col("track_id") % 160).cast("double") - 80.0),
        "lon0": (F.col("track_id") % 360).cast("double")})
    lat, lon = s.offset_lat_lon("x_m", "z_m", "lat0", "lon0")
    return rows(t, "track_id", "seq", lat=lat, lon=lon)


@query("scl24_short_distance", f"""with a as (select obs_id, lat, lon, lat + 0.01e0*(obs_id % 10) as lat1, lon + 0.02e0*(obs_id % 7) as lon1 from v_obs)
    select obs_id, {r("sqrt(pow(6371000e0*radians(lon1-lon)*cos((radians(lat)+radians(lat1))*0.5e0),2) + pow(6371000e0*(radians(lat1)-radians(lat)),2))", 3)} as metres from a""")
def distance(spark, d):
    i = F.col("obs_id")
    m = s.short_distance("lat", "lon", F.col("lat") + (i % 10) * 0.01, F.col("lon") + (i % 7) * 0.02)
    return v.obs(spark, d).select("obs_id", rounded(m, 3).alias("metres"))


def _pmod(x: str, n: str) -> str:
    return f"((({x}) % {n}) + {n}) % {n}"


@query("scl25_angle_wrap", f"""with a as (select obs_id, radians(cast((obs_id*7)%1000 as double) - 500.3e0) as ang, radians(wind_dir_deg) as b from v_obs),
    e as (select *, {_pmod(f"ang + {PI}e0", f"{PI2}e0")} - {PI}e0 as w from a)
    select obs_id, {r("w")} as wrapped, {r(_pmod(f"b + case when abs(w) > {PI}e0/2 then {PI}e0 else 0e0 end", f"{PI2}e0"))} as bearing,
      {r(f"case when w > {PI}e0/2 then {PI}e0 - w when w < -{PI}e0/2 then -{PI}e0 - w else w end")} as elevation from e""")
def angles(spark, d):
    ang = F.radians(((F.col("obs_id") * 7) % 1000).cast("double") - 500.3)
    b, e = s.normal_direction(F.radians("wind_dir_deg"), ang)
    return rows(v.obs(spark, d), "obs_id", wrapped=s.wrap_angle(ang), bearing=b, elevation=e)


@query("scl26_first_alias", """with a as (select event_id, case event_id % 4 when 0 then replace(props, '"k"', '"temperature_K"') when 1 then replace(props, '"k"', '"temperature"')
      when 2 then replace(props, '"k"', '"t"') else props end as js from events)
    select event_id, coalesce(try_cast(json_extract_string(js, '$.temperature_K') as double), try_cast(json_extract_string(js, '$.temperature') as double), try_cast(json_extract_string(js, '$.t') as double)) as temperature,
      coalesce(json_extract_string(js, '$.temperature_K'), json_extract_string(js, '$.temperature'), json_extract_string(js, '$.t')) is null as rejected from a""")
def first_alias(spark, d):
    e, i = v.table(spark, d, "events"), F.col("event_id") % 4
    js = F.col("props")
    for n, name in enumerate(("temperature_K", "temperature", "t")):
        js = F.when(i == n, F.replace(F.col("props"), F.lit('"k"'), F.lit(f'"{name}"'))).otherwise(js)
    value = s.first_number(js, ["temperature_K", "temperature", "t"])
    return e.select("event_id", value.alias("temperature"), value.isNull().alias("rejected"))


@query("scl27_key_digest", "select obs_id, sha256(trim('  key-' || obs_id || ' ')) as digest from v_obs")
def digest(spark, d):
    return v.obs(spark, d).select("obs_id", s.key_digest(F.concat(F.lit("  key-"), F.col("obs_id"), F.lit(" "))).alias("digest"))


@query("scl28_duration_text", """with a as (select run_id, cast(floor(case when run_id % 100 = 0 then 0e0 else duration_s/100 end) as bigint) as sec from v_runs)
    select run_id, cast(sec // 60 as varchar) || ':' || lpad(cast(sec % 60 as varchar), 2, '0') as duration from a""")
def durations(spark, d):
    sec = F.when(F.col("run_id") % 100 != 0, F.col("duration_s") / 100.0)
    return v.runs(spark, d).select("run_id", s.duration_text(sec).alias("duration"))


@query("scl29_round_half_up", f"select run_id, {r('floor(duration_s/7e0*1e2+0.5e0)/1e2')} as rounded from v_runs")
def half_up(spark, d):
    return rows(v.runs(spark, d), "run_id", rounded=s.round_half_up_2(F.col("duration_s") / 7.0))


_SEED = """with a as (select obs_id, radians(wind_dir_deg) as b, case when obs_id%2=0 then wind_speed_mps end as e10, case when obs_id%2=0 then 1e0 end as n10,
      case when obs_id%3=0 then wind_speed_mps+1 end as e100, case when obs_id%3=0 then 2e0 end as n100, case when obs_id%5=0 then 3e0 end as east,
      case when obs_id%5=0 then 4e0 end as north, case when obs_id%7=0 then 5e0 end as along, case when obs_id%11=0 then 'given' end as note from v_obs),
    t as (select *, case when e10 is not null then e10 when east is not null then east else coalesce(along,0e0)*sin(b) end as e,
      case when e10 is not null then n10 when east is not null then north else coalesce(along,0e0)*cos(b) end as n from a)"""


@query("scl30_surface_wind", f"""{_SEED} select obs_id, {r("e")} as east_10, {r("n")} as north_10, {r("coalesce(e100, e)")} as east_100, {r("coalesce(n100, n)")} as north_100,
      concat_ws(' | ', case when e10 is null and east is not null then '10m wind from general wind' when e10 is null then '10m wind from along-track wind' end,
        case when e100 is null then '100m wind missing, 10m reused' end, note) as notes from t""")
def seed_wind(spark, d):
    i, w = F.col("obs_id"), F.col("wind_speed_mps")
    o = v.obs(spark, d).withColumns({
        "e10": F.when(i % 2 == 0, w), "n10": F.when(i % 2 == 0, 1.0), "e100": F.when(i % 3 == 0, w + 1), "n100": F.when(i % 3 == 0, 2.0),
        "east": F.when(i % 5 == 0, 3.0), "north": F.when(i % 5 == 0, 4.0), "along": F.when(i % 7 == 0, 5.0), "note": F.when(i % 11 == 0, F.lit("given"))})
    out = s.surface_wind({k: k for k in ("e10", "n10", "e100", "n100", "east", "north", "along", "note")}, F.radians("wind_dir_deg"))
    notes = out.pop("notes")
    return rows(o, "obs_id", notes.alias("notes"), **out)


@query("scl31_hour_text", "select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') as hour_key from events")
def hours(spark, d):
    return v.table(spark, d, "events").select("event_id", s.hour_text("ts").alias("hour_key"))
