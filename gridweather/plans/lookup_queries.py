"""Grid lookups over observations and the grid view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweather.functions import scalars as s
from gridweather.operators import lookup as lk, metrics as mt
from gridweather.plans.registry import query, r, rounded
from gridweather.sources import views as v

SECONDS = "(cast(extract(hour from valid_time)*3600 + extract(minute from valid_time)*60 + floor(extract(second from valid_time)) as double))"
LON360 = "(case when lon < 0 then lon + 36e1 else lon end)"


def queries_at(spark, d):
    """Observations with their second of the day."""
    t = F.hour("valid_time") * 3600 + F.minute("valid_time") * 60 + F.second("valid_time")
    return v.obs(spark, d).withColumn("t_query", t.cast("double"))


# SQL twins: axes as lists, the nearest index, and the bracket around a value.
AXES = """ax as (select list(distinct t_sec order by t_sec) as ts, list(distinct lat order by lat desc) as las, list(distinct lon order by lon) as los from v_grid),
 q as (select *, {sec} as t_query from v_obs)""".format(sec=SECONDS)


def nearest_sql(axis: str, x: str) -> str:
    dist = f"list_transform({axis}, lambda a: abs(a - {x}))"
    return f"(list_position({dist}, list_min({dist})) - 1)"


NEAR = f"""near as (select q.*, {nearest_sql("ts", "t_query")} as time_i, {nearest_sql("las", "lat")} as lat_i, {nearest_sql("los", LON360)} as lon_i from q, ax),
 lv as (select n.obs_id, n.altitude_m, n.time_i, n.lat_i, n.lon_i, g.level_i, g.level_hpa*1e2 as p, g.z_m2s2/9.80665e0 as z, g.t_k, g.u_mps, g.v_mps
   from near n join v_grid g on n.time_i=g.time_i and n.lat_i=g.lat_i and n.lon_i=g.lon_i)"""
UP = "row(z, level_i)"


def fold_sql(src: str, pressure: str, keep: str = "") -> str:
    """Vertical fold of rows (obs_id, altitude_m, level_i, z, p, t_k, u_mps, v_mps)."""
    entry = "{'z': z, 'p': p, 't_k': t_k, 'u_mps': u_mps, 'v_mps': v_mps}"
    p = "exp(ln(greatest(lo.p,1e0)) + (ln(greatest(hi.p,1e0))-ln(greatest(lo.p,1e0)))*f)" if pressure == "log" else "lo.p + (hi.p-lo.p)*f"
    extra = f", any_value({keep}) as {keep}" if keep else ""
    more = f", {keep}" if keep else ""
    return f"""en as (select obs_id, any_value(altitude_m) as altitude_m{extra}, max_by({entry}, z*1e3 - level_i) filter (where z <= altitude_m) as below, min_by({entry}, z*1e3 + level_i) filter (where z >= altitude_m) as above,
      min_by({entry}, z*1e3 + level_i) as bot, max_by({entry}, z*1e3 - level_i) as top from {src} group by obs_id),
    lh as (select obs_id, altitude_m{more}, greatest(bot.z, least(top.z, altitude_m)) as clipped_m, coalesce(below, bot) as lo, coalesce(above, top) as hi from en),
    fr as (select *, case when hi.z > lo.z then (clipped_m - lo.z)/(hi.z - lo.z) else 0e0 end as f from lh),
    fv as (select obs_id, altitude_m{more}, clipped_m, lo.t_k + (hi.t_k-lo.t_k)*f as t_k, lo.u_mps + (hi.u_mps-lo.u_mps)*f as u_mps, lo.v_mps + (hi.v_mps-lo.v_mps)*f as v_mps, {p} as p_pa,
      case when abs(lo.z-clipped_m) <= abs(hi.z-clipped_m) then lo.z else hi.z end as near_z_m, case when abs(lo.z-clipped_m) <= abs(hi.z-clipped_m) then lo.p else hi.p end as near_p_pa from fr)"""


VALUE_SQL = f"{r('t_k')} as t_k, {r('u_mps')} as u_mps, {r('v_mps')} as v_mps, {r('p_pa', 4)} as p_pa"


def value_cols():
    return [rounded("t_k").alias("t_k"), rounded("u_mps").alias("u_mps"), rounded("v_mps").alias("v_mps"), rounded("p_pa", 4).alias("p_pa")]


def nearest_values(spark, d):
    g = v.grid(spark, d)
    return lk.at_height(lk.nearest_profiles(queries_at(spark, d), g, lk.grid_axes(g)), "altitude_m", "linear")


@query("flagship_band_temperature", f"""with {AXES}, {NEAR}, {fold_sql("lv", "linear")}, b as (select *, {mt.band_sql("altitude_m")} as band from fv)
    select band, count(*) as n, {r("avg(t_k)")} as mean_t_k from b where band is not null group by band""")
def band_temperature(spark, d):
    out = nearest_values(spark, d).withColumn("band", mt.band_of(F.col("altitude_m")))
    return out.where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("t_k")).alias("mean_t_k"))


@query("join1_nearest_column", f"""with {AXES}, {NEAR} select obs_id, level_i, time_i, lat_i, lon_i, {r("t_k")} as t_k, {r("z", 4)} as z_m from lv""")
def nearest_column(spark, d):
    g = v.grid(spark, d)
    out = lk.nearest_columns(queries_at(spark, d), g, lk.grid_axes(g)).where("reason is null")
    return out.select("obs_id", "level_i", "time_i", "lat_i", "lon_i", rounded("t_k").alias("t_k"), rounded(F.col("z_m2s2") / s.G0, 4).alias("z_m"))


def bracket_sql(prefix: str, axis: str, x: str) -> str:
    """Three columns of a bracket; ``axis`` is a list in stored order."""
    asc = f"list_sort({axis})"
    cut = f"greatest(list_min({axis}), least(list_max({axis}), {x}))"
    cnt = f"len(list_filter({axis}, lambda a: a <= {cut}))"
    n = f"len({axis})"
    lo_a, hi_a = f"(case when {cnt} >= {n} then {n}-1 else {cnt}-1 end)", f"(case when {cnt} >= {n} then {n}-1 else {cnt} end)"
    lo_v, hi_v = f"{asc}[{lo_a}+1]", f"{asc}[{hi_a}+1]"
    flip = f"({axis}[1] > {axis}[-1])"
    return f"""(case when {flip} then {n}-1-{lo_a} else {lo_a} end) as {prefix}_lo, (case when {flip} then {n}-1-{hi_a} else {hi_a} end) as {prefix}_hi,
      (case when {hi_v} = {lo_v} then 0e0 else ({cut} - {lo_v})/({hi_v} - {lo_v}) end) as {prefix}_frac"""


BRACKETS = f"br as (select q.*, {bracket_sql('t', 'ts', 't_query')}, {bracket_sql('y', 'las', 'lat')}, {bracket_sql('x', 'los', LON360)} from q, ax)"


@query("join2_bracket", f"""with {AXES}, {BRACKETS} select obs_id, t_lo, t_hi, {r("t_frac", 9)} as t_frac, y_lo, y_hi, {r("y_frac", 9)} as y_frac, x_lo, x_hi, {r("x_frac", 9)} as x_frac from br""")
def brackets(spark, d):
    axes = lk.grid_axes(v.grid(spark, d))
    q = axes.time.bracket(queries_at(spark, d), "t_query", "t")
    q = axes.lon.bracket(axes.lat.bracket(q, "lat", "y"), lk.grid_lon("lon", axes.lon), "x")
    cols = [x for k in "tyx" for x in (F.col(f"{k}.lo").alias(f"{k}_lo"), F.col(f"{k}.hi").alias(f"{k}_hi"), rounded(f"{k}.frac", 9).alias(f"{k}_frac"))]
    return q.select("obs_id", *cols)


def corners_sql(times: str) -> str:
    return f"""cn as (select obs_id, altitude_m, t_lo, t_hi, t_frac, unnest({times}) as tt, y_lo, y_hi, y_frac, x_lo, x_hi, x_frac from br),
    cy as (select *, unnest(case when y_lo = y_hi then [{{'i': y_lo, 'w': 1e0}}] else [{{'i': y_lo, 'w': 1e0-y_frac}}, {{'i': y_hi, 'w': y_frac}}] end) as yy from cn),
    cx as (select *, unnest(case when x_lo = x_hi then [{{'i': x_lo, 'w': 1e0}}] else [{{'i': x_lo, 'w': 1e0-x_frac}}, {{'i': x_hi, 'w': x_frac}}] end) as xx from cy),
    pr as (select obs_id, level_i, any_value(altitude_m) as altitude_m, any_value(t_lo) as t_lo, any_value(t_hi) as t_hi, any_value(t_frac) as t_frac, any_value(g.level_hpa)*1e2 as p,
      sum(tt.w*yy.w*xx.w*g.t_k) as t_k, sum(tt.w*yy.w*xx.w*g.u_mps) as u_mps, sum(tt.w*yy.w*xx.w*g.v_mps) as v_mps, sum(tt.w*yy.w*xx.w*g.z_m2s2)/9.80665e0 as z
      from cx join v_grid g on g.time_i = tt.i and g.lat_i = yy.i and g.lon_i = xx.i group by obs_id, level_i)"""


BOTH_TIMES = "case when t_lo = t_hi then [{'i': t_lo, 'w': 1e0}] else [{'i': t_lo, 'w': 1e0-t_frac}, {'i': t_hi, 'w': t_frac}] end"
LEVEL_SQL = f"obs_id, level_i, {r('t_k')} as t_k, {r('u_mps')} as u_mps, {r('v_mps')} as v_mps, {r('z', 4)} as z_m"


def level_values(queries, grid, axes, *keep):
    rows = lk.level_rows(lk.interpolated_profiles(queries, grid, axes), ["obs_id", *keep])
    return rows.select("obs_id", "level_i", *[rounded(n).alias(n) for n in lk.VALUES], rounded(F.col("z_m2s2") / s.G0, 4).alias("z_m"), *keep)


@query("join3_bilinear_profile", f"""with {AXES}, {BRACKETS}, {corners_sql("[{'i': t_lo, 'w': 1e0}]")} select {LEVEL_SQL} from pr""")
def bilinear(spark, d):
    g = v.grid(spark, d)
    axes = lk.grid_axes(g)
    hours = F.array(*[F.lit(t) for t in axes.time.values])
    at_hour = axes.time.bracket(queries_at(spark, d), "t_query", "_b").withColumn("t_query", F.get(hours, F.col("_b.lo"))).drop("_b")
    return level_values(at_hour, g, axes)


@query("join4_time_blend", f"""with {AXES}, {BRACKETS}, {corners_sql(BOTH_TIMES)} select {LEVEL_SQL}, t_lo as time_lo, t_hi as time_hi, {r("t_frac", 9)} as time_frac from pr""")
def time_blend(spark, d):
    g = v.grid(spark, d)
    out = level_values(queries_at(spark, d), g, lk.grid_axes(g), "time_lo", "time_hi", "time_frac")
    return out.withColumn("time_frac", rounded("time_frac", 9))


def exact_values(spark, d):
    g = v.grid(spark, d)
    return lk.exact_lookup(queries_at(spark, d).select("obs_id", "t_query", "lat", "lon", "altitude_m"), g, lk.grid_axes(g), "altitude_m")


EXACT = f"{AXES}, {BRACKETS}, {corners_sql(BOTH_TIMES)}, {fold_sql('pr', 'log')}"


@query("join5_exact_lookup", f"""with {EXACT} select obs_id, {r("clipped_m", 4)} as clipped_m, {VALUE_SQL}, {r("near_z_m", 4)} as near_z_m, {r("near_p_pa", 4)} as near_p_pa from fv""")
def exact_lookup(spark, d):
    return exact_values(spark, d).select(
        "obs_id", rounded("clipped_m", 4).alias("clipped_m"), *value_cols(), rounded("near_z_m", 4).alias("near_z_m"), rounded("near_p_pa", 4).alias("near_p_pa"))


@query("join6_column_lookup", f"with {AXES}, {NEAR}, {fold_sql('lv', 'linear')} select obs_id, {r('clipped_m', 4)} as clipped_m, {VALUE_SQL} from fv")
def column_lookup(spark, d):
    return nearest_values(spark, d).select("obs_id", rounded("clipped_m", 4).alias("clipped_m"), *value_cols())


@query("join7_profile_resample", f"""with {AXES}, {NEAR}, hs as (select unnest(range(0, 41)) as k),
    lh as (select obs_id, k, 5e2*k as altitude_m, level_i, p, z, t_k, u_mps, v_mps from lv, hs),
    l2 as (select obs_id*100 + k as obs_id, altitude_m, level_i, p, z, t_k, u_mps, v_mps from lh), {fold_sql("l2", "linear").replace("lh as", "lh2 as").replace("from lh)", "from lh2)")}
    select obs_id // 100 as obs_id, obs_id % 100 as step, altitude_m, {r("t_k")} as t_k, {r("p_pa", 4)} as p_pa, {r("u_mps")} as u_mps, {r("v_mps")} as v_mps from fv""")
def profile_resample(spark, d):
    g = v.grid(spark, d)
    heights = [500.0 * k for k in range(41)]
    out = lk.resampled_profiles(queries_at(spark, d).select("obs_id", "t_query", "lat", "lon"), g, lk.grid_axes(g), heights)
    return out.select("obs_id", "step", "altitude_m", *value_cols())


@query("join8_hour_key", f"""with rec as (select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') as hour_key, count(*) as n, avg(value) as v from events group by 1)
    select obs_id, hour_key, n as hour_count, {r("v")} as hour_mean from v_obs join rec on hour_key = strftime(date_trunc('hour', valid_time), '%Y-%m-%dT%H')""")
def hour_key_join(spark, d):
    def key(col):
        return F.date_format(F.date_trunc("hour", F.col(col)), "yyyy-MM-dd'T'HH")

    rec = v.table(spark, d, "events").groupBy(key("ts").alias("hour_key")).agg(F.count(F.lit(1)).alias("hour_count"), rounded(F.avg("value")).alias("hour_mean"))
    return v.obs(spark, d).withColumn("hour_key", key("valid_time")).join(rec, "hour_key").select("obs_id", "hour_key", "hour_count", "hour_mean")


MODE = "(case obs_id % 3 when 0 then 'exact' when 1 then 'model' else 'hybrid' end)"
KNOWN = "extract(day from valid_time) % 5 <> 0"


def answered(spark, d):
    req = queries_at(spark, d).select(
        "obs_id", "altitude_m", F.to_date("valid_time").alias("day"),
        F.when(F.col("obs_id") % 3 == 0, "exact").when(F.col("obs_id") % 3 == 1, "model").otherwise("hybrid").alias("mode"))
    days = req.where(F.dayofmonth("day") % 5 != 0).select("day")
    exact = exact_values(spark, d).select("obs_id", F.struct(*lk.VALUES, "p_pa").alias("value"))
    t, p, _ = s.standard_atmosphere("altitude_m", 288.15, 101325.0)
    model = req.select("obs_id", F.struct(t.alias("t_k"), F.lit(0.0).alias("u_mps"), F.lit(0.0).alias("v_mps"), p.alias("p_pa")).alias("value"))
    return lk.exact_or_model(req, exact, model, days, id_col="obs_id", day="day", mode="mode"), exact


_N = repr(s.ISA_G / (s.R_DRY_AIR * s.LAPSE_RATE))
_H = "least(2e4, greatest(0e0, altitude_m))"
MODEL_T = f"(case when {_H} <= 11e3 then 288.15e0 - 0.0065e0*{_H} else 216.65e0 end)"
MODEL_P = f"""(case when {_H} <= 11e3 then 101325e0*pow((288.15e0-0.0065e0*{_H})/288.15e0, {_N}e0)
  else 101325e0*pow((288.15e0-0.0065e0*11e3)/288.15e0, {_N}e0)*exp(-9.81e0*({_H}-11e3)/(287.05e0*216.65e0)) end)"""
ANSWER = f"""{EXACT}, an as (select o.obs_id, o.altitude_m, {MODE} as mode, {KNOWN} as known, fv.t_k as et, fv.p_pa as ep, fv.u_mps as eu, fv.v_mps as ev from v_obs o join (select obs_id as fid, t_k, p_pa, u_mps, v_mps from fv) fv on o.obs_id = fv.fid),
   a2 as (select *, mode = 'exact' or (mode = 'hybrid' and known) as ex from an),
   a3 as (select obs_id, case when ex and known then 'exact' when ex then 'day missing' else 'model' end as source, case when ex then (case when known then et end) else {MODEL_T} end as t_k,
     case when ex then (case when known then ep end) else {MODEL_P} end as p_pa, case when ex then (case when known then eu end) else 0e0 end as u_mps, et, ep, eu from a2)"""


@query("join9_exact_else_model", f"with {ANSWER} select obs_id, source, {r('t_k')} as t_k, {r('p_pa', 4)} as p_pa from a3")
def hybrid(spark, d):
    out, _ = answered(spark, d)
    return out.select("obs_id", "source", rounded("value.t_k").alias("t_k"), rounded("value.p_pa", 4).alias("p_pa"))


@query("join10_minus_truth", f"""with {ANSWER} select obs_id, case when obs_id % 4 <> 0 then {r("t_k - et")} end as t_delta, case when obs_id % 4 <> 0 then {r("p_pa - ep", 3)} end as p_delta,
    case when obs_id % 4 <> 0 then {r("u_mps - eu")} end as u_delta from a3""")
def minus_truth(spark, d):
    out, exact = answered(spark, d)
    truth = exact.where(F.col("obs_id") % 4 != 0).select("obs_id", F.col("value").alias("truth"))
    j = out.join(truth, "obs_id", "left")
    return j.select("obs_id", *[rounded(F.col(f"value.{n}") - F.col(f"truth.{n}"), k).alias(o) for n, o, k in (("t_k", "t_delta", 6), ("p_pa", "p_delta", 3), ("u_mps", "u_delta", 6))])


@query("join17_table_lookup", f"""with t as (select 4 - lat_i as a_i, lon_i as b_i, time_i, level_i, t_k, u_mps from v_grid),
    q as (select obs_id, greatest(-9e1, least(9e1, lat)) as x, greatest(0e0, least(288e0, lon)) as y from v_obs),
    k as (select *, least(cast(floor((x+9e1)/4.5e1) as int), 3) as i, least(cast(floor(y/7.2e1) as int), 3) as j from q),
    f as (select *, (x - (-9e1+4.5e1*i))/4.5e1 as fx, (y - 7.2e1*j)/7.2e1 as fy from k)
    select obs_id, time_i, level_i, {r("sum((case when a_i = i then 1-fx else fx end)*(case when b_i = j then 1-fy else fy end)*t_k)")} as t_k,
      {r("sum((case when a_i = i then 1-fx else fx end)*(case when b_i = j then 1-fy else fy end)*u_mps)")} as u_mps
    from f join t on a_i in (i, i+1) and b_i in (j, j+1) group by obs_id, time_i, level_i""")
def two_axis_table(spark, d):
    t = v.grid(spark, d).select("time_i", "level_i", (4 - F.col("lat_i")).alias("a_i"), F.col("lon_i").alias("b_i"), "lat", "lon", "t_k", "u_mps")
    a, b = lk.read_axis(t, "a_i", "lat"), lk.read_axis(t, "b_i", "lon")
    out = lk.table_lookup(v.obs(spark, d), t, a, b, "lat", "lon", ["t_k", "u_mps"], "obs_id", planes=["time_i", "level_i"])
    return out.select("obs_id", "time_i", "level_i", rounded("t_k").alias("t_k"), rounded("u_mps").alias("u_mps"))
