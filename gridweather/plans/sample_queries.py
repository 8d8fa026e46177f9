"""Samples and splits over the observation, event and grid views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweather.operators.attach import attach
from gridweather.functions.hashing import u01 as unit
from gridweather.operators import lookup as lk, sampling as sm
from gridweather.plans.registry import h, query, r, rounded, u01
from gridweather.sources import views as v

DAY = "cast(valid_time as date)"


def draw_sql(seed: str, axis: str, ident: str, n: str) -> str:
    return f"cast({h(f'concat({seed}, {chr(39)}{axis}{chr(39)})', ident)} % {n} as int)"


@query("smp1_uniform_draws", f"""with dr as (select obs_id as draw, {draw_sql("'7'", "t", "obs_id", "3")} as time_i, {draw_sql("'7'", "l", "obs_id", "7")} + 1 as level_i, {draw_sql("'7'", "y", "obs_id", "5")} as lat_i, {draw_sql("'7'", "x", "obs_id", "5")} as lon_i from v_obs)
    select draw, time_i, level_i, lat_i, lon_i, {r("t_k")} as t_k from dr join v_grid using (time_i, level_i, lat_i, lon_i)""")
def uniform_draws(spark, d):
    g = v.grid(spark, d)
    axes = lk.grid_axes(g)
    i = F.col("obs_id")
    draws = v.obs(spark, d).select(
        i.alias("draw"), sm.axis_draw(7, "t", i, len(axes.time.values)).alias("time_i"), (sm.axis_draw(7, "l", i, len(v.PRESSURE_LEVELS_HPA)) + 1).alias("level_i"),
        sm.axis_draw(7, "y", i, len(axes.lat.values)).alias("lat_i"), sm.axis_draw(7, "x", i, len(axes.lon.values)).alias("lon_i"))
    cell = ["time_i", "level_i", "lat_i", "lon_i"]
    return draws.join(g, cell).select("draw", *cell, rounded("t_k").alias("t_k"))


BUDGET = """sl as (select distinct time_i, level_i from v_grid), n as (select count(*) as n, (select count(distinct time_i) from v_grid) as nt from v_obs),
  ex as (select time_i, level_i, n, n*((1e0/nt)*(cast(8-level_i as double)/sum(cast(8-level_i as double)) over (partition by time_i))) as x from sl, n),
  rk as (select *, floor(x) as f, row_number() over (order by x-floor(x) desc, time_i, level_i) as k, n - sum(floor(x)) over () as rem from ex),
  bu as (select time_i, level_i, cast(f + case when k <= rem then 1 else 0 end as bigint) as budget from rk)"""


def budgets(spark, d):
    g, o = v.grid(spark, d), v.obs(spark, d)
    slices = g.select("time_i", "level_i").distinct().withColumn("weight", (8 - F.col("level_i")).cast("double"))
    size = attach(o.agg(F.count(F.lit(1)).alias("n")), g.agg(F.count_distinct("time_i").alias("nt")))
    staged = attach(slices, size)
    return sm.level_budget(staged, [], F.col("n"), F.col("nt"), "weight").select("time_i", "level_i", "budget")


@query("smp3_level_budget", f"with {BUDGET} select * from bu")
def level_budget(spark, d):
    return budgets(spark, d)


@query("smp3_even_budget", """with sl as (select distinct time_i, level_i from v_grid), n as (select count(*) as n from v_obs), k as (select *, row_number() over (order by time_i, level_i) as i, count(*) over () as m from sl, n)
    select time_i, level_i, n // m + case when i <= n % m then 1 else 0 end as budget from k""")
def even_budget(spark, d):
    slices = v.grid(spark, d).select("time_i", "level_i").distinct()
    size = v.obs(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return sm.even_budget(attach(slices, size), [], F.col("n"), ["time_i", "level_i"]).select("time_i", "level_i", "budget")


CUM = """la as (select lat_i, greatest(cos(radians(max(lat))), 1e-6) as w from v_grid group by lat_i), lc as (select list(c order by lat_i) as cum from (select lat_i, sum(w/tot) over (order by lat_i) as c from la, (select sum(w) as tot from la)))"""


@query("smp2_stratified_draws", f"""with {BUDGET}, {CUM}, dr as (select time_i, level_i, unnest(range(0, budget)) as draw from bu), id as (select *, concat(time_i, '-', level_i, '-', draw) as i from dr),
    pk as (select time_i, level_i, draw, least(len(list_filter(cum, lambda c: c <= {u01("'42y'", "i")})), 4) as lat_i, {draw_sql("'42'", "x", "i", "5")} as lon_i from id, lc)
    select time_i, level_i, draw, lat_i, lon_i, {r("t_k")} as t_k from pk join v_grid using (time_i, level_i, lat_i, lon_i)""")
def stratified_draws(spark, d):
    g = v.grid(spark, d)
    axes = lk.grid_axes(g)
    draws = sm.budget_draws(budgets(spark, d), ["time_i", "level_i"]).withColumn("i", F.concat_ws("-", "time_i", "level_i", "draw"))
    running = sm.area_weights(axes.lat.values)
    draws = draws.withColumns({"lat_i": sm.weighted_index(unit("42y", F.col("i")), running), "lon_i": sm.axis_draw(42, "x", F.col("i"), len(axes.lon.values))})
    cell = ["time_i", "level_i", "lat_i", "lon_i"]
    return draws.join(g, cell).select("time_i", "level_i", "draw", "lat_i", "lon_i", rounded("t_k").alias("t_k"))


@query("smp4_area_weighted_rows", f"with {CUM} select obs_id, least(len(list_filter(cum, lambda c: c <= {u01(chr(39) + '5' + chr(39), 'obs_id')})), 4) as lat_i from v_obs, lc")
def area_weighted_rows(spark, d):
    lat = lk.grid_axes(v.grid(spark, d)).lat
    return v.obs(spark, d).select("obs_id", sm.weighted_index(unit(5, "obs_id"), sm.area_weights(lat.values)).alias("lat_i"))


DAY_SEED = "(42 + extract(year from valid_time)*10000 + extract(month from valid_time)*100 + extract(day from valid_time))"


@query("smp5_day_seed", f"select obs_id, {DAY_SEED} as seed, {r(u01(DAY_SEED, 'obs_id'))} as u from v_obs")
def day_seed(spark, d):
    seed = sm.day_seed(42, F.col("valid_time"))
    return v.obs(spark, d).select("obs_id", seed.alias("seed"), rounded(unit(seed, "obs_id")).alias("u"))


@query("smp6_ratio_split", f"""with k as (select obs_id, row_number() over (partition by {DAY} order by {h(DAY_SEED, "obs_id")}, obs_id) as rn, count(*) over (partition by {DAY}) as n from v_obs)
    select obs_id, case when rn <= floor(n*0.85e0) then 'train' when rn <= floor(n*0.85e0) + floor(n*0.1e0) then 'val' else 'test' end as split from k""")
def ratio_split(spark, d):
    o = v.obs(spark, d).withColumn("day", F.to_date("valid_time"))
    return sm.ratio_split(o, "day", "obs_id", sm.day_seed(42, F.col("valid_time")), 0.85, 0.10).select("obs_id", "split")


@query("smp7_day_split", "select obs_id, case when extract(day from valid_time) <= 23 then 'train' when extract(day from valid_time) <= 27 then 'val' else 'test' end as split from v_obs")
def day_split(spark, d):
    return v.obs(spark, d).select("obs_id", sm.day_split(F.dayofmonth("valid_time")).alias("split"))


@query("smp8_subset", f"select obs_id from v_obs order by {h(chr(39) + '9' + chr(39), 'obs_id')}, obs_id limit 500")
def subset(spark, d):
    return sm.subset(v.obs(spark, d), "obs_id", 500, 9).select("obs_id")


@query("smp9_day_cap", """with c as (select cast(ts as date) as day, count(*) as n from events group by 1), k as (select day, n, coalesce(sum(n) over (order by day rows between unbounded preceding and 1 preceding), 0) as before from c),
    cap as (select count(*) // 3 as cap from events) select event_id, strftime(cast(ts as date), '%Y-%m-%d') as day from events where cast(ts as date) in (select day from k, cap where before < cap)""")
def day_cap(spark, d):
    e = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = sm.days_until_cap(e, "day", e.count() // 3)
    return e.join(days, "day", "left_semi").select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _lhs_sql(dim: str) -> str:
    return f"(row_number() over (order by {h(chr(39) + '3-' + dim + chr(39), 'obs_id')}, obs_id) - 1 + {u01(chr(39) + '3+' + dim + chr(39), 'obs_id')})/count(*) over ()"


LHS = f"lh as (select obs_id, {_lhs_sql('place')} as place, {_lhs_sql('height')} as height, {_lhs_sql('day')} as day from v_obs)"


def design(spark, d):
    return sm.latin_hypercube(v.obs(spark, d), "obs_id", ["place", "height", "day"], 3)


@query("smp10_latin_hypercube", f"with {LHS} select obs_id, {r('place', 9)} as place, {r('height', 9)} as height, {r('day', 9)} as day from lh")
def latin_hypercube(spark, d):
    return design(spark, d).select("obs_id", *[rounded(n, 9).alias(n) for n in ("place", "height", "day")])


@query("smp11_scale_to_bounds", f"""with {LHS}, b as (select min(lat) as a, max(lat) as z from v_obs) select obs_id, {r("a + place*(z-a)")} as lat, {r("0e0 + height*32e3", 4)} as altitude_m, [1,2,3,5,8,13,21][least(cast(floor(day*7) as int), 6)+1] as day from lh, b""")
def scale_to_bounds(spark, d):
    b = v.obs(spark, d).agg(F.min("lat").alias("a"), F.max("lat").alias("z"))
    x = attach(design(spark, d), b)
    return x.select("obs_id", rounded(sm.scale(F.col("place"), F.col("a"), F.col("z"))).alias("lat"), rounded(sm.scale(F.col("height"), 0.0, 32000.0), 4).alias("altitude_m"), sm.pick_from(F.col("day"), [1, 2, 3, 5, 8, 13, 21]).alias("day"))


@query("smp12_class_plan", f"""with n as (select count(*) as n from v_obs), cl as (select * from (values (0, 'calm', 0.25e0), (1, 'breeze', 0.3125e0), (2, 'storm', 0.4375e0)) t(pos, class, w)), ex as (select pos, class, n, n*w as x from cl, n),
    rk as (select *, floor(x) as f, row_number() over (order by x-floor(x) desc, pos desc) as k, n - sum(floor(x)) over () as rem from ex), bu as (select class, sum(cast(f + case when k <= rem then 1 else 0 end as bigint)) over (order by pos) as upto, cast(f + case when k <= rem then 1 else 0 end as bigint) as c from rk),
    o as (select obs_id, row_number() over (order by {h(chr(39) + '21' + chr(39), 'obs_id')}, obs_id) as rn from v_obs) select obs_id, class from o join bu on rn <= upto and rn > upto - c""")
def class_plan(spark, d):
    return sm.class_plan(v.obs(spark, d), "obs_id", {"calm": 4.0, "breeze": 5.0, "storm": 7.0}, 21).select("obs_id", "class")


@query("smp13_mixture_draw", f"""with u as (select obs_id, {u01("'31'", "obs_id")} as p, {u01("'32'", "obs_id")} as u from v_obs)
    select obs_id, {r("case when p < 0.5e0 then u*3e3 when p < 0.8e0 then 3e3 + u*5e3 when p < 0.95e0 then 8e3 + u*8e3 else 16e3 + u*14e3 end", 5)} as altitude_m from u""")
def mixture_draw(spark, d):
    return v.obs(spark, d).select("obs_id", rounded(sm.mixture_altitude(unit(31, "obs_id"), unit(32, "obs_id")), 5).alias("altitude_m"))
