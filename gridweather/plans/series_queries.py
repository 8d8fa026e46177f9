"""Ordered series over the track, prediction, observation and log views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridweather.operators.attach import attach
from gridweather.functions import scalars as s
from gridweather.operators import series
from gridweather.operators.ordered import ordered_scan
from gridweather.plans.metric_queries import overfit_sql, tidy
from gridweather.plans.registry import query, r, rounded
from gridweather.sources import views as v


@query("win1_running_counts", """select row_id, target, sum(case when y_true >= 5e1 then 1 else 0 end) over w as tp, sum(case when y_true >= 5e1 then 0 else 1 end) over w as fp from v_pred
    window w as (partition by target order by y_pred desc, row_id rows unbounded preceding)""")
def running_counts(spark, d):
    p = v.pred(spark, d).withColumns({"down": -F.col("y_pred"), "hit": F.col("y_true") >= 50.0})
    out = ordered_scan(p, ["target"], ["down", "row_id"], "down", sums={"tp": F.col("hit").cast("bigint"), "fp": (~F.col("hit")).cast("bigint")})
    return out.select("row_id", "target", "tp", "fp")


@query("win2_overfit_onset", f"select {overfit_sql(3)} as overfit_3, {overfit_sql(8)} as overfit_8")
def overfit(spark, d):
    log = v.epochs(spark, d)
    a, b = series.overfit_onset(log, 3), series.overfit_onset(log, 8)
    return attach(a.withColumnRenamed("overfit_epoch", "overfit_3"), b.withColumnRenamed("overfit_epoch", "overfit_8"))


@query("win3_learning_rate", f"""with e as (select epoch, row_number() over (order by epoch) as e, count(*) over () as n from v_epochs)
    select epoch, {r(f"case when e <= 5 then 2e-3*e/5 else 1e-6 + 0.5e0*(2e-3-1e-6)*(1+cos({math.pi!r}*least(1e0, greatest(0e0, (e-5)/greatest(1e0, n-5e0))))) end", 9)} as learning_rate from e""")
def learning_rate(spark, d):
    return tidy(series.learning_rate(v.epochs(spark, d), 2e-3, 1e-6, 5).select("epoch", "learning_rate"), [], 9)


LENGTH = """ln as (select *, coalesce(sqrt(pow(x_m - lag(x_m) over w, 2) + pow(z_m - lag(z_m) over w, 2)), 0e0) as step from v_track window w as (partition by track_id order by seq)),
  cu as (select *, sum(step) over (partition by track_id order by seq rows unbounded preceding) as length from ln)"""


@query("win4_path_length", f"with {LENGTH} select track_id, seq, {r('length', 4)} as length from cu")
def path_length(spark, d):
    out = series.path_length(v.track(spark, d), "track_id", "seq", "x_m", "z_m")
    return out.select("track_id", "seq", rounded("length", 4).alias("length"))


@query("win5_resample", f"""with {LENGTH}, t as (select track_id, max(length) as total, count(*) as m from cu group by track_id),
    n as (select *, least(8, greatest(4, cast(floor(total/2e3) as bigint) + 1)) as k from t), n2 as (select track_id, total, m, case when m <= 8 then m else k end as k from n),
    g as (select track_id, total, m, k, unnest(range(1, k-1)) as point from n2 where m > k),
    sg as (select track_id, seq, length, length - step as start0, lag(length) over (partition by track_id order by seq) as start, step, x_m, z_m, lag(x_m) over (partition by track_id order by seq) as px, lag(z_m) over (partition by track_id order by seq) as pz from cu),
    inn as (select g.track_id, g.point, (total*point/(k-1) - start)/step as a, px, pz, x_m, z_m from g join sg on sg.track_id = g.track_id and start < total*point/(k-1) and total*point/(k-1) <= length)
    select track_id, point, {r("x", 4)} as x_m, {r("z", 4)} as z_m from (
      select c.track_id, cast(seq as bigint) as point, x_m as x, z_m as z from cu c join n2 using (track_id) where m <= k
      union all select c.track_id, 0, x_m, z_m from cu c join n2 using (track_id) where m > k and seq = 0
      union all select c.track_id, k-1, x_m, z_m from cu c join n2 using (track_id) where m > k and seq = m-1
      union all select track_id, point, px + (x_m-px)*a, pz + (z_m-pz)*a from inn)""")
def resample(spark, d):
    out = series.resample(v.track(spark, d), "track_id", "seq", "x_m", "z_m", spacing=2000.0, least=4, most=8)
    return out.select("track_id", "point", rounded("x_m", 4).alias("x_m"), rounded("z_m", 4).alias("z_m"))


@query("win7_down_crossing", f"""with l as (select *, lag(x_m) over w as px, lag(z_m) over w as pz, first_value(z_m) over w as z0 from v_track window w as (partition by track_id order by seq)),
    c as (select *, row_number() over (partition by track_id order by seq) as k from l where pz > 0 and z_m <= 0)
    select track_id, seq-1 as index_before, seq as index_after, {r("greatest(0e0, least(1e0, pz/(pz - z_m)))")} as fraction, {r("px + (x_m-px)*greatest(0e0, least(1e0, pz/(pz - z_m)))", 4)} as x_at from c where k = 1 and z0 > 0""")
def down_crossing(spark, d):
    out = series.first_down_crossing(v.track(spark, d), "track_id", "seq", "x_m", "z_m", 0.0)
    return out.select("track_id", "index_before", "index_after", rounded("fraction").alias("fraction"), rounded("x_at", 4).alias("x_at"))


COARSE_KEY = "concat(strftime(date_trunc('hour', valid_time), '%H'), '|', cast(cast(round_even(lat/45e0, 0) as bigint) as varchar))"
CHANGES = """k as (select obs_id, user_id, valid_time, {key} as state_key from v_obs), c as (select *, coalesce(state_key <> lag(state_key) over (partition by user_id order by valid_time, obs_id), true) as changed from k)"""


def keyed(spark, d):
    """Observations with a coarse state key, so that neighbours in time often share it."""
    o = v.obs(spark, d)
    key = F.concat(F.date_format(F.date_trunc("hour", "valid_time"), "HH"), F.lit("|"), s.bucket("lat", 45.0).cast("string"))
    return o.select("obs_id", "user_id", "valid_time", key.alias("state_key"))


@query("win8_state_changes", f"""with {CHANGES.format(key=COARSE_KEY)} select obs_id, user_id, changed, cast(sum(changed::int) over (partition by user_id order by valid_time, obs_id rows unbounded preceding) as bigint) as run_id,
    cast(sum(changed::int) over (partition by user_id order by valid_time, obs_id rows unbounded preceding) - 1 as bigint) as refreshes from c""")
def state_changes(spark, d):
    out = series.state_changes(keyed(spark, d), "user_id", ["valid_time", "obs_id"], "valid_time", "state_key")
    return out.select("obs_id", "user_id", "changed", "run_id", "refreshes")


@query("win10_time_axis", f"""select track_id, seq, {r("seq*((track_id % 100 + 10e0)/greatest(count(*) over (partition by track_id) - 1, 1))")} as time_s from v_track""")
def time_axis(spark, d):
    out = series.time_axis(v.track(spark, d), "track_id", "seq", F.col("track_id") % 100 + 10.0)
    return out.select("track_id", "seq", rounded("time_s").alias("time_s"))


@query("win11_clean_curve", f"""with e as (select epoch, train_loss - 1e3 as loss, row_number() over (order by epoch) as k, avg(train_loss - 1e3) over () as m from v_epochs)
    select epoch, {r("case when m < 0 then -loss else loss end")} as loss from e where k > 1""")
def clean_curve(spark, d):
    log = v.epochs(spark, d).select("epoch", (F.col("train_loss") - 1000.0).alias("loss"))
    return tidy(series.clean_curve(log, "loss"), [])


@query("win9_first_of_equal_heights", f"""with g as (select *, floor(z_m2s2/9.80665e0/8e3) as zz from v_grid), k as (select *, row_number() over (partition by time_i, lat_i, lon_i, zz order by level_i) as rn from g)
    select time_i, lat_i, lon_i, level_i, {r("t_k")} as t_k from k where rn = 1""")
def first_of_equal_heights(spark, d):
    g = v.grid(spark, d).withColumn("zz", F.floor(F.col("z_m2s2") / s.G0 / 8000.0))
    out = g.groupBy("time_i", "lat_i", "lon_i", "zz").agg(F.min_by(F.struct("level_i", "t_k"), "level_i").alias("f"))
    return out.select("time_i", "lat_i", "lon_i", F.col("f.level_i").alias("level_i"), rounded("f.t_k").alias("t_k"))


@query("join12_as_of", f"""with rec as (select track_id, x_m, z_m from v_track where seq % 3 = 1), q as (select track_id, seq, x_m + 5e1*(seq % 2) as x_m from v_track),
    f as (select track_id, min(x_m) as x0, arg_min(z_m, x_m) as z0 from rec group by track_id)
    select q.track_id, q.seq, q.x_m, coalesce(r.x_m, f.x0) as record_x_m, {r("coalesce(r.z_m, f.z0)")} as record_z_m from q asof left join rec r on q.track_id = r.track_id and q.x_m >= r.x_m left join f on f.track_id = q.track_id""")
def as_of(spark, d):
    t = v.track(spark, d)
    q = t.select("track_id", "seq", (F.col("x_m") + 50.0 * (F.col("seq") % 2)).alias("x_m"))
    out = series.as_of(q, t.where("seq % 3 = 1"), "track_id", "x_m", "seq", ["z_m"])
    return out.select("track_id", "seq", "x_m", "record_x_m", rounded("record_z_m").alias("record_z_m"))


@query("win6_thin_by_distance", f"""with recursive t as (select track_id, seq, x_m + z_m/1e1 as x from v_track), k(track_id, seq, x) as (select track_id, seq, x from t where seq = 0
      union all select k.track_id, min(t.seq), arg_min(t.x, t.seq) from k join t on t.track_id = k.track_id and t.seq > k.seq and t.x - k.x >= 25e1 group by k.track_id, k.seq),
    e as (select track_id, max(seq) as seq, arg_max(x, seq) as x from t group by track_id) select track_id, seq, {r("x")} as x from (select * from k union select * from e)""")
def thin_by_distance(spark, d):
    t = v.track(spark, d).select("track_id", "seq", (F.col("x_m") + F.col("z_m") / 10.0).alias("x"))
    return series.thin_by_distance(t, "track_id", "seq", "x", 250.0).select("track_id", "seq", rounded("x").alias("x"))
