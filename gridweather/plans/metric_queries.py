"""Statistics and error metrics over the prediction, wind, log and request views."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gridweather.functions import features as ft, scalars as s
from gridweather.operators import metrics as mt, series, stats
from gridweather.plans.registry import h, query, r, rounded
from gridweather.plans.scalar_queries import WEATHER_FEATURES_SQL
from gridweather.sources import views as v

ERR = "(y_pred - y_true)"
COLS = ["altitude_m", "lat", "wind_speed_mps"]


def tidy(df, keys, digits=6):
    """Round every double column."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(n, digits).alias(n) if kinds[n] == "double" and n not in keys else F.col(n) for n in df.columns])


def long_sql(cols, src="v_obs"):
    return " union all ".join(f"select '{n}' as name, {n} as x from {src}" for n in cols)


def basic_sql(e: str = ERR) -> str:
    return f"count({e}) as n, {r(f'avg(abs({e}))')} as mae, {r(f'sqrt(avg({e}*{e}))')} as rmse, {r(f'max(abs({e}))')} as max_abs"


@query("agg1_moments", f"""with l as ({long_sql(COLS)}) select name, count(*) as n, {r("avg(x)")} as mean, {r("var_pop(x)*count(*)", 3)} as m2, {r("stddev_samp(x)")} as std from l group by name""")
def moments(spark, d):
    o = v.obs(spark, d)
    # Two halves merged, as separate runs would be.
    parts = stats.moments(o.where("obs_id % 2 = 0"), COLS).unionByName(stats.moments(o.where("obs_id % 2 = 1"), COLS))
    out = stats.std_from_moments(stats.merge_moments(parts))
    return out.select("name", "n", rounded("mean").alias("mean"), rounded("m2", 3).alias("m2"), rounded("std").alias("std"))


@query("agg2_normalisation", f"""with t as (select altitude_m, lat, wind_speed_mps as w, ln(greatest(1e5 + wind_dir_deg, 1e-6)) as p from v_obs where extract(day from valid_time) <= 23)
    select 'feature' as kind, 'altitude_m' as name, {r("avg(altitude_m)")} as mean, {r("stddev_samp(altitude_m)")} as std from t
    union all select 'feature', 'lat', {r("avg(lat)")}, {r("stddev_samp(lat)")} from t
    union all select 'target', 'wind', {r("avg(w)")}, {r("stddev_pop(w)")} from t union all select 'target', 'pressure', {r("avg(p)")}, {r("stddev_pop(p)", 8)} from t""")
def normalisation(spark, d):
    train = v.obs(spark, d).where(F.dayofmonth("valid_time") <= 23)
    out = stats.normalisation(train, ["altitude_m", "lat"], {"wind": F.col("wind_speed_mps"), "pressure": s.log_target(F.col("wind_dir_deg") + 1e5)})
    digits = F.when(F.col("name") == "pressure", rounded("std", 8)).otherwise(rounded("std"))
    return out.select("kind", "name", rounded("mean").alias("mean"), digits.alias("std"))


@query("agg3_envelope", f"with l as ({long_sql(COLS)}) select name, {r('min(x)')} as low, {r('max(x)')} as high from l group by name")
def envelope(spark, d):
    return tidy(stats.envelope(v.obs(spark, d), COLS), [])


@query("agg4_basic_metrics", f"select target, model, {basic_sql()} from v_pred group by target, model")
def basic_metrics(spark, d):
    return tidy(mt.basic_by(v.pred(spark, d), ["target", "model"], mt.error_of()), [])


@query("agg5_detailed_metrics", f"""with e as (select target, y_true, {ERR} as e from v_pred)
    select target, {basic_sql("e")}, {r("quantile_cont(abs(e), 0.5)")} as median_abs, {r("quantile_cont(abs(e), 0.9)")} as p90_abs, {r("quantile_cont(abs(e), 0.95)")} as p95_abs,
    {r("quantile_cont(abs(e), 0.99)")} as p99_abs, {r("avg(e)")} as bias, {r("stddev_pop(e)")} as std_error, {r("1 - sum(e*e)/greatest(1e-12, var_pop(y_true)*count(*))")} as r2 from e group by target""")
def detailed_metrics(spark, d):
    return tidy(mt.detailed_by(v.pred(spark, d), ["target"]), [])


BAND = mt.band_sql("altitude_m")
BAND_FRAME = "(values " + ", ".join(f"('{n}')" for n, _, _ in mt.BANDS) + ") b(band)"


@query("agg6_by_band", f"""with g as (select target, {BAND} as band, {basic_sql()} from v_pred group by 1, 2), t as (select distinct target from v_pred)
    select t.target, b.band, coalesce(g.n, 0) as n, g.mae, g.rmse, g.max_abs from t cross join {BAND_FRAME} left join g on g.target = t.target and g.band = b.band""")
def by_band(spark, d):
    return tidy(mt.by_band(v.pred(spark, d), ["target"], "altitude_m", mt.error_of()), []).select("target", "band", "n", "mae", "rmse", "max_abs")


@query("agg7_overall_and_bands", f"""with p as (select *, {BAND} as band from v_pred) select target, 'overall' as level, null as band, {basic_sql()} from p group by target
    union all select target, 'band' as level, band, {basic_sql()} from p where band is not null group by target, band""")
def overall_and_bands(spark, d):
    return tidy(mt.overall_and_bands(v.pred(spark, d), "target", "altitude_m", mt.error_of()), [])


def _profile_sql(axis: str, bins: int, lo: str, hi: str) -> str:
    w = f"(({hi} - {lo})/{bins})"
    return f"""select '{axis}' as axis, f.target, f.bin, {r(f"{lo} + f.bin*{w}")} as bin_start, {r(f"{lo} + (f.bin+1)*{w}")} as bin_end, {r(f"{lo} + (f.bin+0.5e0)*{w}")} as bin_center,
      count(p.e) as count, {r("avg(abs(p.e))")} as mean_abs_error
      from (select target, cast(bin as int) as bin, lo, hi from (select distinct target from v_pred) cross join (select unnest(range(0, {bins})) as bin) cross join ends) f
      left join (select target, {axis} as x, y_pred - y_true as e, least(cast(floor(({axis} - {lo})/{w}) as int), {bins - 1}) as bin from hp cross join ends) p
        on p.target = f.target and p.bin = f.bin group by f.target, f.bin, f.lo, f.hi"""


@query("agg8_error_profile", f"""with hp as (select *, cast(row_id % 48 as double)/2e0 as hour from v_pred), ends as (select min(altitude_m) as lo, max(altitude_m) as hi from v_pred)
    {_profile_sql("altitude_m", 12, "lo", "hi")} union all {_profile_sql("hour", 24, "0e0", "24e0")}""")
def error_profile(spark, d):
    p = v.pred(spark, d).withColumn("hour", (F.col("row_id") % 48).cast("double") / 2.0)
    return tidy(mt.error_profiles(p, "target", {"altitude_m": (12, None, None), "hour": (24, 0.0, 24.0)}, mt.error_of()), [])


EDGES = """ed as (select target, quantile_cont(y_true, 0e0) as a0, quantile_cont(y_true, 1e0/3) as a1, quantile_cont(y_true, 2e0/3) as a2, quantile_cont(y_true, 1e0) as a3 from v_pred group by target),
  n1 as (select target, a0 as e0, case when a1 <= a0 then a0 + 1e-6 else a1 end as e1, a2, a3 from ed), n2 as (select *, case when a2 <= e1 then e1 + 1e-6 else a2 end as e2 from n1),
  eg as (select target, e0, e1, e2, case when a3 <= e2 then e2 + 1e-6 else a3 end as e3 from n2)"""


@query("agg9_quantile_edges", f"with {EDGES} select target, {', '.join(f'{r(e)} as {e}' for e in ('e0', 'e1', 'e2', 'e3'))} from eg")
def quantile_edges(spark, d):
    return tidy(mt.quantile_edges(v.pred(spark, d), ["target"], F.col("y_true"), 3), [])


@query("agg10_class_confusion", f"""with {EDGES}, c as (select p.target, (y_true >= e1)::int + (y_true >= e2)::int as t, (y_pred >= e1)::int + (y_pred >= e2)::int as p, count(*) as n from v_pred p join eg using (target) group by 1, 2, 3),
    f as (select eg.*, i, j from eg cross join (select unnest([0,1,2]) as i) cross join (select unnest([0,1,2]) as j))
    select f.target, ['low','mid','high'][i+1] as true_bin, ['low','mid','high'][j+1] as predicted_bin, coalesce(c.n, 0) as count, {r("[e0,e1,e2][i+1]")} as bin_edge_low, {r("[e1,e2,e3][i+1]")} as bin_edge_high
    from f left join c on c.target = f.target and c.t = i and c.p = j""")
def class_confusion(spark, d):
    return tidy(mt.class_confusion(v.pred(spark, d), "target", "y_true", "y_pred"), [])


SPEEDS = "sp as (select row_id, sqrt(u_true*u_true+v_true*v_true) as ts, sqrt(u_pred*u_pred+v_pred*v_pred) as ps from v_uv)"


def speeds(spark, d):
    return v.uv(spark, d).select("row_id", s.wind_speed("u_true", "v_true").alias("ts"), s.wind_speed("u_pred", "v_pred").alias("ps"))


@query("agg11_event_scores", f"""with {SPEEDS}, c as (select count(*) filter (where ts < 10 and ps < 10) as tn, count(*) filter (where ts < 10 and ps >= 10) as fp, count(*) filter (where ts >= 10 and ps < 10) as fn,
      count(*) filter (where ts >= 10 and ps >= 10) as tp, avg(case when ts >= 10 then 1e0 else 0e0 end) as rate from sp),
    m as (select *, tp/greatest(1e0, tp+fp) as pr, tp/greatest(1e0, tp+fn) as re from c)
    select tn, fp, fn, tp, {r("rate")} as positive_rate, {r("(tp+tn)/greatest(1e0, tp+tn+fp+fn)")} as accuracy, {r("pr")} as precision, {r("re")} as recall,
      {r("tn/greatest(1e0, tn+fp)")} as specificity, {r("2*pr*re/greatest(1e-12, pr+re)")} as f1 from m""")
def event_scores(spark, d):
    return tidy(mt.event_scores(speeds(spark, d), F.col("ts") >= 10.0, F.col("ps") >= 10.0), [])


CURVE = f"""{SPEEDS}, g as (select ps, count(*) filter (where ts >= 10) as p, count(*) filter (where not ts >= 10) as q from sp group by ps),
  cu as (select ps, p, q, sum(p) over (order by ps desc) as tp, sum(q) over (order by ps desc) as fp from g), tot as (select greatest(1, sum(p)) as np, greatest(1, sum(q)) as nq from g)"""


def curve(spark, d):
    return mt.threshold_curve(speeds(spark, d), F.col("ts") >= 10.0, F.col("ps"))


@query("agg12_roc_curve", f"with {CURVE} select {r('ps', 9)} as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, {r('tp/np', 9)} as tpr, {r('fp/nq', 9)} as fpr from cu, tot")
def roc_curve(spark, d):
    c = curve(spark, d)
    return c.select(rounded("threshold", 9).alias("threshold"), "tp", "fp", rounded("tpr", 9).alias("tpr"), rounded("fpr", 9).alias("fpr"))


@query("agg12_auc", f"with {CURVE} select {r('sum((q/nq)*(tp/np + (tp-p)/np)/2)')} as auc from cu, tot")
def auc(spark, d):
    return tidy(mt.area_under_roc(curve(spark, d)), [])


@query("agg13_pr_curve", f"with {CURVE} select {r('ps', 9)} as threshold, {r('tp/np', 9)} as recall, {r('tp/greatest(1, tp+fp)', 9)} as precision from cu, tot")
def pr_curve(spark, d):
    c = curve(spark, d)
    return c.select(rounded("threshold", 9).alias("threshold"), rounded("tpr", 9).alias("recall"), rounded("precision", 9).alias("precision"))


@query("agg13_average_precision", f"with {CURVE} select {r('sum((p/np)*(tp/greatest(1, tp+fp)))')} as average_precision from cu, tot")
def average_precision(spark, d):
    return tidy(mt.average_precision(curve(spark, d)), [])


_PERM = f"""with o as (select *, row_number() over (order by row_id) as k from v_uv),
    hu as (select u_pred as x, row_number() over (order by {h("'11'", "row_id")}, row_id) as k from v_uv), hv as (select v_pred as x, row_number() over (order by {h("'12'", "row_id")}, row_id) as k from v_uv),
    e as (select 'u_pred' as feature, abs(0.8e0*hu.x + 0.1e0*v_pred - u_true) as eu, abs(0.9e0*v_pred - v_true) as ev from o join hu using (k)
      union all select 'v_pred', abs(0.8e0*u_pred + 0.1e0*hv.x - u_true), abs(0.9e0*hv.x - v_true) from o join hv using (k)),
    m as (select feature, 'u_true' as target, avg(eu) as permuted from e group by feature union all select feature, 'v_true', avg(ev) from e group by feature),
    b as (select 'u_true' as target, avg(abs(0.8e0*u_pred + 0.1e0*v_pred - u_true)) as base from v_uv union all select 'v_true', avg(abs(0.9e0*v_pred - v_true)) from v_uv)"""


@query("agg14_permutation_importance", f"""{_PERM} select target, feature, {r("permuted", 9)} as permuted_mae, {r("base", 9)} as baseline_mae, {r("permuted-base", 9)} as delta_mae, {r("(permuted-base)/greatest(1e-12, base)", 9)} as relative_delta from m join b using (target)""")
def permutation_importance(spark, d):
    def score(df):
        return df.withColumns({"pred_u_true": F.col("u_pred") * 0.8 + F.col("v_pred") * 0.1, "pred_v_true": F.col("v_pred") * 0.9})

    return tidy(mt.permutation_importance(v.uv(spark, d), "row_id", ["u_pred", "v_pred"], ["u_true", "v_true"], score, 11), [], 9)


@query("agg15_importance_by_group", f"""with f as ({WEATHER_FEATURES_SQL}), l as (select feature, avg(abs(x)) as dl from (unpivot f on columns(* exclude (obs_id)) into name feature value x) u group by feature),
    g as (select *, case when contains(feature,'altitude') then 'altitude' when feature like 'utc%' or feature like 'solar%' or contains(feature,'hour') then 'time_of_day'
      when feature like 'doy%' or contains(feature,'day_of_year') then 'day_of_year' when contains(feature,'lat') or contains(feature,'lon') or feature like 'sphere%' then 'location' else 'other' end as feature_group from l)
    select 'spread' as target, feature_group, {r("sum(dl)")} as sum_delta_mae, {r("avg(dl)")} as mean_delta_mae from g group by feature_group""")
def importance_by_group(spark, d):
    named = ft.weather_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), s.utc_hour("valid_time"))
    o = v.obs(spark, d).select(*[rounded(column, 9).alias(n) for n, column in named.items()])
    spread = stats.long_form(o, list(named)).groupBy(F.col("name").alias("feature")).agg(F.avg(F.abs("x")).alias("delta_mae"))
    return tidy(mt.importance_by_group(spread.withColumn("target", F.lit("spread"))), [])


def weighted(names, swapped: str | None = None) -> str:
    """A linear score over all features, the swapped one taken from its shuffled column ``x``."""
    return "250e0 + " + " + ".join(f"{1 / (i + 2)!r}e0*{'h.x' if n == swapped else 'o.' + n}" for i, n in enumerate(names))


#: The features in the order in which their SQL names them; the weights and seeds follow it.
WEATHER_NAMES = re.findall(r" as (\w+)(?:,\s| from a$)", WEATHER_FEATURES_SQL[WEATHER_FEATURES_SQL.rindex("select obs_id, ") :])
PERMUTED_SQL = f"""f as ({WEATHER_FEATURES_SQL}), o as (select f.*, 288.15e0 - 0.0065e0*v.altitude_m as t_true, row_number() over (order by obs_id) as k from f join v_obs v using (obs_id)),
    b as (select avg(abs({weighted(WEATHER_NAMES)} - t_true)) as base from o),
    m as ({" union all ".join(f"""select '{n}' as feature, avg(abs({weighted(WEATHER_NAMES, n)} - t_true)) as permuted from o join (select {n} as x, row_number() over (order by {h(f"'{21 + j}'", "obs_id")}, obs_id) as k from o) h using (k)""" for j, n in enumerate(WEATHER_NAMES))}),
    g as (select permuted - base as dl, case when contains(feature,'altitude') then 'altitude' when feature like 'utc%' or feature like 'solar%' or contains(feature,'hour') then 'time_of_day'
      when feature like 'doy%' or contains(feature,'day_of_year') then 'day_of_year' when contains(feature,'lat') or contains(feature,'lon') or feature like 'sphere%' then 'location' else 'other' end as feature_group from m, b)"""


@query("agg15_permuted_groups", f"""with {PERMUTED_SQL} select 't_true' as target, feature_group, {r("sum(dl)")} as sum_delta_mae, {r("avg(dl)")} as mean_delta_mae from g group by feature_group""")
def permuted_groups(spark, d):
    """Importance by group from the permutation importance of every weather feature under a linear score."""
    named = ft.weather_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), s.utc_hour("valid_time"))
    o = v.obs(spark, d).select("obs_id", *[rounded(named[n], 9).alias(n) for n in WEATHER_NAMES], (288.15 - F.col("altitude_m") * 0.0065).alias("t_true"))

    def score(df):
        return df.withColumn("pred_t_true", sum((F.col(n) * (1 / (i + 2)) for i, n in enumerate(WEATHER_NAMES)), F.lit(250.0)))

    return tidy(mt.importance_by_group(mt.permutation_importance(o, "obs_id", WEATHER_NAMES, ["t_true"], score, 21)), [])


_UV = ["u_true", "u_pred", "v_true", "v_pred"]


@query("agg16_distribution", f"""with l as ({long_sql(_UV, "v_uv")}) select name, count(x) as count, {r("avg(x)")} as mean, {r("stddev_pop(x)")} as std, {r("min(x)")} as min, {r("max(x)")} as max,
    {r("avg(case when abs(x) < 1e-3 then 1e0 else 0e0 end)")} as share_small, {r("avg(case when abs(x) > 1 then 1e0 else 0e0 end)")} as share_above_1, {r("avg(case when x <= 0 then 1e0 else 0e0 end)")} as share_not_positive,
    {r("quantile_cont(x, 0.01)")} as p01, {r("quantile_cont(x, 0.5)")} as p50, {r("quantile_cont(x, 0.99)")} as p99 from l group by name""")
def distribution(spark, d):
    return tidy(mt.distribution_summary(stats.long_form(v.uv(spark, d), _UV)), [])


@query("agg17_model_comparison", f"""with g as (select target, model, {basic_sql()} from v_pred group by 1, 2), l as (select target, model, 'mae' as metric, mae as x from g union all select target, model, 'rmse', rmse from g union all select target, model, 'max_abs', max_abs from g)
    select metric, target, max(x) filter (where model='F') as "F", max(x) filter (where model='O') as "O", {r("max(x) filter (where model='O') - max(x) filter (where model='F')", 4)} as delta from l group by metric, target""")
def model_comparison(spark, d):
    out = mt.compare_models(v.pred(spark, d), "target", "model", ["F", "O"], mt.error_of())
    return out.select("metric", "target", rounded("F").alias("F"), rounded("O").alias("O"), rounded("delta", 4).alias("delta"))


def overfit_sql(p: int) -> str:
    return f"""(select min(i+1) from (select row_number() over (order by epoch) - 1 as i, lead(train_loss, {p - 1}) over (order by epoch) - train_loss as dt, lead(val_loss, {p - 1}) over (order by epoch) - val_loss as dv,
      count(*) over () as n from v_epochs) where i >= 1 and i < n - {p} and n >= {p + 2} and dt < 0 and dv > 0)"""


@query("agg18_training_summary", f"""select count(*) as epochs, arg_min(epoch, val_loss) as best_epoch, {r("min(val_loss)")} as best_val_loss, {r("arg_max(train_loss, epoch)")} as final_train_loss, {r("arg_max(val_loss, epoch)")} as final_val_loss,
    {overfit_sql(3)} as overfit_epoch from v_epochs""")
def training_summary(spark, d):
    return tidy(mt.training_summary(v.epochs(spark, d), 3), [])


@query("agg19_history_summary", f"""select track_id, count(*) as fetches, min(x_m) as first_x, max(x_m) as last_x, {r("arg_min(z_m, seq)")} as first_z, {r("arg_max(z_m, seq)")} as last_z from v_track group by track_id""")
def history_summary(spark, d):
    ends = v.track(spark, d).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("fetches"), F.min_by(F.struct("x_m", "z_m"), "seq").alias("a"), F.max_by(F.struct("x_m", "z_m"), "seq").alias("b"))
    return ends.select("track_id", "fetches", F.col("a.x_m").alias("first_x"), F.col("b.x_m").alias("last_x"), rounded("a.z_m").alias("first_z"), rounded("b.z_m").alias("last_z"))


@query("agg20_point_check", f"""with e as (select case when row_id % 7 <> 0 then {ERR} end as e from v_pred) select count(e) as n_valid, count(*) - count(e) as n_skipped,
    {r("avg(abs(e))")} as e_mae, {r("sqrt(avg(e*e))")} as e_rmse, {r("max(abs(e))")} as e_max_abs from e""")
def point_check(spark, d):
    p = v.pred(spark, d).select(F.when(F.col("row_id") % 7 != 0, mt.error_of()).alias("e"))
    return tidy(mt.point_check(p, ["e"]), [])


@query("agg21_by_hour", """select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') as hour_key, count(*) as n, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type <> 'error') as done from events group by 1""")
def by_hour(spark, d):
    failed = F.col("event_type") == "error"
    out = v.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("done"))
    return out.orderBy("hr").select(F.date_format("hr", "yyyy-MM-dd'T'HH").alias("hour_key"), "n", "failed", "done")


@query("agg22_access_summary", f"""select strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M') as "minute", route, count(*) as requests, count(*) filter (where status < 300) as ok, count(*) filter (where status between 400 and 499) as refused,
    count(*) filter (where status >= 500) as failed, {r("quantile_cont(latency_ms, 0.5)", 4)} as p50_ms, {r("quantile_cont(latency_ms, 0.95)", 4)} as p95_ms from v_requests group by 1, 2""")
def access_summary(spark, d):
    line = F.concat(F.lit("GET /"), F.col("route"), F.lit(" "), F.col("status"), F.lit(" "), F.col("latency_ms"), F.lit("ms"))
    out = mt.access_summary(v.requests(spark, d).withColumn("line", line), "ts", "line")
    return tidy(out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd'T'HH:mm")), [], 4)


@query("agg23_gap_curve", f"select epoch, {r('val_loss - train_loss')} as gap from v_epochs where train_loss is not null and val_loss is not null")
def gap_curve(spark, d):
    return tidy(series.gap_curve(v.epochs(spark, d)), [])
