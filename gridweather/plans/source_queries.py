"""Sources and sinks: tables are written to the shared folder and read back, or shaped from the given ones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridweather.operators.attach import attach
from gridweather.functions import scalars as s
from gridweather.operators import metrics as mt, stats
from gridweather.plans.lookup_queries import NEAR, AXES, fold_sql, queries_at
from gridweather.operators import lookup as lk
from gridweather.plans.metric_queries import BAND, ERR, tidy
from gridweather.plans.registry import query, r, rounded, u01
from gridweather.session import new_folder
from gridweather.sources import readers as rd, sinks as sk, views as v

SPREAD = "cast(cast(ts as date) + cast(31*(event_id % 3) as int) as date)"


@query("src1_month_files", f"select event_id, strftime({SPREAD}, '%Y-%m-%d') as day from events where extract(year from {SPREAD}) = 2024 and extract(month from {SPREAD}) in (1, 3)")
def month_files(spark, d):
    root = new_folder(spark, "days")
    e = v.table(spark, d, "events").select("event_id", F.date_add(F.to_date("ts"), (F.col("event_id") % 3 * 31).cast("int")).alias("date"))
    rd.write_days(e.repartition("date"), root, F.col("date"))
    found = rd.read_months(spark, root, 2024, [1, 3], "event_id bigint, date date")
    return found.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("src2_first_days", "select event_id from events where cast(ts as date) in (select distinct cast(ts as date) from events order by 1 limit 5)")
def first_days(spark, d):
    return rd.first_days(v.table(spark, d, "events").withColumn("day", F.to_date("ts")), "day", 5).select("event_id")


@query("src3_held_out_day", "select event_id, 'newest' as pick from events where cast(ts as date) = (select max(cast(ts as date)) from events) union all select event_id, 'named' from events where cast(ts as date) = date '2024-01-10'")
def held_out_day(spark, d):
    e = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    a = rd.held_out_day(e, "day").select("event_id", F.lit("newest").alias("pick"))
    return a.unionByName(rd.held_out_day(e, "day", "2024-01-10").select("event_id", F.lit("named").alias("pick")))


@query("src4_file_date", """with n as (select event_id, case event_id % 4 when 0 then '/data/era5_' || strftime(ts, '%Y_%m_%d') || '.nc' when 1 then 'era5_' || strftime(ts, '%Y_%m_%d') || '.nc4' when 2 then 'era5_2024_13_40.nc' else 'era5_' || strftime(ts, '%Y_%m_%d') || '.nc' end as f from events)
    select event_id, strftime(try_cast(nullif(regexp_replace(regexp_extract(f, 'era5_(\\d{4}_\\d{2}_\\d{2})\\.nc$', 1), '_', '-', 'g'), '') as date), '%Y-%m-%d') as day from n""")
def file_date(spark, d):
    stem = F.concat(F.lit("era5_"), F.date_format("ts", "yyyy_MM_dd"))
    m = F.col("event_id") % 4
    name = F.when(m == 0, F.concat(F.lit("/data/"), stem, F.lit(".nc"))).when(m == 1, F.concat(stem, F.lit(".nc4"))).when(m == 2, "era5_2024_13_40.nc").otherwise(F.concat(stem, F.lit(".nc")))
    return v.table(spark, d, "events").select("event_id", F.date_format(rd.file_date(name), "yyyy-MM-dd").alias("day"))


@query("src5_header_aliases", "select event_id, value as t, user_id as lat, event_id as lon from events")
def header_aliases(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.col("value").alias("temperature"), F.col("user_id").alias("latitude"), F.col("event_id").alias("longitude"))
    return rd.canonical_columns(e, ["t", "lat", "lon"]).select("event_id", "t", "lat", "lon")


@query("src6_cube_rows", f"select time_i, level_i, lat_i, lon_i, {r('t_k')} as t_k, {r('u_mps')} as u_mps, level_hpa*1e2 as pressure_pa from v_grid")
def cube_rows(spark, d):
    g = v.grid(spark, d)
    # A cube holds one value per axis position: arrays are as long as the axes, here latitude inside longitude.
    cell = F.struct("lat_i", F.struct("t_k", "u_mps"))
    inner = g.groupBy("time_i", "level_i", "level_hpa", "lon_i").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["col2"]).alias("row"))
    cube = inner.groupBy("time_i", "level_i", "level_hpa").agg(F.transform(F.array_sort(F.collect_list(F.struct("lon_i", "row"))), lambda x: x["row"]).alias("cube"))
    out = rd.cube_to_rows(cube, "cube", ["lon_i", "lat_i"])
    return out.select("time_i", "level_i", "lat_i", "lon_i", rounded("t_k").alias("t_k"), rounded("u_mps").alias("u_mps"), s.hpa_to_pa("level_hpa").alias("pressure_pa"))


@query("src7_hour_slice", f"""with {AXES}, hq as (select obs_id, extract(hour from valid_time)*3600e0 as sec from v_obs), dd as (select obs_id, list_transform(ts, lambda a: abs(a - sec)) as dist from hq, ax)
    select obs_id, cast(list_position(dist, list_min(dist)) - 1 as int) as time_i, level_i, count(*) as cells, {r("avg(t_k)")} as mean_t_k from dd join v_grid g on g.time_i = list_position(dist, list_min(dist)) - 1 group by 1, 2, 3""")
def hour_slice(spark, d):
    g = v.grid(spark, d)
    hour = (F.hour(F.date_trunc("hour", "valid_time")) * 3600).cast("double")
    q = lk.grid_axes(g).time.nearest(v.obs(spark, d).select("obs_id", "valid_time"), hour, "time_i")
    # Slices are summed up once per stored time and level, then met by the queries.
    slices = g.groupBy("time_i", "level_i").agg(F.count(F.lit(1)).alias("cells"), rounded(F.avg("t_k")).alias("mean_t_k"))
    return q.join(slices, "time_i").select("obs_id", "time_i", "level_i", "cells", "mean_t_k")


@query("src8_hourly_payload", f"""with hr as (select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00') as k, avg(value) as t, max(value) as w from events where extract(hour from ts) % 7 <> 3 group by 1)
    select obs_id, {r("t + 273.15e0")} as temperature_k, {r("w")} as wind_mps, hr.k is null as rejected from v_obs left join hr on hr.k = strftime(date_trunc('hour', valid_time), '%Y-%m-%dT%H:00')""")
def hourly_payload(spark, d):
    def key(c):
        return F.date_format(F.date_trunc("hour", c), "yyyy-MM-dd'T'HH:00")

    hours = v.table(spark, d, "events").where(F.hour("ts") % 7 != 3).groupBy(F.to_date("ts").alias("day"), key("ts").alias("k")).agg(F.avg("value").alias("t"), F.max("value").alias("w"))
    # One payload per day, 24 entries at most.
    one = F.array_sort(F.collect_list(F.struct("k", "t", "w")))
    payload = hours.groupBy("day").agg(one.alias("a")).select(F.to_json(F.struct(F.struct(F.col("a.k").alias("time"), F.col("a.t").alias("temperature_2m"), F.col("a.w").alias("wind_speed_10m")).alias("hourly"))).alias("json"))
    good, bad = rd.at_hour(v.obs(spark, d).select("obs_id", key("valid_time").alias("hour_key")), rd.hourly_rows(payload, "json", []), "hour_key")
    a = good.select("obs_id", rounded(s.celsius_to_kelvin("temperature_c")).alias("temperature_k"), rounded("wind_speed_mps").alias("wind_mps"), F.lit(False).alias("rejected"))
    none = F.lit(None).cast("double")
    return a.unionByName(bad.select("obs_id", none.alias("temperature_k"), none.alias("wind_mps"), F.lit(True).alias("rejected")))


def write_log(spark, d):
    """The epoch log as text with some torn lines and bad cells."""
    folder = new_folder(spark, "log")
    e = F.col("epoch")
    val = F.when(e % 5 == 0, "").when(e % 7 == 0, "oops").otherwise(F.round("val_loss", 6).cast("string"))
    line = F.concat_ws(",", e.cast("string"), F.round("train_loss", 6).cast("string"), F.when(e % 11 == 0, F.concat(val, F.lit(",9"))).otherwise(val))
    head = spark.range(1).select(F.lit(0).alias("o"), F.lit("epoch,loss,val_loss").alias("value"))
    # A log has one line per epoch; it is one small file with its header first.
    head.unionByName(v.epochs(spark, d).select(e.alias("o"), line.alias("value"))).orderBy("o").select("value").coalesce(1).write.text(folder)
    return folder


@query("src9_tolerant_log", f"select cast(epoch as double) as epoch, {r('train_loss')} as loss, case when epoch % 5 = 0 or epoch % 7 = 0 then null else {r('val_loss')} end as val_loss from v_epochs where epoch % 11 <> 0")
def tolerant_log(spark, d):
    return tidy(rd.read_log(spark, write_log(spark, d)), [])


@query("src10_log_history", f"""with l as (select epoch, 'loss' as metric, {r("train_loss")} as value from v_epochs where epoch % 11 <> 0 union all select epoch, 'val_loss', {r("val_loss")} from v_epochs where epoch % 11 <> 0 and epoch % 5 <> 0 and epoch % 7 <> 0),
    j as (select epoch, {r("train_loss")} as value from v_epochs) select 'csv' as origin, metric, row_number() over (partition by metric order by epoch) as pos, value from l
    union all select 'json', 'loss', row_number() over (order by epoch), value from j""")
def log_history(spark, d):
    from_csv = rd.log_history(rd.read_log(spark, write_log(spark, d)), None, "epoch")
    lists = v.epochs(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", F.round("train_loss", 6).alias("x")))), lambda e: e["x"]).alias("loss")).select(F.to_json(F.struct("loss")).alias("value"))
    from_json = rd.log_history(lists, lists, "epoch")
    return from_csv.select(F.lit("csv").alias("origin"), "metric", "pos", "value").unionByName(from_json.select(F.lit("json").alias("origin"), "metric", "pos", "value"))


PI2 = repr(2.0 * math.pi)
SYNTH = f"""b as (select min(lat) as la, max(lat) as lz, min(lon) as oa, max(lon) as oz, count(distinct cast(valid_time as date)) as nd from v_obs),
  i as (select la, lz, oa, oz, nd, unnest(range(0, 6*6*5*nd*4)) as id from b), x as (select id, la + ((lz-la)/5)*(id // (6*5*nd*4)) as lat, oa + ((oz-oa)/6)*((id // (5*nd*4)) % 6) as lon, 5e3*((id // (nd*4)) % 5) as altitude_m,
    1e0 + ((nd-1e0)/greatest(1, nd-1))*((id // 4) % nd) as day_of_year, 7e0*(id % 4) as utc_hour from i),
  y as (select *, greatest(288.15e0 - altitude_m*0.0065e0, 216.65e0) as st, sqrt(-2e0*ln(1e0 - {u01("'42'", "id")}))*cos({PI2}e0*{u01("'43'", "id")})*0.5e0 as noise from x)"""


def synthetic(spark, d):
    b = v.obs(spark, d).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.count_distinct(F.to_date("valid_time"))).first()
    return rd.synthetic_grid(spark, (b[0], b[1], 6), (b[2], b[3], 6), (0.0, 20000.0, 5), (1.0, float(b[4]), b[4]), (0.0, 21.0, 4))


@query("src11_synthetic_grid", f"""with {SYNTH} select id, {r("lat")} as lat, {r("lon")} as lon, altitude_m, {r("day_of_year")} as day_of_year, utc_hour, {r("st + noise")} as temperature_k,
    {r("101325e0*pow(greatest(st/288.15e0, 1e-3), 5.2561e0)", 4)} as pressure_pa, {r("5e0*sin(radians(lat))")} as wind_u, {r("2e0*cos(radians(lat))")} as wind_v from y""")
def synthetic_grid(spark, d):
    g = synthetic(spark, d)
    return g.select("id", *[rounded(n).alias(n) for n in ("lat", "lon", "altitude_m", "day_of_year", "utc_hour", "temperature_k")], rounded("pressure_pa", 4).alias("pressure_pa"), rounded("wind_u").alias("wind_u"), rounded("wind_v").alias("wind_v"))


@query("src12_real_or_synthetic", f"""with {SYNTH} select 'with grid' as "case", 'grid' as source, count(*) as n, {r("avg(t_k)")} as mean_t_k from v_grid
    union all select 'without grid', 'synthetic', count(*), {r("avg(st + noise)")} from y""")
def real_or_synthetic(spark, d):
    made = synthetic(spark, d)
    real = v.grid(spark, d).select("lat", "lon", F.col("t_k").alias("temperature_k"))
    out = []
    for case, rows in (("with grid", real), ("without grid", real.where("lat > 1000"))):
        one = rd.real_or_synthetic(rows, made).groupBy("source").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("temperature_k")).alias("mean_t_k"))
        out.append(one.select(F.lit(case).alias("case"), "source", "n", "mean_t_k"))
    return out[0].unionByName(out[1])


LEVELS = "[" + ",".join(str(p) for p in rd.DOWNLOAD_LEVELS) + "]"


@query("src13_download_slots", f"""with m as (select distinct date_trunc('month', {SPREAD}) as m from events), dy as (select unnest(generate_series(m, m + interval '1 month' - interval '1 day', interval '1 day')) as day from m),
    h as (select day, unnest(range(0, 24)) as hour from dy), l as (select day, hour, unnest({LEVELS}) as level_hpa from h), c as (select {SPREAD} as day, extract(hour from ts) as hour, count(*) as n from events group by 1, 2)
    select strftime(l.day, '%Y-%m-%d') as day, l.hour, l.level_hpa, coalesce(n, 0) as stored from l left join c on c.day = l.day and c.hour = l.hour""")
def download_slots(spark, d):
    e = v.table(spark, d, "events").select(F.date_add(F.to_date("ts"), (F.col("event_id") % 3 * 31).cast("int")).alias("day"), F.hour("ts").alias("hour"))
    months = e.select(F.year("day").alias("y"), F.month("day").alias("m")).distinct()
    stored = e.groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n"))
    out = rd.download_slots(months, "y", "m").join(stored, ["day", "hour"], "left")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "hour", "level_hpa", F.coalesce("n", F.lit(0)).alias("stored"))


@query("src14_incremental_ingest", "select event_id from events where cast(ts as date) not in (select distinct cast(ts as date) from events where extract(day from ts) % 3 = 0)")
def incremental_ingest(spark, d):
    e = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return rd.not_yet_stored(e, e.where(F.dayofmonth("day") % 3 == 0), "day").select("event_id")


@query("src15_json_lines", f"""with {AXES}, {NEAR}, {fold_sql("lv", "linear")}, pz as (select obs_id, count(distinct z) as levels, min(z) as z0 from lv group by obs_id)
    select f.obs_id, {r("o.lat")} as lat, {r(f"sin({PI2}e0*extract(doy from o.valid_time)/365e0)")} as day_sin, {r("f.t_k")} as t_k, pz.levels, {r("pz.z0", 4)} as z_0, {r("f.p_pa", 3)} as p_pa from fv f join v_obs o using (obs_id) join pz using (obs_id)""")
def json_lines(spark, d):
    g = v.grid(spark, d)
    profile = lk.at_height(lk.nearest_profiles(queries_at(spark, d), g, lk.grid_axes(g)), "altitude_m", "linear")
    day = s.harmonics(F.dayofyear("valid_time"), s.ROW_YEAR_DAYS, 1, "day")
    rows = profile.select(
        "obs_id", F.struct("lat", "lon", day["day_sin_1"].alias("day_sin"), day["day_cos_1"].alias("day_cos")).alias("initial_conditions"),
        F.struct(F.struct("t_k", "p_pa").alias("point"), F.struct(F.col("profile.z").alias("z"), F.col("profile.t_k").alias("t_k")).alias("profile")).alias("environment"))
    path = new_folder(spark, "rows")
    sk.write_json_lines(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("obs_id", rounded("initial_conditions.lat").alias("lat"), rounded("initial_conditions.day_sin").alias("day_sin"), rounded("environment.point.t_k").alias("t_k"),
                       F.size("environment.profile.z").alias("levels"), rounded(F.col("environment.profile.z")[0], 4).alias("z_0"), rounded("environment.point.p_pa", 3).alias("p_pa"))


@query("src16_csv_union", f"select 'a' as part, row_id, {r('y_true', 9)} as y_true, cast(null as double) as y_pred from v_pred where model = 'F' union all select 'b', row_id, null, {r('y_pred', 9)} from v_pred where model = 'O'")
def csv_union(spark, d):
    p = v.pred(spark, d)
    a = p.where("model = 'F'").select(F.lit("a").alias("part"), "row_id", rounded("y_true", 9).alias("y_true"))
    b = p.where("model = 'O'").select(F.lit("b").alias("part"), "row_id", rounded("y_pred", 9).alias("y_pred"))
    path = new_folder(spark, "csv")
    sk.write_csv_union([a, b], path)
    return spark.read.csv(path, header=True, schema="part string, row_id bigint, y_true double, y_pred double")


@query("src17_json_report", f"""with b as (select target, coalesce({BAND}, '') as band, count(*) as n, avg(abs({ERR})) as mae from v_pred group by 1, 2 union all select target, 'overall', count(*), avg(abs({ERR})) from v_pred group by 1)
    select target, band, n, {r("mae")} as mae, 'sf' as source from b where band <> ''""")
def json_report(spark, d):
    m = mt.overall_and_bands(v.pred(spark, d), "target", "altitude_m", mt.error_of())
    path = new_folder(spark, "report")
    sk.write_report(m, ("target", "band"), ["n", "mae", "rmse", "max_abs"], {"source": "sf"}, path)
    back = spark.read.schema("target string, metrics map<string, struct<n: bigint, mae: double>>, provenance struct<source: string>").json(path)
    return back.select("target", F.explode("metrics").alias("band", "m"), F.col("provenance.source").alias("source")).select("target", "band", F.col("m.n").alias("n"), rounded("m.mae").alias("mae"), "source")


@query("src18_statistics_table", f"""with b as (select min(altitude_m) as lo, max(altitude_m) as hi from v_obs) select obs_id, {r("(altitude_m-lo)/(case when hi > lo then hi-lo else 1e0 end)")} as scaled, 5e0 as k from v_obs, b""")
def statistics_table(spark, d):
    o = v.obs(spark, d)
    path = new_folder(spark, "stats")
    sk.save_statistics(stats.envelope(o, ["altitude_m", "lat"]), path, {"k": 5})
    kept = sk.load_statistics(spark, path)
    one = stats.wide(kept, ["altitude_m"], ["low", "high", "k"])
    return attach(o, one).select("obs_id", rounded(s.min_max("altitude_m", "altitude_m_low", "altitude_m_high")).alias("scaled"), F.col("altitude_m_k").alias("k"))
