"""Validation, tables, pages and routing over the run, request and observation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweather.functions import scalars as s
from gridweather.operators import stats, tables as tb, validate as vd
from gridweather.plans.registry import query, r, rounded
from gridweather.plans.scalar_queries import HOUR, LON180
from gridweather.sources import views as v

BAD = "case when value < 5 then 'nan'::double when value < 10 then 'infinity'::double when value < 15 then null else value end"


def with_bad_values(spark, d):
    x = F.col("value")
    odd = F.when(x < 5, float("nan")).when(x < 10, float("inf")).when(x < 15, F.lit(None)).otherwise(x)
    return v.table(spark, d, "events").select("event_id", odd.alias("x"), "user_id")


@query("flt1_finite_mask", f"with a as (select event_id, {BAD} as x from events) select event_id, x from a where x is not null and isfinite(x)")
def finite_mask(spark, d):
    return vd.finite_rows(with_bad_values(spark, d), ["x"]).select("event_id", "x")


@query("flt2_range_check", f"""select obs_id, lat between -90 and 90 and {LON180} between -180 and 180 and altitude_m*2 between 0 and 32000 and extract(doy from valid_time) between 1 and 366
    and {HOUR} between 0 and 24 and extract(year from valid_time) between 1900 and 2100 as ok from v_obs""")
def range_check(spark, d):
    o = v.obs(spark, d).select(
        "obs_id", "lat", s.fold_lon_180("lon").alias("lon"), (F.col("altitude_m") * 2).alias("altitude_m"), F.dayofyear("valid_time").alias("day_of_year"),
        s.utc_hour("valid_time").alias("utc_hour"), F.year("valid_time").alias("year"))
    return o.select("obs_id", vd.in_ranges(vd.QUERY_RANGES).alias("ok"))


RULE = vd.RecordRule(
    {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "alt": (0.0, 20000.0)}, {"weather_source": (["machine", "api", "knn", "calculations"], "machine")}
)
# Request bodies with one kind of fault each, one with two, and good ones.
BODY_SQL = """(case request_id % 9 when 0 then '{"lat":' || (client_id % 90) || ',"lon":' || (client_id % 180) || ',"alt":' || latency_ms || ',"weather_source":"api"}'
  when 1 then '{"lat":' || (client_id % 90) || ',"lon":10.5,"alt":100}' when 2 then '{"lon":10.5,"alt":100}' when 3 then '{"lat":"12","lon":10.5,"alt":' || latency_ms || '}'
  when 4 then '{"lat":999,"lon":-' || (client_id % 400) || ',"alt":100}' when 5 then '{"lat":1,"lon":2,"alt":3,"' || route || '":true}' when 6 then '{"lat":1,"lon":2,"alt":3,"weather_source":"' || route || '"}'
  when 7 then '{}' else '{"lat":null,"lon":2,"alt":-5}' end)"""


def _bound_sql(name: str, lo: str, hi: str) -> str:
    x, kind = f"try_cast(json_extract_string(js, '$.{name}') as double)", f"json_type(js, '$.{name}')"
    num = f"coalesce({kind} in ('UBIGINT','BIGINT','DOUBLE'), false)"
    return f"""case when not json_exists(js, '$.{name}') then '{name} missing' end, case when json_exists(js, '$.{name}') and not {num} then '{name} not a number' end,
      case when {num} and {x} < {lo} then '{name} below {lo}' end, case when {num} and {x} > {hi} then '{name} above {hi}' end"""


REASONS_SQL = f"""list_sort(list_concat(list_filter([{_bound_sql("lat", "-90", "90")}, {_bound_sql("lon", "-180", "180")}, {_bound_sql("alt", "0", "20000")},
  case when json_exists(js, '$.weather_source') and json_extract_string(js, '$.weather_source') not in ('machine','api','knn','calculations') then 'weather_source not allowed' end], lambda x: x is not null),
  list_transform(list_filter(json_keys(js), lambda k: k not in ('lat','lon','alt','weather_source')), lambda k: 'unknown ' || k)))"""


def request_bodies(spark, d):
    return v.requests(spark, d).withColumn(
        "js", F.expr(BODY_SQL.replace('{"', '{"')))


@query("flt3_strict_records", f"""with b as (select request_id, cast({BODY_SQL} as json) as js from v_requests), c as (select request_id, js, {REASONS_SQL} as reasons from b)
    select request_id, array_to_string(reasons, '; ') as reasons, case when len(reasons) = 0 then coalesce(json_extract_string(js, '$.weather_source'), 'machine') end as weather_source,
      case when len(reasons) = 0 then cast(json_extract_string(js, '$.alt') as double) end as alt from c""")
def strict_records(spark, d):
    out = vd.check_records(request_bodies(spark, d), "js", RULE)
    return out.select("request_id", F.concat_ws("; ", "reasons").alias("reasons"), F.col("record.weather_source").alias("weather_source"), F.col("record.alt").alias("alt"))


ID_SQL = "(case when event_id % 3 = 0 then substring(md5(cast(event_id as varchar)), 1, 24) when event_id % 3 = 1 then upper(substring(md5(cast(event_id as varchar)), 1, 24)) else substring(md5(cast(event_id as varchar)), 1, 23) || 'g' end)"


@query("flt4_id_pattern", f"select event_id, regexp_full_match({ID_SQL}, '[a-fA-F0-9]{{24}}') as ok from events")
def id_pattern(spark, d):
    ident = F.expr(ID_SQL.replace("varchar", "string"))
    return v.table(spark, d, "events").select("event_id", ident.rlike(vd.OBJECT_ID).alias("ok"))


FIELDS_SQL = "with f as (select obs_id, case when obs_id % 13 <> 0 then cast(obs_id % 400 as double) - 200e0 end as t_c, cast((obs_id*7) % 1500 as double) as p_hpa, wind_speed_mps as e, wind_dir_deg as n from v_obs)"


@query("flt5_fallback_row", f"""{FIELDS_SQL}, k as (select *, case when t_c is null then 'field missing' when not t_c + 273.15e0 between 150 and 350 then 'temperature out of bounds' when not p_hpa*1e2 between 50000 and 120000 then 'pressure out of bounds' end as note from f)
    select obs_id, note, {r("case when note is null then t_c + 273.15e0 else 288.15e0 end")} as temperature_k, case when note is null then p_hpa*1e2 else 101325e0 end as pressure_pa, case when note is null then e else 0e0 end as east from k""")
def fallback_row(spark, d):
    i = F.col("obs_id")
    o = v.obs(spark, d).select("obs_id", F.when(i % 13 != 0, (i % 400).cast("double") - 200.0).alias("t_c"), ((i * 7) % 1500).cast("double").alias("p_hpa"), F.col("wind_speed_mps").alias("east"), F.col("wind_dir_deg").alias("north"))
    out = vd.surface_or_fallback(o, ["t_c", "p_hpa", "east", "north"])
    return out.select("obs_id", "note", rounded("conditions.temperature_k").alias("temperature_k"), F.col("conditions.pressure_pa").alias("pressure_pa"), F.col("conditions.east").alias("east"))


@query("flt6_envelope_flag", f"""with b as (select min(lat) as la, max(lat) as lb, min(altitude_m) as aa, max(altitude_m) as ab from v_obs where obs_id % 2 = 0 and altitude_m < 9000 and abs(lat) < 60),
    x as (select obs_id, greatest(greatest(0e0, la-lat, lat-lb)/(case when lb > la then lb-la else 1e0 end), greatest(0e0, aa-altitude_m, altitude_m-ab)/(case when ab > aa then ab-aa else 1e0 end)) as ex from v_obs, b)
    select obs_id, {r("ex")} as excursion, ex > 0.05 as outside from x""")
def envelope_flag(spark, d):
    o = v.obs(spark, d)
    bounds = stats.envelope(o.where("obs_id % 2 = 0 and altitude_m < 9000 and abs(lat) < 60"), ["lat", "altitude_m"])
    return vd.envelope_flag(o, bounds, ["lat", "altitude_m"]).select("obs_id", rounded("excursion").alias("excursion"), "outside")


@query("flt7_allowed_days", "select event_id, extract(day from ts) as day from events where extract(day from ts) between 1 and 25 and extract(day from ts) not in (19, 7)")
def allowed_days(spark, d):
    days = [x for x in range(1, 26) if x not in (19, 7)]
    if not days:
        raise ValueError("no days left")
    return v.table(spark, d, "events").select("event_id", F.dayofmonth("ts").alias("day")).where(F.col("day").isin(days))


@query("flt8_point_list", """with p as (select track_id, seq // 4 as part, seq, cast(track_id % 360 as double) as lon, case when z_m < -900 then null else z_m/1e2 end as lat, z_m as alt from v_track),
    g as (select track_id, part, count(*) as n, bool_and(lat is not null) as fin, max(alt)/1e1 as dur from p group by 1, 2)
    select track_id, part, n as points, n between 1 and 30000 and fin as ok from g""")
def point_list(spark, d):
    p = v.track(spark, d).select("track_id", F.floor(F.col("seq") / 4).alias("part"), (F.col("track_id") % 360).cast("double").alias("lon"), F.when(F.col("z_m") >= -900, F.col("z_m") / 100.0).alias("lat"), F.col("z_m").alias("alt"))
    # A document holds four neighbouring points at most, so the lists stay short whatever a track's length.
    docs = p.groupBy("track_id", "part").agg(F.collect_list(F.struct("lon", "lat", "alt")).alias("points"), (F.max("alt") / 10.0).alias("duration"))
    return docs.select("track_id", "part", F.size("points").alias("n"), vd.points_ok("points", "duration").alias("ok")).withColumnRenamed("n", "points")


@query("flt9_state_sanity", "select track_id, seq from v_track where abs(x_m) <= 1500 and abs(z_m) <= 3000")
def state_sanity(spark, d):
    return v.track(spark, d).where(vd.sane_state({"x_m": 1500.0, "z_m": 3000.0})).select("track_id", "seq")


@query("flt10_complete_override", """with a as (select obs_id, case when obs_id%2=0 then 280e0 end as t0, case when obs_id%3=0 then 1e5 end as p0, case when obs_id%5<>0 then 3e0 end as wx, 0e0 as wz from v_obs)
    select obs_id, case when t0 is not null and p0 is not null and wx is not null then t0 else 288.15e0 end as t, case when t0 is not null and p0 is not null and wx is not null then wx else 0e0 end as wx, t0 is not null and p0 is not null and wx is not null as overridden from a""")
def complete_override(spark, d):
    i = F.col("obs_id")
    o = v.obs(spark, d).select("obs_id", F.when(i % 2 == 0, 280.0).alias("t0"), F.when(i % 3 == 0, 1e5).alias("p0"), F.when(i % 5 != 0, 3.0).alias("wx0"), F.lit(0.0).alias("wz0"))
    out = vd.complete_override({"t": "t0", "p": "p0", "wx": "wx0", "wz": "wz0"}, {"t": F.lit(288.15), "p": F.lit(101325.0), "wx": F.lit(0.0), "wz": F.lit(0.0)})
    return o.select("obs_id", out["t"].alias("t"), out["wx"].alias("wx"), out["overridden"].alias("overridden"))


@query("flt11_request_features", f"select obs_id, {r('lat')} as lat, {r(LON180)} as lon, {r('altitude_m')} as altitude_m, extract(doy from valid_time) as day_of_year, {r(HOUR)} as utc_hour from v_obs")
def request_features(spark, d):
    return v.obs(spark, d).select("obs_id", rounded("lat").alias("lat"), rounded(s.fold_lon_180("lon")).alias("lon"), rounded("altitude_m").alias("altitude_m"), F.dayofyear("valid_time").alias("day_of_year"), rounded(s.utc_hour("valid_time")).alias("utc_hour"))


PROVIDERS = "pv as (select 'api' as provider, extract(day from ts) as day, avg(value) as x from events group by 2 union all select 'machine', extract(day from ts), max(value) from events group by 2 union all select 'knn', extract(day from ts), min(value) from events group by 2)"
ASKED = "rq as (select run_id, run_id % 30 + 1 as day, case run_id % 4 when 0 then ' API ' when 1 then 'Machine' when 2 then 'knn' else weather_source end as source from v_runs)"


def routed(spark, d):
    days = v.table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("bigint").alias("day")).agg(F.avg("value").alias("api"), F.max("value").alias("machine"), F.min("value").alias("knn"))
    providers = days.unpivot(["day"], ["api", "machine", "knn"], "provider", "x")
    m = F.col("run_id") % 4
    asked = v.runs(spark, d).select("run_id", (F.col("run_id") % 30 + 1).alias("day"), F.when(m == 0, " API ").when(m == 1, "Machine").when(m == 2, "knn").otherwise(F.col("weather_source")).alias("source"))
    return tb.route(asked, providers, "source", "day")


@query("join11_source_routing", f"""with {PROVIDERS}, {ASKED} select run_id, lower(trim(source)) as provider, {r("x")} as x, null as reason from rq join pv on pv.provider = lower(trim(source)) and pv.day = rq.day
    union all select run_id, lower(trim(source)), null, 'unsupported source: ' || lower(trim(source)) from rq where lower(trim(source)) not in ('api','machine','knn')
    union all select run_id, lower(trim(source)), null, 'no data from source: ' || lower(trim(source)) from rq where lower(trim(source)) in ('api','machine','knn')
      and not exists (select 1 from pv where pv.provider = lower(trim(source)) and pv.day = rq.day)""")
def source_routing(spark, d):
    good, bad = routed(spark, d)
    a = good.select("run_id", "provider", rounded("x").alias("x"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(bad.select("run_id", "provider", F.lit(None).cast("double").alias("x"), "reason"))


@query("join13_run_details", "select run_id, input_id, c_mktsegment as segment, round(duration_s, 2) as duration_s from v_runs join customer on c_custkey = input_id where c_custkey % 7 <> 0")
def run_details(spark, d):
    inputs = v.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("input_id"), F.col("c_mktsegment").alias("segment"))
    return v.runs(spark, d).join(inputs, "input_id").select("run_id", "input_id", "segment", F.round("duration_s", 2).alias("duration_s"))


@query("join13_missing_input", "select run_id, input_id from v_runs where input_id not in (select c_custkey from customer where c_custkey % 7 <> 0)")
def missing_input(spark, d):
    inputs = v.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("input_id"))
    return v.runs(spark, d).join(inputs, "input_id", "left_anti").select("run_id", "input_id")


@query("join14_cascade_delete", """select 'result' as kind, run_id as id from v_runs where run_id % 10 <> 0 union all
    select 'input', c_custkey from customer where c_custkey not in (select input_id from v_runs where run_id % 10 = 0)""")
def cascade_delete(spark, d):
    runs = v.runs(spark, d)
    inputs = v.table(spark, d, "customer").select(F.col("c_custkey").alias("input_id"))
    left, kept = tb.cascade_delete(runs, inputs, runs.where("run_id % 10 = 0"), "run_id", "input_id", "input_id")
    return left.select(F.lit("result").alias("kind"), F.col("run_id").alias("id")).unionByName(kept.select(F.lit("input").alias("kind"), F.col("input_id").alias("id")))


@query("join18_key_check", """with st as (select run_id, sha256('key-' || input_id) as digest from v_runs where run_id % 5 <> 0), a as (select run_id, case run_id % 4 when 0 then ' key-' || input_id || ' ' when 1 then 'wrong' when 2 then '  ' else 'key-' || input_id end as k from v_runs)
    select a.run_id, case when trim(k) = '' then 401 when st.run_id is null then 404 when sha256(trim(k)) = digest then 200 else 403 end as status from a left join st on st.run_id = a.run_id""")
def key_check(spark, d):
    runs = v.runs(spark, d)
    own = F.concat(F.lit("key-"), "input_id")
    stored = runs.where("run_id % 5 <> 0").select("run_id", s.key_digest(own).alias("digest"))
    m = F.col("run_id") % 4
    asked = runs.select("run_id", F.when(m == 0, F.concat(F.lit(" "), own, F.lit(" "))).when(m == 1, "wrong").when(m == 2, "  ").otherwise(own).alias("k"))
    return tb.key_check(asked, stored, "run_id", "k", "digest").select("run_id", "status")


@query("srt1_page", """select run_id, input_id, (select count(*) from v_runs) as total, cast(ceil((select count(*) from v_runs)/10e0) as bigint) as total_pages from v_runs order by created_at desc, run_id desc limit 10 offset 20""")
def page(spark, d):
    return tb.page(v.runs(spark, d), "created_at", "run_id", 3, 10).select("run_id", "input_id", "total", "total_pages")


@query("srt2_top_features", f"""with g as (select l_returnflag as target, l_partkey as feature, avg(l_tax) as dl from lineitem group by 1, 2), k as (select *, row_number() over (partition by target order by round(dl, 9) desc, feature) as rank from g)
    select target, feature, {r("dl")} as delta, rank from k where rank <= 15""")
def top_features(spark, d):
    g = v.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("target"), F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_tax"), 9).alias("dl"))
    return tb.top_per_group(g, ["target"], F.col("dl"), "feature", 15).select("target", "feature", rounded("dl").alias("delta"), "rank")


@query("srt4_largest_groups", "select l_suppkey, count(*) as rows from lineitem group by 1 having count(*) >= 100 order by rows desc, l_suppkey limit 12")
def largest_groups(spark, d):
    return tb.largest_groups(v.table(spark, d, "lineitem"), "l_suppkey", 100, 12)


@query("srt5_newest_first", "select run_id, strftime(created_at, '%Y-%m-%d') as created from v_runs order by created_at desc, run_id desc")
def newest_first(spark, d):
    return tb.newest_first(v.runs(spark, d), "created_at", "run_id").select("run_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("set1_concatenate_days", "select obs_id, extract(day from valid_time) % 3 as part from v_obs")
def concatenate_days(spark, d):
    o = v.obs(spark, d).select("obs_id", (F.dayofmonth("valid_time") % 3).alias("part"))
    return tb.concatenate([o.where(F.col("part") == k) for k in range(3)])


UPDATED = """up as (select run_id, created_at + to_days(cast(run_id % 3 as int) - 1) as created_at, duration_s*2 as duration_s, 1 as nw from v_runs where run_id % 5 = 0 union all
    select run_id + 10000000, created_at, duration_s, 1 from v_runs where run_id % 7 = 0),
  al as (select run_id, created_at, duration_s, 0 as nw from v_runs union all select * from up), k as (select *, row_number() over (partition by run_id order by created_at desc, nw desc) as rn from al)"""


@query("set2_upsert", f"with {UPDATED} select run_id, strftime(created_at, '%Y-%m-%d') as created, round(duration_s, 2) as duration_s from k where rn = 1")
def upsert(spark, d):
    runs = v.runs(spark, d).select("run_id", F.col("created_at").cast("timestamp").alias("created_at"), "duration_s")
    moved = F.expr("created_at + make_dt_interval(cast(run_id % 3 as int) - 1)")
    a = runs.where("run_id % 5 = 0").select("run_id", moved.alias("created_at"), (F.col("duration_s") * 2).alias("duration_s"))
    b = runs.where("run_id % 7 = 0").select((F.col("run_id") + 10000000).alias("run_id"), "created_at", "duration_s")
    out = tb.upsert(runs, a.unionByName(b), "run_id", "created_at")
    return out.select("run_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.round("duration_s", 2).alias("duration_s"))


@query("set3_remove", "select run_id from v_runs where run_id % 4 <> 1")
def remove(spark, d):
    runs = v.runs(spark, d).select("run_id")
    return tb.remove(runs, runs.where("run_id % 4 = 1"), "run_id")
