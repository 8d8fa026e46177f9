"""Streams over copies of the event table that arrive in parts, one batch each."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweather.operators import stats
from gridweather.plans.metric_queries import COLS, long_sql
from gridweather.plans.registry import query, r, rounded
from gridweather.plans.series_queries import CHANGES, COARSE_KEY, keyed
from gridweather.sources import views as v
from gridweather.streaming import jobs
from gridweather.session import new_folder

ARRIVALS = [(1, 10), (11, 20), (21, 31)]


def arriving(df, at: str, source: str):
    """Append the table in parts, as days would come in, and hand out the stream over the folder after each part."""
    spark = df.sparkSession
    for low, high in ARRIVALS:
        df.where(F.dayofmonth(at).between(low, high)).write.mode("append").parquet(source)
        yield spark.readStream.schema(df.schema).parquet(source)


@query("str1_running_moments", f"with l as ({long_sql(COLS)}) select name, count(*) as n, {r('avg(x)')} as mean, {r('stddev_samp(x)')} as std from l group by name")
def running_moments(spark, d):
    folder = new_folder(spark, "moments")
    for stream in arriving(v.obs(spark, d), "valid_time", f"{folder}/source"):
        seen = jobs.running_moments(stream, COLS, folder)
    out = stats.std_from_moments(seen)
    return out.select("name", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


# The event table is sparse, so windows are an hour long and limits low enough that each of the three is met.
HOURLY = {"overall": 14, "client": 1, "create": 0}


@query("str2_rate_windows", """with w as (select time_bucket(interval '1 hour', ts) as s, client_id, count(*) as requests, count(*) filter (where route = 'purchase') as creates from v_requests group by 1, 2),
    t as (select *, sum(requests) over (partition by s) as overall from w)
    select strftime(s, '%Y-%m-%dT%H:%M:%S') as window_start, client_id, requests, creates, cast(overall as bigint) as overall,
      case when overall > 14 then 'overall' when requests > 1 then 'client' when creates > 0 then 'create' end as limit_hit
    from t where s + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)""")
def rate_windows(spark, d):
    folder = new_folder(spark, "rates")
    q = v.requests(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for stream in arriving(q, "ts", f"{folder}/source"):
        out = jobs.rate_stream(stream, folder, "ts", "client_id", F.col("route") == "purchase", window="1 hour", limits=HOURLY)
    return out.select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "client_id", "requests", "creates", "overall", "limit_hit")


@query("str3_change_stream", f"with {CHANGES.format(key=COARSE_KEY)} select obs_id, user_id, state_key from c where changed")
def change_stream(spark, d):
    folder = new_folder(spark, "changes")
    for stream in arriving(keyed(spark, d), "valid_time", f"{folder}/source"):
        out = jobs.change_stream(stream, "user_id", "valid_time", "obs_id", "state_key", folder)
    return out.select("obs_id", "user_id", "state_key")


@query("str4_live_registry", f"""with k as (select user_id, event_id, value, row_number() over (partition by user_id order by ts desc) as rn from events) select user_id, event_id, {r("value")} as value from k where rn = 1""")
def live_registry(spark, d):
    folder = new_folder(spark, "registry")
    e = v.table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    for stream in arriving(e, "ts", f"{folder}/source"):
        out = jobs.registry_stream(stream, "user_id", "ts", folder)
    return out.select("user_id", "event_id", rounded("value").alias("value"))


@query("str5_new_days", "select strftime(ts, '%Y-%m-%d') as day, count(*) as rows, case when extract(day from ts) <= 10 then 'first' else 'second' end as call from events group by 1, 3")
def new_days(spark, d):
    folder = new_folder(spark, "arrivals")
    source = f"{folder}/days"
    e = v.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("n", F.dayofmonth("ts"))

    def arrive(low, high):
        e.where(F.col("n").between(low, high)).drop("n").repartition("day").write.mode("append").partitionBy("day").parquet(source)

    arrive(1, 10)
    schema = spark.read.parquet(source).schema
    first = jobs.new_days(spark, source, schema, folder).select("event_id").distinct()
    first.write.parquet(f"{folder}/first")
    arrive(11, 31)
    both = jobs.new_days(spark, source, schema, folder)
    earlier = spark.read.parquet(f"{folder}/first").withColumn("call", F.lit("first"))
    marked = both.join(earlier, "event_id", "left").withColumn("call", F.coalesce("call", F.lit("second")))
    return marked.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "call").agg(F.count(F.lit(1)).alias("rows"))
