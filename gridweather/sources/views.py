"""Stand-in views over the shared tables: DataFrame builders and the SQL text of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweather.operators.ordered import ordered_scan

PRESSURE_LEVELS_HPA = [1000.0, 850.0, 700.0, 500.0, 300.0, 100.0, 10.0]
ROW_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point queries: place, time, altitude, wind as speed and direction."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("obs_id"),
        "user_id",
        F.col("ts").alias("valid_time"),
        (((e * 37) % 17900).cast("double") / 100.0 - 89.5).alias("lat"),
        (((e * 91) % 36000).cast("double") / 100.0).alias("lon"),
        (F.col("value") * 60.0).alias("altitude_m"),
        ((e % 400).cast("double") / 10.0).alias("wind_speed_mps"),
        ((e * 53) % 360).cast("double").alias("wind_dir_deg"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube in long form: one row per (time, level, lat, lon) cell."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_orderkey") % 3).cast("int").alias("time_i"),
            F.col("l_linenumber").cast("int").alias("level_i"),
            (F.col("l_partkey") % 5).cast("int").alias("lat_i"),
            (F.col("l_suppkey") % 5).cast("int").alias("lon_i"),
        )
        .agg(
            F.avg("l_discount").alias("disc"), F.avg("l_quantity").alias("qty"), F.avg("l_tax").alias("tax")
        )
    )
    levels = F.array(*[F.lit(p) for p in PRESSURE_LEVELS_HPA])
    return cells.select(
        "time_i",
        "level_i",
        "lat_i",
        "lon_i",
        (F.col("time_i") * 28800.0).alias("t_sec"),
        (90.0 - F.col("lat_i") * 45.0).alias("lat"),
        (F.col("lon_i") * 72.0).alias("lon"),
        F.element_at(levels, F.col("level_i")).alias("level_hpa"),
        (300.0 - F.col("level_i") * 10.0 + F.col("disc") * 20.0).alias("t_k"),
        (F.col("qty") - 25.0).alias("u_mps"),
        (F.col("tax") * 100.0 - 4.0).alias("v_mps"),
        ((4000.0 * (F.col("level_i") - 1) + 1000.0 * F.col("disc")) * 9.80665).alias("z_m2s2"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction pairs by target and model."""
    price = F.col("l_extendedprice") / 1000.0
    return table(spark, sf_dir, "lineitem").select(
        F.expr(ROW_ID).alias("row_id"),
        F.col("l_returnflag").alias("target"),
        F.col("l_linestatus").alias("model"),
        (F.col("l_quantity") * 600.0).alias("altitude_m"),
        price.alias("y_true"),
        (price * (1.0 + F.col("l_discount") - 0.05)).alias("y_pred"),
    )


def uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-component truth and prediction."""
    u, v = F.col("l_quantity") - 25.0, F.col("l_tax") * 100.0 - 4.0
    bend = 1.0 + F.col("l_discount") - 0.05
    return table(spark, sf_dir, "lineitem").select(
        F.expr(ROW_ID).alias("row_id"),
        u.alias("u_true"),
        (u * bend).alias("u_pred"),
        v.alias("v_true"),
        (v * bend).alias("v_pred"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered series per key; the position of a row comes from the skew-safe rank."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("track_id"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    ranked = ordered_scan(orders, ["track_id"], ["o_orderdate", "o_orderkey"], "o_orderdate", rank="rn")
    return ranked.select(
        "track_id",
        (F.col("rn") - 1).cast("int").alias("seq"),
        ((F.col("rn") - 1) * 100.0).alias("x_m"),
        (F.col("o_totalprice") / 100.0 - 1000.0).alias("z_m"),
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log, one row per epoch."""
    value = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.dayofmonth("ts").alias("epoch"))
        .agg(
            F.avg(F.when(F.col("user_id") % 2 == 0, value)).alias("train_loss"),
            F.avg(F.when(F.col("user_id") % 2 == 1, value)).alias("val_loss"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id").alias("client_id"),
        F.col("event_type").alias("route"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a target value; every tenth is a query."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 10 == 0).alias("is_query")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("input_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("duration_s"),
        F.col("o_orderpriority").alias("weather_source"),
    )


VIEW_SQL = {
    "v_obs": """select event_id as obs_id, user_id, ts as valid_time,
       cast((event_id*37)%17900 as double)/1e2 - 89.5e0 as lat, cast((event_id*91)%36000 as double)/1e2 as lon,
       value*6e1 as altitude_m, cast(event_id%400 as double)/1e1 as wind_speed_mps,
       cast((event_id*53)%360 as double) as wind_dir_deg from events""",
    "v_grid": """select cast(h as int) as time_i, cast(lev as int) as level_i, cast(la as int) as lat_i, cast(lo as int) as lon_i,
       2.88e4*h as t_sec, 9e1 - 4.5e1*la as lat, 7.2e1*lo as lon,
       case lev when 1 then 1e3 when 2 then 8.5e2 when 3 then 7e2 when 4 then 5e2 when 5 then 3e2 when 6 then 1e2 else 1e1 end as level_hpa,
       3e2 - 1e1*lev + 2e1*disc as t_k, qty - 2.5e1 as u_mps, 1e2*tax - 4e0 as v_mps,
       9.80665e0*(4e3*(lev-1) + 1e3*disc) as z_m2s2
       from (select l_orderkey%3 as h, l_linenumber as lev, l_partkey%5 as la, l_suppkey%5 as lo,
             avg(l_discount) as disc, avg(l_quantity) as qty, avg(l_tax) as tax
             from lineitem group by l_orderkey%3, l_linenumber, l_partkey%5, l_suppkey%5) g""",
    "v_pred": f"""select {ROW_ID} as row_id, l_returnflag as target, l_linestatus as model, l_quantity*6e2 as altitude_m,
       l_extendedprice/1e3 as y_true, l_extendedprice/1e3*(1e0 + l_discount - 5e-2) as y_pred from lineitem""",
    "v_uv": f"""select {ROW_ID} as row_id, l_quantity - 2.5e1 as u_true, (l_quantity - 2.5e1)*(1e0 + l_discount - 5e-2) as u_pred,
       1e2*l_tax - 4e0 as v_true, (1e2*l_tax - 4e0)*(1e0 + l_discount - 5e-2) as v_pred from lineitem""",
    "v_track": """select o_custkey as track_id,
       cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as seq,
       1e2*(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) as x_m,
       o_totalprice/1e2 - 1e3 as z_m from orders""",
    "v_epochs": """select cast(extract(day from ts) as int) as epoch, avg(case when user_id%2=0 then value end) as train_loss,
       avg(case when user_id%2=1 then value end) as val_loss from events group by cast(extract(day from ts) as int)""",
    "v_requests": """select event_id as request_id, ts, user_id as client_id, event_type as route, value as latency_ms,
       case when event_type='error' then 500 else 200 end as status from events""",
    "v_knn": "select vec_id, embedding, cast(label as double) as y, vec_id%10=0 as is_query from embeddings",
    "v_runs": """select o_orderkey as run_id, o_custkey as input_id, o_orderdate as created_at, o_totalprice as duration_s,
       o_orderpriority as weather_source from orders""",
}
