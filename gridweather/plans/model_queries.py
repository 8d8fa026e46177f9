"""Neighbour search and boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweather.operators.attach import attach
from gridweather.functions import features as ft, scalars as s
from gridweather.operators import metrics as mt, models as ml, neighbours as nn, sampling as sm, stats
from gridweather.plans.lookup_queries import EXACT, exact_values
from gridweather.plans.registry import query, r, rounded
from gridweather.plans.scalar_queries import HOUR, PI2, _ISA_N as ISA_EXPONENT
from gridweather.sources import views as v

KNN_SQL = """nb as (select q.vec_id as query_id, t.vec_id as train_id, t.y, list_distance(cast(q.embedding as double[]), cast(t.embedding as double[])) as d from v_knn q, v_knn t where q.is_query and not t.is_query),
  rk as (select *, row_number() over (partition by query_id order by d, train_id) as rank from nb)"""


def vectors(spark, d, k, **kw):
    x = v.knn(spark, d).withColumnRenamed("embedding", "vec")
    return nn.nearest_neighbours(x.where("not is_query"), x.where("is_query"), k, train_id="vec_id", query_id="vec_id", carry=["y"], **kw)


@query("join15_nearest_vectors", f"with {KNN_SQL} select query_id, train_id, {r('d')} as distance, rank from rk where rank <= 8")
def nearest_vectors(spark, d):
    return vectors(spark, d, 8).select("query_id", "train_id", rounded(F.sqrt("sq_distance")).alias("distance"), "rank")


@query("join16_inverse_distance", f"with {KNN_SQL} select query_id, {r('sum(y/greatest(d,1e-6))/sum(1/greatest(d,1e-6))')} as y, {r('avg(d)')} as mean_distance from rk where rank <= 8 group by query_id")
def inverse_distance(spark, d):
    out = nn.inverse_distance_mean(vectors(spark, d, 8), ["y"])
    return out.select("query_id", rounded("y").alias("y"), rounded("mean_distance").alias("mean_distance"))


@query("srt3_k_smallest", f"with {KNN_SQL} select query_id, train_id, {r('d*d')} as sq_distance from rk where rank <= 3")
def k_smallest(spark, d):
    return vectors(spark, d, 3).select("query_id", "train_id", rounded("sq_distance").alias("sq_distance"))


_CYC = {"lat": "lat", "lon": "lon", "altitude_m": "altitude_m", "ds": f"sin({PI2}e0*extract(doy from valid_time)/365.25e0)", "dc": f"cos({PI2}e0*extract(doy from valid_time)/365.25e0)", "hs": f"sin({PI2}e0*{HOUR}/24e0)", "hc": f"cos({PI2}e0*{HOUR}/24e0)"}
_T, _U = "(288.15e0 - 0.0065e0*altitude_m)", "(-wind_speed_mps*sin(radians(wind_dir_deg)))"
WEATHER_SQL = f"""cy as (select obs_id, {", ".join(f"{e} as c{i}" for i, e in enumerate(_CYC.values()))}, {_T} as t_k, {_U} as u_mps from v_obs),
  mm as (select {", ".join(f"min(c{i}) as a{i}, case when max(c{i}) > min(c{i}) then max(c{i})-min(c{i}) else 1e0 end as w{i}" for i in range(7))} from cy where obs_id % 10 <> 0),
  nv as (select obs_id, t_k, u_mps, [{", ".join(f"(c{i}-a{i})/w{i}" for i in range(7))}] as vec from cy, mm),
  nb as (select q.obs_id as query_id, t.obs_id as train_id, t.t_k, t.u_mps, list_distance(q.vec, t.vec) as d from nv q, nv t where q.obs_id % 10 = 0 and t.obs_id % 10 <> 0),
  rk as (select *, row_number() over (partition by query_id order by d, train_id) as rank from nb)"""


def weather_neighbours(spark, d, k=8):
    """Observations as points of the cyclic feature space, scaled by the training rows' range."""
    named = ft.cyclic_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), s.utc_hour("valid_time"))
    east, _ = s.wind_from("wind_speed_mps", "wind_dir_deg")
    o = v.obs(spark, d).select("obs_id", *[c.alias(n) for n, c in named.items()], (288.15 - F.col("altitude_m") * 0.0065).alias("t_k"), east.alias("u_mps"))
    train = o.where("obs_id % 10 <> 0")
    one = stats.wide(stats.envelope(train, list(named)), list(named), ["low", "high"])
    scaled = attach(o, one).withColumn("vec", F.array(*[s.min_max(n, f"{n}_low", f"{n}_high") for n in named]))
    return nn.nearest_neighbours(scaled.where("obs_id % 10 <> 0"), scaled.where("obs_id % 10 = 0"), k, train_id="obs_id", query_id="obs_id", carry=["t_k", "u_mps"])


@query("join15_nearest_weather", f"with {WEATHER_SQL} select query_id, train_id, {r('d')} as distance, rank from rk where rank <= 8")
def nearest_weather(spark, d):
    return weather_neighbours(spark, d).select("query_id", "train_id", rounded(F.sqrt("sq_distance")).alias("distance"), "rank")


@query("join16_weather_estimate", f"""with {WEATHER_SQL} select query_id, {r("sum(t_k/greatest(d,1e-6))/sum(1/greatest(d,1e-6))")} as t_k, {r("sum(u_mps/greatest(d,1e-6))/sum(1/greatest(d,1e-6))")} as u_mps, {r("avg(d)")} as mean_distance from rk where rank <= 8 group by query_id""")
def weather_estimate(spark, d):
    out = nn.inverse_distance_mean(weather_neighbours(spark, d), ["t_k", "u_mps"])
    return out.select("query_id", *[rounded(n).alias(n) for n in ("t_k", "u_mps", "mean_distance")])


TARGETS = ["T", "P", "U", "V"]
# Few rounds: the registered queries show the operator, not the best model.
QUICK = {"maxIter": 4, "maxDepth": 4, "stepSize": 0.3, "maxBins": 64}


def labelled(spark, d):
    """Observations with tree features, the four variables and the split by day."""
    hour = s.utc_hour("valid_time")
    named = ft.tree_features("lat", "lon", "altitude_m", F.dayofyear("valid_time"), hour, s.solar_hour(hour, "lon"))
    t, p, _ = s.standard_atmosphere("altitude_m", 288.15, 101325.0)
    u, w = s.wind_from("wind_speed_mps", "wind_dir_deg")
    o = v.obs(spark, d)
    data = o.select(
        "obs_id", F.dayofmonth("valid_time").alias("day"), *[c.alias(n) for n, c in named.items()], F.col("altitude_m"), t.alias("T"), p.alias("P"), u.alias("U"), w.alias("V"),
        sm.day_split(F.dayofmonth("valid_time")).alias("split"), F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)).alias("area"))
    return data, list(named)


def bundle_for(data, names, targets=TARGETS):
    rows = data.where("split <> 'test'").withColumn("held_out", F.col("split") == "val")
    return ml.fit_trees(rows, names, targets, weights={t: "area" for t in targets}, held_out="held_out", **QUICK)


@query("mlr1_fit_trees")
def fit_trees(spark, d):
    data, names = labelled(spark, d)
    bundle = bundle_for(data, names)
    facts = [(t, m.getNumTrees, names[int(max(range(len(names)), key=lambda i: m.featureImportances[i]))]) for t, m in bundle.models.items()]
    made = spark.createDataFrame(facts, "target string, trees int, strongest string")
    rows = data.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).where("split = 'train'")
    return attach(made, rows.select("rows"))


#: Day split and the two variables that follow from the altitude, for the facts below.
LABELLED_SQL = f"""hl as (select obs_id, extract(day from valid_time) as day, case when extract(day from valid_time) <= 23 then 'train' when extract(day from valid_time) <= 27 then 'val' else 'test' end as split,
  least(2e4, greatest(0e0, altitude_m)) as hh from v_obs),
  lb as (select obs_id, day, split, case when hh <= 11e3 then 288.15e0 - 0.0065e0*hh else 216.65e0 end as t,
    101325e0*pow((288.15e0 - 0.0065e0*least(hh, 11e3))/288.15e0, {ISA_EXPONENT}e0)*exp(-9.81e0*greatest(hh - 11e3, 0e0)/(287.05e0*216.65e0)) as p from hl)"""


@query("mlr1_fitted", f"""with {LABELLED_SQL}, tg as (select unnest(['T','P','U','V']) as target) select target, count(*) filter (split = 'train') as trained, count(*) filter (split = 'val') as held_out, true as within_limit
    from lb, tg group by target""")
def fitted(spark, d):
    """Per target the rows it learnt from and was stopped on, and whether its trees and their depth keep the limits."""
    data, names = labelled(spark, d)
    models = bundle_for(data, names).models
    within = [(t, 0 < m.getNumTrees <= QUICK["maxIter"] and all(tree.depth <= QUICK["maxDepth"] for tree in m.trees)) for t, m in models.items()]
    sizes = data.agg(*[F.count_if(F.col("split") == s).alias(n) for s, n in (("train", "trained"), ("val", "held_out"))])
    return attach(spark.createDataFrame(within, "target string, within_limit boolean"), sizes).select("target", "trained", "held_out", "within_limit")


def scored(spark, d):
    data, names = labelled(spark, d)
    return bundle_for(data, names).predict(data)


@query("mlr2_predict")
def predict(spark, d):
    out = scored(spark, d)
    return out.select("obs_id", *[rounded(f"pred_{t}", 3 if t == "P" else 6).alias(f"pred_{t.lower()}") for t in TARGETS])


@query("mlr2_predicted", f"with {LABELLED_SQL} select split, count(*) as n, count(*) as n_predicted, 0 as n_below_floor from lb group by split")
def predicted(spark, d):
    """Every row gets four finite predictions, and no pressure lies below its floor."""
    all_there = F.lit(True)
    for t in TARGETS:
        all_there = all_there & F.coalesce(F.abs(F.col(f"pred_{t}")) < float("inf"), F.lit(False))
    return scored(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(all_there).alias("n_predicted"), F.count_if(F.col("pred_P") < 1).alias("n_below_floor"))


def errors(spark, d):
    """target, split, y, e of every row and target."""
    parts = [F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), (F.col(f"pred_{t}") - F.col(t)).alias("e")) for t in TARGETS]
    return scored(spark, d).select("split", F.explode(F.array(*parts)).alias("r")).select("split", "r.*")


@query("mlr3_evaluate")
def evaluate(spark, d):
    return mt.basic_by(errors(spark, d), ["target", "split"], F.col("e"))


@query("mlr3_against_mean", f"""with {LABELLED_SQL}, lg as (select split, unnest([{{'target': 'T', 'y': t}}, {{'target': 'P', 'y': p}}], recursive := true) from lb),
    mn as (select target, avg(y) as m from lg where split = 'train' group by target)
    select target, split, count(*) as n, {r("sqrt(avg((y - m)*(y - m)))", 3)} as mean_rmse, true as better from lg join mn using (target) group by target, split""")
def against_mean(spark, d):
    """The error of the training rows' mean beside the model's; temperature and pressure follow from the features, so the model must win."""
    long = errors(spark, d).where("target in ('T', 'P')")
    mean = long.where("split = 'train'").groupBy("target").agg(F.avg("y").alias("m"))
    both = long.join(F.broadcast(mean), "target").groupBy("target", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("m"), 2))).alias("mean_rmse"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return both.select("target", "split", "n", rounded("mean_rmse", 3).alias("mean_rmse"), (F.col("rmse") < F.col("mean_rmse")).alias("better"))


def by_month(spark, d):
    """Rows of three months scored by the models of two; the third falls back to the second."""
    data, names = labelled(spark, d)
    data = data.withColumn("month", F.concat(F.lit("2024-0"), (F.col("obs_id") % 3 + 1)))
    bundles = {m: bundle_for(data.where(F.col("month") == m), names) for m in ("2024-01", "2024-02")}
    return ml.predict_by_month(data, "month", bundles, ["2024-02"])


@query("mlr4_model_by_month")
def model_by_month(spark, d):
    long = by_month(spark, d).select("month", "model_used", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (F.col(f"pred_{t}") - F.col(t)).alias("e")) for t in TARGETS])).alias("r"))
    return mt.basic_by(long.select("month", "model_used", "r.*"), ["month", "model_used", "target"], F.col("e"))


@query("mlr4_month_choice", "select '2024-0' || (obs_id % 3 + 1) as month, case when obs_id % 3 = 0 then '2024-01' else '2024-02' end as model_used, count(*) as n, count(*) as n_predicted from v_obs group by all")
def month_choice(spark, d):
    """Which model scored the rows of each month, and how many rows it scored."""
    return by_month(spark, d).groupBy("month", "model_used").agg(F.count(F.lit(1)).alias("n"), F.count("pred_T").alias("n_predicted"))


def dispatched(spark, d):
    data, names = labelled(spark, d)
    i = F.col("obs_id") % 3
    data = data.withColumn("mode", F.when(i == 0, "exact").when(i == 1, "model").otherwise("hybrid"))
    exact = exact_values(spark, d).select("obs_id", F.col("t_k").alias("T"), F.col("p_pa").alias("P"), F.col("u_mps").alias("U"), F.col("v_mps").alias("V"))
    return ml.predict_by_mode(data, "mode", "obs_id", bundle_for(data, names), exact, TARGETS, F.col("day") % 5 != 0)


@query("mlr5_batch_dispatch")
def batch_dispatch(spark, d):
    out = dispatched(spark, d)
    return out.select("obs_id", "mode", "source", rounded("T").alias("t_k"), rounded("P", 3).alias("p_pa"), rounded("U").alias("u_mps"), rounded("V").alias("v_mps"))


@query("mlr5_dispatched", f"""with {EXACT}, {LABELLED_SQL}, md as (select obs_id, case obs_id % 3 when 0 then 'exact' when 1 then 'model' else 'hybrid' end as mode, obs_id % 3 = 0 or (obs_id % 3 = 2 and day % 5 <> 0) as looked from lb),
    sr as (select obs_id, mode, case when not looked then 'model' when t_k is null then 'no value' else 'exact' end as source, t_k, u_mps from md left join fv using (obs_id))
    select mode, source, count(*) as n, {r("avg(case when source = 'exact' then t_k end)")} as t_k, {r("avg(case when source = 'exact' then u_mps end)")} as u_mps from sr group by mode, source""")
def dispatch_facts(spark, d):
    """Where the rows of each mode were answered, and the means of what the lookup answered."""
    looked = {c: F.avg(F.when(F.col("source") == "exact", F.col(t))) for c, t in (("t_k", "T"), ("u_mps", "U"))}
    return dispatched(spark, d).groupBy("mode", "source").agg(F.count(F.lit(1)).alias("n"), *[rounded(e).alias(c) for c, e in looked.items()])
