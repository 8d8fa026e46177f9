"""Boosted trees per weather variable on Spark ML: fit, predict back in physical units, choose by month, dispatch by mode."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from gridweather import session
from gridweather.functions.scalars import log_target, unlog_target

# Settings per variable. Leaf-count limits become depth limits (2^7 = 128 leaves, 2^8 = 256).
TREE_SETTINGS = {
    "T": {"stepSize": 0.035, "maxIter": 900, "maxDepth": 7, "minInstancesPerNode": 48, "maxBins": 255, "seed": 42},
    "P": {"stepSize": 0.035, "maxIter": 900, "maxDepth": 7, "minInstancesPerNode": 64, "maxBins": 255, "seed": 42},
    "U": {"stepSize": 0.03, "maxIter": 1200, "maxDepth": 8, "minInstancesPerNode": 32, "maxBins": 255, "seed": 42},
    "V": {"stepSize": 0.03, "maxIter": 1200, "maxDepth": 8, "minInstancesPerNode": 32, "maxBins": 255, "seed": 42},
}
LOG_TARGETS = {"P"}
LOG_EPS = 1e-9


@dataclass(frozen=True)
class TreeBundle:
    features: list[str]
    models: dict[str, GBTRegressionModel] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``pred_<target>`` for every target; a log target comes back in its own unit and never below 1."""
        out = VectorAssembler(inputCols=self.features, outputCol="_features").transform(df)
        for name, model in self.models.items():
            out = model.copy({model.predictionCol: f"pred_{name}"}).transform(out)
            if name in LOG_TARGETS:
                out = out.withColumn(f"pred_{name}", unlog_target(F.col(f"pred_{name}")))
        return out.drop("_features")


def fit_trees(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    *,
    settings: dict[str, dict] | None = None,
    weights: dict[str, str] | None = None,
    held_out: str | None = None,
    **override,
) -> TreeBundle:
    """One boosted model per target, with its own settings and, if named, its own row weights.

    ``held_out`` names a boolean column; its true rows stop the boosting early instead of being trained on.
    """
    session.checkpoint_folder(df.sparkSession)
    made = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    for name in targets:
        label = log_target(F.col(name), LOG_EPS) if name in LOG_TARGETS else F.col(name)
        made = made.withColumn(f"_label_{name}", label)
    keep = ["_features", *[f"_label_{n}" for n in targets], *set((weights or {}).values()), *([held_out] if held_out else [])]
    # The same rows are read by every boosting round of every model; they spill to disk where memory is short.
    data = made.select(*keep).persist()
    models = {}
    try:
        for name in targets:
            params = {**(settings or TREE_SETTINGS)[name], **override}
            trees = GBTRegressor(featuresCol="_features", labelCol=f"_label_{name}", cacheNodeIds=False, **params)
            if weights and name in weights:
                trees = trees.setWeightCol(weights[name])
            if held_out:
                trees = trees.setValidationIndicatorCol(held_out)
            models[name] = trees.fit(data)
    finally:
        data.unpersist()
    return TreeBundle(features, models)


def predict_by_month(df: DataFrame, month: str, bundles: dict[str, TreeBundle], fallbacks: list[str]) -> DataFrame:
    """Score every row with the model of its own month, else with the first fallback there is; ``model_used`` says which."""
    last = next((f for f in fallbacks if f in bundles), None)
    chosen = F.when(F.col(month).isin(list(bundles)), F.col(month)).otherwise(F.lit(last))
    named = df.withColumn("model_used", chosen)
    if last is None and not named.where("model_used is null").isEmpty():
        raise ValueError("a row has no model for its month and there is no fallback")
    parts = [bundle.predict(named.where(F.col("model_used") == name)) for name, bundle in bundles.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def predict_by_mode(df: DataFrame, mode: str, ident: str, bundle: TreeBundle, exact: DataFrame, targets: list[str], has_day: Column) -> DataFrame:
    """Model rows in one batch; exact rows by lookup; hybrid rows by lookup where their day is stored, else by the model."""
    by_lookup = (F.col(mode) == "exact") | ((F.col(mode) == "hybrid") & has_day)
    scored = bundle.predict(df.where(~by_lookup)).withColumn("source", F.lit("model"))
    scored = scored.select(ident, mode, "source", *[F.col(f"pred_{t}").alias(t) for t in targets])
    looked = df.where(by_lookup).select(ident, mode).join(exact.select(ident, *targets), ident, "left")
    looked = looked.withColumn("source", F.when(F.col(targets[0]).isNull(), "no value").otherwise("exact"))
    return scored.unionByName(looked.select(ident, mode, "source", *targets))
