"""The default model on histogram boosting (M-01 .. M-09), its registry (K-08)
and the explanations of its scores (C-10).

Text columns are encoded once for all (W-02): the classes learned at training
are part of the model.  A stored model is four tables of one version: trees,
features in their order, encoders, metrics.  A version counts once all four are
written and the pointer names it; readers follow the pointer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import boosting as B
from ..operators.features import category_text, encoder_table, fill_minus_one, label_encode, numeric_columns, string_columns
from ..operators.ranking import stratified_split
from ..sources import sinks
from . import explain as X
from .ml import EXCLUDED, SEED, VALIDATION_FRACTION

MODEL_VERSION = "boost-v{}"


@dataclass
class Model:
    forest: B.Forest
    text_columns: list[str]
    #: (column, value, code) of the text columns' classes
    encoders: DataFrame
    version: int = 0

    @property
    def name(self) -> str:
        return MODEL_VERSION.format(self.version)


def feature_columns(df: DataFrame, label: str = "target") -> tuple[list[str], list[str]]:
    ex = (*EXCLUDED, label)
    return [c for c in df.columns if c in numeric_columns(df, exclude=ex) or c in string_columns(df, exclude=ex)], \
        string_columns(df, exclude=ex)


def ready(df: DataFrame, text_columns: list[str], encoders: DataFrame, key: str = "sk_id_curr", label: str = "target") -> DataFrame:
    """M-01 / P-12: text replaced by its code (unseen: -1), gaps by -1."""
    return fill_minus_one(label_encode(df, text_columns, codes=encoders), exclude=(key, label))


def fit(df: DataFrame, label: str = "target", key: str = "sk_id_curr", settings: B.Settings = B.Settings()) -> Model:
    """M-02 / M-03: trained on 90 % of each class, stopped and cut by the AUC of the rest."""
    features, text = feature_columns(df, label)
    known = df.where(F.col(label).isNotNull())
    encoders = encoder_table(known, text).checkpoint()
    # bins are learned from these rows and then made of them: they are joined and split once
    flagged = stratified_split(ready(known, text, encoders, key, label), label, key, VALIDATION_FRACTION, SEED).checkpoint()
    return Model(B.train(flagged, features, label, key, "is_validation", settings), text, encoders)


def score(model: Model, df: DataFrame, key: str = "sk_id_curr", digits: int | None = 4, importances: bool = False) -> DataFrame:
    """M-05 / M-06: probability, prediction flag, confidence and version of
    every row; with ``importances`` also each feature's share of the score,
    signed, of all features in their order, and ``features`` (their values)."""
    lacking = [c for c in model.forest.features if c not in df.columns]
    if lacking:
        raise ValueError(f"scoring input lacks model features: {lacking[:10]}")
    x = ready(df, model.text_columns, model.encoders, key)
    out = B.score(x, model.forest, F.col(key), importances=importances, digits=4)
    p = F.col("probability")
    shown = p if digits is None else D.py_round(p, digits)
    more = ["importances", "features"] if importances else []
    return out.select(key, shown.alias("default_probability"), D.model_prediction(p).alias("predicted_default"),
                      D.model_confidence(p).alias("confidence"), F.lit(model.name).alias("model_version"), *more)


def explain(model: Model, df: DataFrame, mode: str = "detailed", top_k: int = X.TOP_K, key: str = "sk_id_curr") -> DataFrame:
    """C-10 of model scores: decision, text, ranked factors, recommendations."""
    s = score(model, df, key, importances=True).withColumnRenamed(key, "application_id")
    return X.explain(s, mode, top_k)


def with_fallback(model: Model | None, df: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """M-07: the model's scores of the rows it was given; requests that it has
    no row for, or no model at all, take the rule score."""
    rule = X.score_heuristic(requests).select(key, F.col("default_probability").alias("_p"), F.col("confidence").alias("_c"),
                                              F.col("model_version").alias("_v"))
    none = requests.sparkSession.createDataFrame([], f"{key} {requests.schema[key].dataType.simpleString()}, default_probability double, "
                                                     "confidence double, model_version string")
    scored = none if model is None else score(model, df, key).select(*none.columns)
    j = rule.join(scored, key, "left")
    return j.select(key, *[F.coalesce(a, b).alias(a) for a, b in (("default_probability", "_p"), ("confidence", "_c"), ("model_version", "_v"))])


def auc_rounds(spark: SparkSession, model: Model) -> DataFrame:
    """(round, auc, kept) of the validation rows."""
    rows = [(i, a, i <= len(model.forest.trees)) for i, a in enumerate(model.forest.auc, 1)]
    return spark.createDataFrame(rows, "round int, auc double, kept boolean")


def importances(spark: SparkSession, model: Model) -> DataFrame:
    """M-08."""
    return spark.createDataFrame(B.global_importances(model.forest), "feature string, importance double")


# the registry (K-08)

_CACHE: dict[tuple[str, str, int], Model] = {}
METRICS = "name string, value double"


def register_model(spark: SparkSession, root: str, model: Model, metrics: dict[str, float] | None = None) -> int:
    """Store a model as the next version and point to it; returns the version.
    A version that failed before the pointer was written is written anew."""
    root = root.rstrip("/")
    version = current_version(spark, root) + 1
    f = model.forest
    found = {"features": float(len(f.features)), "trees": float(len(f.trees))} | (metrics or {})
    kept = [a for a in f.auc[:len(f.trees)] if a is not None]
    if kept:
        found.setdefault("validation_auc", kept[-1])
    tables = {
        "trees": spark.createDataFrame(f.rows(), B.ROWS),
        "features": spark.createDataFrame([(i, c, c in model.text_columns) for i, c in enumerate(f.features)],
                                          "position int, feature string, is_text boolean"),
        "encoders": model.encoders,
        "metrics": spark.createDataFrame(sorted(found.items()), METRICS),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    sinks.write_version(spark.createDataFrame([(version,)], "version int"), f"{root}/current", version)
    return version


def current_version(spark: SparkSession, root: str) -> int:
    """The version that the pointer names, 0 if there is none."""
    return (sinks.versions(spark, f"{root.rstrip('/')}/current") or [0])[-1]


def load_model(spark: SparkSession, root: str, version: int | None = None) -> Model:
    """A stored model, by default the current one; read once per version."""
    root = root.rstrip("/")
    version = version or current_version(spark, root)
    if not version:
        raise FileNotFoundError(f"no model in {root}")
    at = (spark.sparkContext.applicationId, root, version)
    if at not in _CACHE:
        table = lambda name: spark.read.parquet(f"{root}/version={version}/{name}")
        features = sorted(table("features").collect(), key=lambda r: r["position"])
        forest = B.forest_of([tuple(r) for r in table("trees").collect()], [r["feature"] for r in features])
        _CACHE[at] = Model(forest, [r["feature"] for r in features if r["is_text"]], table("encoders"), version)
    return _CACHE[at]


def check_order(model: Model, features: list[str]) -> None:
    """Refuse features that are not the model's, in its order."""
    if list(features) != model.forest.features:
        odd = next((i for i, (a, b) in enumerate(zip(features, model.forest.features)) if a != b), min(len(features), len(model.forest.features)))
        raise ValueError(f"{model.name} was trained on other features or another order, from position {odd} on")


def registry(spark: SparkSession, root: str) -> DataFrame:
    """(version, is_current, name, value): the metrics of all versions that the
    pointer ever named."""
    root = root.rstrip("/")
    known = sinks.versions(spark, f"{root}/current")
    out = spark.createDataFrame([], f"version int, is_current boolean, {METRICS}")
    if not known:
        return out
    stored = spark.read.option("basePath", root).parquet(*[f"{root}/version={v}/metrics" for v in known])
    return stored.select(F.col("version").cast("int"), (F.col("version") == known[-1]).alias("is_current"), "name", "value")
