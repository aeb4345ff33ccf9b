"""Default model: preprocessing, boosted trees, scoring, importances
(M-01 .. M-09, W-05, A-13, A-14, T-04) with Spark MLlib.

The reference trains CatBoost; MLlib's GBTClassifier is a different
algorithm (no L2 leaf term, early stop by validation loss, not AUC), so
probabilities are not claimed equal to the reference's.  The contract is
kept: probability, 0/1 prediction, confidence, ranked importances.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators.features import fill_minus_one, numeric_columns, string_columns
from ..operators.ranking import stratified_split
from ..session import ensure_checkpoint_dir
from . import explain as X

# ---- fixed values: training parameters of the reference model ----
ITERATIONS = 1000
LEARNING_RATE = 0.1
DEPTH = 7
SUBSAMPLE = 0.7
POSITIVE_WEIGHT = 5.0
VALIDATION_FRACTION = 0.1
SEED = 17
EXCLUDED = ("sk_id_curr", "target", "record_source", "load_dts", "update_dts")   # D15
MODEL_VERSION = "gbt-v1"
MIN_BINS = 64


def feature_columns(df: DataFrame, label: str = "target", exclude=EXCLUDED) -> tuple[list[str], list[str]]:
    ex = set(exclude) | {label}
    return numeric_columns(df, exclude=tuple(ex)), string_columns(df, exclude=tuple(ex))


def preprocess_pipeline(num_cols: list[str], cat_cols: list[str]) -> list:
    """M-01: text columns indexed alphabetically (unseen -> extra index),
    all features assembled in a fixed order."""
    stages = []
    idx_cols = []
    for c in cat_cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        idx_cols.append(f"{c}__idx")
    stages.append(VectorAssembler(inputCols=num_cols + idx_cols, outputCol="features", handleInvalid="keep"))
    return stages


def prepare(df: DataFrame, label: str = "target") -> DataFrame:
    """Fill numeric gaps with -1, null text as the category 'nan', label as
    double, weight 5 on positives, stratified validation flag (W-05)."""
    num, cat = feature_columns(df, label)
    out = fill_minus_one(df, exclude=("sk_id_curr", label))
    out = out.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) if c in cat else F.col(c) for c in out.columns])
    out = out.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    out = out.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(POSITIVE_WEIGHT)).otherwise(F.lit(1.0)))
    return stratified_split(out, label, "sk_id_curr", VALIDATION_FRACTION, SEED)


def train(df: DataFrame, label: str = "target", max_iter: int = ITERATIONS) -> PipelineModel:
    """M-02: boosted trees with the reference's depth, rate, subsample,
    seed, positive weight and a 10 % stratified validation set."""
    # the iterative fit reads its input many times: cut the lineage once with a
    # reliable checkpoint in the shared checkpoint folder (survives executor loss)
    ensure_checkpoint_dir(df.sparkSession)
    prepared = prepare(df, label).checkpoint(eager=True)
    num, cat = feature_columns(df, label)
    ready = Pipeline(stages=preprocess_pipeline(num, cat)).fit(prepared)
    # a text column needs a bin for each of its values and one for unseen ones
    widest = max([len(m.labels) + 1 for m in ready.stages if isinstance(m, StringIndexerModel)], default=0)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                        maxIter=max_iter, stepSize=LEARNING_RATE, maxDepth=DEPTH,
                        subsamplingRate=SUBSAMPLE, seed=SEED, validationIndicatorCol="is_validation",
                        maxBins=max(MIN_BINS, widest), checkpointInterval=10)
    return PipelineModel(stages=[*ready.stages, gbt.fit(ready.transform(prepared))])


def score(model: PipelineModel, df: DataFrame, key: str = "sk_id_curr", digits: int | None = 4) -> DataFrame:
    """M-05: probability of default (rounded to ``digits`` places, as it is
    served; None for the raw value), and from the raw value the prediction
    flag (p >= 0.5) and the confidence."""
    num_cols = [c for c in model.stages[-2].getInputCols() if not c.endswith("__idx")]
    cat_cols = [s.getInputCol() for s in model.stages if isinstance(s, StringIndexerModel)]
    x = fill_minus_one(df, exclude=(key, "target"))
    x = x.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) if c in cat_cols else F.col(c) for c in x.columns])
    missing = [c for c in num_cols + cat_cols if c not in x.columns]
    if missing:
        raise ValueError(f"scoring input lacks model features: {missing[:10]}")
    p = vector_to_array(F.col("probability"))[1]
    out = model.transform(x)
    shown = p if digits is None else D.py_round(p, digits)
    return out.select(key, shown.alias("default_probability"),
                      D.model_prediction(p).alias("predicted_default"),
                      D.model_confidence(p).alias("confidence"),
                      F.lit(MODEL_VERSION).alias("model_version"))


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """M-08: global importances as a (feature, importance) table."""
    names = model.stages[-2].getInputCols()
    vals = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n[:-5] if n.endswith("__idx") else n, float(v)) for n, v in zip(names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importances(imp: DataFrame, k: int = 30) -> DataFrame:
    """T-04: the k largest (ties: name descending, as the reference's sort)."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature").desc()).limit(k)


def with_fallback(model_scores: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """M-07: rows the model could not score take the rule score; the
    ``model_version`` says which one answered."""
    h = X.score_heuristic(requests).select(
        key, F.col("default_probability").alias("h_p"), F.col("confidence").alias("h_c"),
        F.col("model_version").alias("h_v"))
    j = h.join(model_scores, key, "left")
    return j.select(key,
                    F.coalesce("default_probability", "h_p").alias("default_probability"),
                    F.coalesce("confidence", "h_c").alias("confidence"),
                    F.coalesce("model_version", "h_v").alias("model_version"))


def save(model: PipelineModel, path: str) -> None:
    """K-08: persisted with MLlib's writer (shared folder on a cluster)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_pipeline(spark: SparkSession, train_df: DataFrame, model_path: str, label: str = "target",
                   max_iter: int = ITERATIONS, trained_at: str | None = None) -> tuple[PipelineModel | None, DataFrame]:
    """M-04: train -> evaluate on the validation part -> save; returns the
    model and a one-row result (success, features, validation AUC, path,
    error).  A failure is reported in the row instead of raised."""
    from ..operators.ranking import exact_auc
    ts = F.lit(trained_at).cast("timestamp_ntz") if trained_at else F.current_timestamp().cast("timestamp_ntz")
    try:
        model = train(train_df, label, max_iter)
        save(model, model_path)
        n_features = len(model.stages[-2].getInputCols())
        flagged = prepare(train_df, label).where("is_validation").select("sk_id_curr", label)
        auc = exact_auc(score(model, train_df).join(flagged, "sk_id_curr"), label, "default_probability")
        row = auc.select(F.lit(True).alias("success"), F.lit(n_features).alias("feature_count"),
                         F.col("auc").alias("validation_auc"), F.lit(model_path).alias("model_path"),
                         F.lit(None).cast("string").alias("error"), ts.alias("trained_at"))
        return model, row
    except Exception as exc:  # noqa: BLE001  (reported, as the reference's pipeline does)
        row = spark.range(1).select(F.lit(False).alias("success"), F.lit(0).alias("feature_count"),
                                    F.lit(None).cast("double").alias("validation_auc"),
                                    F.lit(model_path).alias("model_path"),
                                    F.lit(str(exc)[:500]).alias("error"), ts.alias("trained_at"))
        return None, row
