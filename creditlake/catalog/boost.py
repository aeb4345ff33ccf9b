"""Queries of the histogram-boosted model (M-02, M-06 .. M-08, C-10, K-08).
Trees are trained, so there is no SQL for them; tests compare them with a plain
walk over the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import py_round
from ..plans import boost as B
from ..plans.file_features import file_features_from
from ..plans.ml import top_importances
from ..session import scratch_path
from ..sources.fixtures import staged
from . import register

_STORES: dict[tuple, str] = {}


def _store(spark, sf_dir, train=None) -> str:
    """Folder of a registry with one model trained on the file features (built
    here if they are not given); the queries of one run share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        train = file_features_from(spark, sf_dir)[0] if train is None else train
        root = scratch_path(spark, "models")
        B.register_model(spark, root, B.fit(train))
        _STORES[key] = root
    return _STORES[key]


def _model(spark, sf_dir, train=None) -> B.Model:
    return B.load_model(spark, _store(spark, sf_dir, train))


def boost_train_score(spark, sf_dir):
    """M-01 .. M-06: train on the file features, store, load, score the test file."""
    train, test = file_features_from(spark, sf_dir)
    return B.score(_model(spark, sf_dir, train), test)


def boost_auc_rounds(spark, sf_dir):
    """M-02 / M-03: validation AUC by round of a fit, with the rounds that were kept."""
    train, _ = file_features_from(spark, sf_dir)
    rounds = B.auc_rounds(spark, B.fit(train))
    return rounds.withColumn("auc", py_round(F.col("auc"), 4))


def boost_importances_top30(spark, sf_dir):
    """M-08 / T-04 of the stored model."""
    return top_importances(B.importances(spark, _model(spark, sf_dir)), 30)


def model_explain(spark, sf_dir):
    """C-10 / M-06: every application of the test file scored by the stored
    model and explained by its own factors, signed and ranked."""
    train, test = file_features_from(spark, sf_dir)
    return B.explain(_model(spark, sf_dir, train), test)


def model_fallback(spark, sf_dir):
    """M-07: requests of clients in the test file are scored by the model, all
    others by the rule."""
    train, test = file_features_from(spark, sf_dir)
    requests = staged(spark, sf_dir, "crm_score_request")
    asked = requests.select("application_id", F.col("client_id").alias("sk_id_curr")).join(test, "sk_id_curr")
    return B.with_fallback(_model(spark, sf_dir, train), asked.drop("sk_id_curr"), requests, "application_id")


def model_registry(spark, sf_dir):
    """K-08: two fits stored one after the other; versions, pointer and metrics."""
    train, _ = file_features_from(spark, sf_dir)
    root = scratch_path(spark, "models")
    for rounds in (2, 3):
        B.register_model(spark, root, B.fit(train, settings=B.B.Settings(rounds=rounds)))
    return B.registry(spark, root).withColumn("value", py_round(F.col("value"), 4))


for _f in (boost_train_score, boost_auc_rounds, boost_importances_top30, model_explain, model_fallback, model_registry):
    register(_f.__name__)(_f)
