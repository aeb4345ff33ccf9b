"""Model queries: W-05, A-13 (oracle-checked); M-01..M-09, T-04 (rows only:
the boosted-tree numbers have no SQL equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import py_round
from ..operators.ranking import exact_auc, stratified_split
from ..plans import ml as ML
from ..plans.file_features import file_features_from
from ..session import scratch_path
from ..sources.fixtures import staged
from ..sources.tables import read_table
from . import register
from .sqlkit import with_ctes

_MODELS: dict[tuple, object] = {}


def stratified_split_q(spark, sf_dir):
    train, _ = file_features_from(spark, sf_dir)
    return stratified_split(train.select("sk_id_curr", "target"), "target", "sk_id_curr", 0.1, 17)


register("stratified_split", with_ctes(
    "SELECT sk_id_curr, target, row_number() OVER (PARTITION BY target ORDER BY md5('17|' || "
    "CAST(sk_id_curr AS VARCHAR))) <= ceil(0.1 * count(*) OVER (PARTITION BY target)) AS is_validation "
    "FROM stg_application WHERE target IS NOT NULL", ("stg_application",)))(stratified_split_q)


def auc_rank(spark, sf_dir):
    app = staged(spark, sf_dir, "stg_application")
    return exact_auc(app, "target", "ext_source_2")


register("auc_rank", with_ctes(
    "SELECT sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, "
    "CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM ("
    " SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    " AS neg_below FROM (SELECT ext_source_2 AS s, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos, "
    " sum(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS neg FROM stg_application "
    " WHERE target IS NOT NULL AND ext_source_2 IS NOT NULL GROUP BY ext_source_2))",
    ("stg_application",)))(auc_rank)


def auc_rank_distinct(spark, sf_dir):
    """A-13 on a score with about as many values as rows."""
    orders = read_table(spark, sf_dir, "orders")
    return exact_auc(orders.select(F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("y"), "o_totalprice"),
                     "y", "o_totalprice")


register("auc_rank_distinct", """
SELECT sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT o_totalprice AS s, sum(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END) AS neg
            FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_totalprice))""")(auc_rank_distinct)


def _model(spark, sf_dir, train=None):
    key = (spark.sparkContext.applicationId, sf_dir)      # queries of one run share a fit
    if key not in _MODELS:
        train = file_features_from(spark, sf_dir)[0] if train is None else train
        model = ML.train(train, "target")
        path = scratch_path(spark, "gbt_model")
        ML.save(model, path)                       # K-08 round trip
        _MODELS[key] = ML.load(path)
    return _MODELS[key]


def gbt_train_score(spark, sf_dir):
    """M-01..M-06: train on the file features, score the test file."""
    train, test = file_features_from(spark, sf_dir)
    return ML.score(_model(spark, sf_dir, train), test)


register("gbt_train_score")(gbt_train_score)


def gbt_validation_auc(spark, sf_dir):
    """M-03: exact AUC of the model on its own validation part."""
    train, _ = file_features_from(spark, sf_dir)
    flagged = ML.prepare(train).where("is_validation").select("sk_id_curr", "target")
    scored = ML.score(_model(spark, sf_dir, train), train, digits=None).join(flagged, "sk_id_curr")
    auc = exact_auc(scored, "target", "default_probability")
    return auc.withColumn("auc", py_round(F.col("auc"), 4))


register("gbt_validation_auc")(gbt_validation_auc)


def importances_top30(spark, sf_dir):
    """M-08 + T-04."""
    return ML.top_importances(ML.importances(_model(spark, sf_dir), spark), 30)


register("importances_top30")(importances_top30)


def score_export(spark, sf_dir):
    """M-09: test ids with their probability, as the exported file holds them."""
    s = gbt_train_score(spark, sf_dir)
    return s.select("sk_id_curr", F.col("default_probability").alias("target"))


register("score_export")(score_export)
