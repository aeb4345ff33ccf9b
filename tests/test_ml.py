"""Model path (rows-only in the driver check): train, persist, score, fall back."""

from pyspark.sql import functions as F

from creditlake.plans import ml as ML
from creditlake.plans.file_features import file_features_from
from creditlake.sources.fixtures import staged
from tests.conftest import SF001


def test_train_score_importances(spark, tmp_path):
    train, test = file_features_from(spark, SF001)
    model = ML.train(train, "target", max_iter=3)
    ML.save(model, str(tmp_path / "m"))
    model = ML.load(str(tmp_path / "m"))
    scored = ML.score(model, test)
    rows = scored.collect()
    assert len(rows) == test.count()
    assert all(0.0 <= r.default_probability <= 1.0 for r in rows)
    assert all(r.predicted_default == (r.default_probability >= 0.5) for r in rows)
    assert all(0.65 <= r.confidence <= 0.99 for r in rows)
    imp = ML.top_importances(ML.importances(model, spark), 30).collect()
    assert 0 < len(imp) <= 30 and abs(sum(r.importance for r in ML.importances(model, spark).collect()) - 1) < 1e-6


def test_fallback_fills_unscored(spark):
    req = staged(spark, SF001, "crm_score_request").withColumnRenamed("application_id", "k")
    model_scores = req.where(F.col("k") % 2 == 0).select(
        "k", F.lit(0.5).alias("default_probability"), F.lit(0.65).alias("confidence"),
        F.lit("gbt-v1").alias("model_version"))
    out = ML.with_fallback(model_scores, req, "k")
    versions = {r.model_version for r in out.collect()}
    assert versions == {"gbt-v1", "heuristic-v1"} and out.count() == req.count()


def test_train_pipeline_reports(spark, tmp_path):
    train, _ = file_features_from(spark, SF001)
    model, row = ML.train_pipeline(spark, train, str(tmp_path / "m"), max_iter=2, trained_at="2024-01-01 00:00:00")
    r = row.first()
    assert model is not None and r.success and r.feature_count > 10 and 0.0 <= r.validation_auc <= 1.0
    _, bad = ML.train_pipeline(spark, train.drop("target"), str(tmp_path / "x"), max_iter=2)
    assert bad.first().success is False and bad.first().error
