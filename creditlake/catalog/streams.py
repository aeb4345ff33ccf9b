"""Streaming queries, checked against their batch equivalents (R-01, R-02)."""

from __future__ import annotations

from ..operators.conform import conform
from ..schemas import DATASETS
from ..session import scratch_path
from ..sources import buckets
from ..sources import csv as CSV
from ..sources.fixtures import staged
from ..streaming import jobs as S
from . import register
from .explain import SCORE_CTES
from .sources import _typed_bureau_sql
from .sqlkit import with_ctes


def stream_ingest(spark, sf_dir):
    """R-01: bureau files arrive in a folder; one availableNow run types and
    lands them; the landed table is read back."""
    root = scratch_path(spark, "stream_ingest")
    df = conform(staged(spark, sf_dir, "stg_bureau"), DATASETS["bureau"])
    CSV.write_csv(df, f"{root}/in")
    q = S.ingest_csv_stream(spark, "bureau", f"{root}/in", f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id")


register("stream_ingest", _typed_bureau_sql())(stream_ingest)


def stream_score(spark, sf_dir):
    """R-02: score and explain every arriving request; the maintained table has
    the latest result per application."""
    root = scratch_path(spark, "stream_score")
    S.score_stream(spark, sf_dir, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return buckets.read(spark, f"{root}/out")


# the rule score and explanation of the latest request of each application
_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY requested_at DESC, request_id DESC) AS rn
FROM stream_score_request) WHERE rn = 1"""
_REQUEST = """SELECT application_id, income, CAST(NULL AS DOUBLE) AS age, CAST(NULL AS DOUBLE) AS debt_to_income,
       CAST(NULL AS DOUBLE) AS bki_request_cnt FROM latest"""
register("stream_score", with_ctes(
    "SELECT l.request_id, e.application_id, l.requested_at, e.default_probability, s.confidence, e.model_version, e.decision, "
    "e.base_text AS explanation_text, e.key_factors, e.recommendations, e.confidence AS explanation_confidence "
    "FROM expl e JOIN latest l USING (application_id) JOIN scored s USING (application_id)",
    ("stream_score_request",), latest=_LATEST, crm_score_request=_REQUEST, **SCORE_CTES))(stream_score)
