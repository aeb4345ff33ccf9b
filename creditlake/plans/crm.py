"""CRM views and writes (A-09, T-01, T-02, J-07, J-09, P-16, K-04, C-13).

The CRM tables are small compared to the vault, but every operation is
still a DataFrame job: one-to-one relations are kept by upserts (latest row
per key by time, then id), lists are joins, the dashboard is one row of
scalar aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..sources.fixtures import staged
from . import explain as X

SCORED_AT = "2024-01-01 00:00:00"
RESCORED_AT = "2024-02-01 00:00:00"


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "crm_score_request")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "crm_client")


def scoring_info(apps: DataFrame, generated_at: str = SCORED_AT, model_version: str | None = None) -> DataFrame:
    """Score records of whatever applications are given."""
    s = X.score_heuristic(apps)
    mv = F.lit(model_version) if model_version else F.col("model_version")
    return s.select("application_id", "default_probability", mv.alias("model_version"), "confidence",
                    "importances", F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"))


def tagged_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each frame: the frames are reduced to a
    tag column, unioned and counted in a single (partial) aggregation."""
    u = None
    for tag, df in frames.items():
        t = df.select(F.lit(tag).alias("_t"))
        u = t if u is None else u.unionByName(t)
    return u.agg(*[F.count(F.when(F.col("_t") == tag, 1)).alias(tag) for tag in frames])


def dashboard(apps: DataFrame, cl: DataFrame, scores: DataFrame) -> DataFrame:
    """A-09: one row of three scalar aggregates."""
    return tagged_counts({"total_applications": apps, "total_clients": cl, "scored_applications": scores})


def recent(apps: DataFrame, n: int = 5) -> DataFrame:
    """T-01: the n most recent applications (date desc, id desc breaks ties)."""
    return apps.orderBy(F.col("app_date").desc(), F.col("application_id").desc()).limit(n).select(
        "application_id", "client_id", "app_date")


def application_list(apps: DataFrame, cl: DataFrame, scores: DataFrame) -> DataFrame:
    """T-02 + J-07: applications with their client (inner) and score (left)."""
    j = (apps.select("application_id", "client_id", "app_date")
         .join(cl.select("client_id", "education", "sex", "age", "income"), "client_id")
         .join(scores.select("application_id", "default_probability", "model_version"), "application_id", "left"))
    return j.select("application_id", "client_id", "app_date", "education", "sex", "age",
                    F.col("income").alias("client_income"), "default_probability", "model_version",
                    D.risk_band(F.col("default_probability")).alias("risk_band")).orderBy(
        F.col("app_date").desc(), F.col("application_id").desc())


def detail(listing: DataFrame, application_id=None) -> DataFrame:
    """P-16: one application with client and score.  Without an id, the
    latest application is looked up (id found by an aggregate, then a
    semi-join: no driver round trip)."""
    if application_id is not None:
        return listing.where(F.col("application_id") == application_id)
    key = listing.agg(F.max(F.struct("app_date", "application_id")).alias("k")).select(
        F.col("k.application_id").alias("application_id"))
    return listing.join(key, "application_id", "left_semi")


def upsert_latest(current: DataFrame, batch: DataFrame, key: str, ts: str) -> DataFrame:
    """K-04: ``update_or_create`` on ``key``: the union of stored rows and
    the new batch, latest ``ts`` per key.  The window is partitioned by the
    key, so a skewed key costs no more than its own rows.  Of equal times the
    batch wins, and within it the greatest hash of the row."""
    u = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("_new").desc(), F.xxhash64(*current.columns).desc())
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def intake_records(apps: DataFrame, cl: DataFrame) -> DataFrame:
    """A nested application record per request, as the intake form posts it."""
    req = apps.select("application_id", "client_id", "app_date",
                      F.col("income").alias("req_income"), "debt_to_income")
    j = req.join(cl, "client_id")
    return j.select(
        "application_id",
        F.struct("education", "sex", "age", "car", "car_type", "income", "foreign_passport").alias("client"),
        F.struct("decline_app_cnt", "good_work", "bki_request_cnt").alias("financial_profile"),
        F.struct("home_address", "first_time").alias("behavioral_context"),
        F.struct("app_date").alias("application"),
        F.struct(F.col("req_income").alias("income"), "debt_to_income").alias("features"),
    )


def split_intake(records: DataFrame) -> dict[str, DataFrame]:
    """C-13: one nested frame -> four CRM tables sharing the new client id
    (the form creates a client per application)."""
    cid = F.col("application_id").alias("client_id")
    return {
        "clients": records.select(cid, "client.*"),
        "financial_profiles": records.select(cid, "financial_profile.*"),
        "behavioral_contexts": records.select(cid, "behavioral_context.*"),
        "applications": records.select("application_id", cid, "application.app_date"),
    }
