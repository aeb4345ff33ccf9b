"""Data checks and run records (A-08 .. A-12, A-15, K-06, K-07, C-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decisions import risk_bucket
from ..functions.pytext import py_str
from ..operators.conform import fill_nulls, require_columns

# ---- fixed values ----
EXPECTED_REQUEST_COLUMNS = ["client_id", "age", "income", "debt_to_income", "bki_request_cnt", "app_date"]
SUMMARY_DATASET = "homecredit_training_raw_files"
SUMMARY_SOURCES = "application_train.csv, bureau.csv, credit_card_balance.csv, POS_CASH_balance.csv, previous_application.csv"
REQUIRED_FILES = ("application_train", "application_test", "bureau", "bureau_balance", "previous_application",
                  "installments_payments", "credit_card_balance", "pos_cash_balance")


def post_load_checks(hub_app: DataFrame, hub_bureau: DataFrame, sat_target: DataFrame) -> DataFrame:
    """A-10: three counts in one row; the job fails (at run time, on the
    executors) when the application hub is empty."""
    from .crm import tagged_counts
    row = tagged_counts({"dv_hub_application": hub_app, "dv_hub_bureau_credit": hub_bureau,
                         "dv_sat_app_target": sat_target})
    ok = F.col("dv_hub_application") >= 1
    return row.withColumn("passed", F.when(ok, F.lit(True)).otherwise(
        F.raise_error(F.lit("no applications in the vault (dv_hub_application is empty)")).cast("boolean")))


def content_checksum(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A-12: order-free checksum: row count plus the sum of the first 32
    bits of each row's md5 (Python text of each value, '|' separated)."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    text = F.concat_ws("|", *[F.coalesce(py_str(F.col(c), types[c]), F.lit("")) for c in cols])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(part).alias("checksum"))


def require_inputs(available, required=REQUIRED_FILES) -> None:
    """A-15: fail with the list of all missing inputs."""
    missing = [r for r in required if r not in set(available)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


def small_pipeline(raw: DataFrame) -> DataFrame:
    """C-12: validate -> distinct -> fill -> bucket.  Returns the feature rows."""
    require_columns(raw, EXPECTED_REQUEST_COLUMNS, "raw requests")
    clean = fill_nulls(raw.select(*EXPECTED_REQUEST_COLUMNS).distinct(), {"debt_to_income": 0.4})
    return clean.withColumn("risk_bucket", risk_bucket(F.col("debt_to_income")))


def shape(df: DataFrame, exclude=()) -> DataFrame:
    """A-11: (rows, features) of a frame."""
    n = len([c for c in df.columns if c not in exclude])
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("features", F.lit(n))


def run_summary(spark: SparkSession, features: DataFrame, created_at: str,
                exclude=("sk_id_curr", "target")) -> DataFrame:
    """K-07: one summary row of a feature build."""
    s = shape(features, exclude)
    return s.select(F.lit(SUMMARY_DATASET).alias("dataset"),
                    F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
                    F.lit("ready").alias("status"),
                    F.col("rows").alias("train_rows"), F.col("features").alias("train_features"),
                    F.lit(SUMMARY_SOURCES).alias("source_files"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-08 over several tables: (table_name, rows)."""
    out = None
    for name, df in sorted(tables.items()):
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


