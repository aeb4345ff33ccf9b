"""Checks and run records: A-08, A-10, A-11, A-12, K-07, C-12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import quality as Q
from ..plans.file_features import file_features_from
from ..plans.vault_load import vault_tables
from ..sources.fixtures import staged
from . import register
from .sqlkit import with_ctes

RUN_TS = "2024-01-01 00:00:00"


def quality_gate(spark, sf_dir):
    v = vault_tables(spark, sf_dir)
    return Q.post_load_checks(v["dv_hub_application"], v["dv_hub_bureau_credit"], v["dv_sat_app_target"])


register("quality_gate", with_ctes(
    "SELECT (SELECT count(DISTINCT sk_id_curr) FROM stg_application) AS dv_hub_application, "
    "(SELECT count(DISTINCT sk_id_bureau) FROM stg_bureau WHERE sk_id_curr IS NOT NULL) AS dv_hub_bureau_credit, "
    "(SELECT count(*) FROM stg_application WHERE target IS NOT NULL) AS dv_sat_app_target, true AS passed",
    ("stg_application", "stg_bureau")))(quality_gate)


def _raw_requests(spark, sf_dir):
    r = staged(spark, sf_dir, "crm_score_request")
    return r.select("client_id", F.col("age").cast("int").alias("age"), "income", "debt_to_income",
                    F.col("bki_request_cnt").cast("int").alias("bki_request_cnt"),
                    F.col("app_date").cast("string").alias("app_date"))


_RAW_SQL = ("SELECT client_id, CAST(age AS INTEGER) AS age, income, debt_to_income, "
            "CAST(bki_request_cnt AS INTEGER) AS bki_request_cnt, CAST(app_date AS VARCHAR) AS app_date "
            "FROM crm_score_request")
_PIPE_SQL = ("SELECT client_id, age, income, coalesce(debt_to_income, 0.4) AS debt_to_income, bki_request_cnt, "
             "app_date, CASE WHEN coalesce(debt_to_income, 0.4) > 0 AND coalesce(debt_to_income, 0.4) <= 0.3 "
             "THEN 'low' WHEN coalesce(debt_to_income, 0.4) > 0.3 AND coalesce(debt_to_income, 0.4) <= 0.5 "
             "THEN 'medium' WHEN coalesce(debt_to_income, 0.4) > 0.5 AND coalesce(debt_to_income, 0.4) <= 1.0 "
             "THEN 'high' END AS risk_bucket FROM (SELECT DISTINCT * FROM raw)")


def small_pipeline(spark, sf_dir):
    return Q.small_pipeline(_raw_requests(spark, sf_dir))


register("small_pipeline", with_ctes("SELECT * FROM feats", ("crm_score_request",),
                                     raw=_RAW_SQL, feats=_PIPE_SQL))(small_pipeline)


def checksum(spark, sf_dir):
    return Q.content_checksum(small_pipeline(spark, sf_dir))


def _txt(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


register("checksum", with_ctes(
    "SELECT count(*) AS row_count, SUM(CAST(('0x' || substr(md5(concat_ws('|', "
    + ", ".join(_txt(c) for c in ["client_id", "age", "income", "debt_to_income", "bki_request_cnt",
                                  "app_date", "risk_bucket"])
    + ")), 1, 8)) AS BIGINT)) AS checksum FROM feats",
    ("crm_score_request",), raw=_RAW_SQL, feats=_PIPE_SQL))(checksum)


def run_summary(spark, sf_dir):
    train, _ = file_features_from(spark, sf_dir)
    return Q.run_summary(spark, train, RUN_TS)


def _n_features() -> int:
    from .features import _APP_COLS, _CHILD
    return len(_APP_COLS) - 2 + sum(len(nums) + len(cats) for _, _, nums, cats in _CHILD.values())


register("run_summary", with_ctes(
    f"SELECT '{Q.SUMMARY_DATASET}' AS dataset, TIMESTAMP '{RUN_TS}' AS created_at, 'ready' AS status, "
    "(SELECT count(*) FROM stg_application WHERE target IS NOT NULL) AS train_rows, "
    f"{_n_features()} AS train_features, "
    f"'{Q.SUMMARY_SOURCES}' AS source_files", ("stg_application",)))(run_summary)


def table_counts(spark, sf_dir):
    from ..sources.tables import read_table
    names = ("customer", "orders", "lineitem", "nation", "region")
    return Q.table_counts({n: read_table(spark, sf_dir, n) for n in names})


register("table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}"
    for n in ("customer", "lineitem", "nation", "orders", "region")))(table_counts)
