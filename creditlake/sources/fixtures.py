"""Adapters from the driver tables to reference-shaped staging tables.

Each adapter is one SQL text with ``{table}`` placeholders.  Spark runs it with
``spark.sql(text, table=DataFrame)`` (no global temp views), and the DuckDB
oracle runs the very same text with plain table names, so an adapter and its
oracle cannot drift apart.  Null injection by key modulo is part of the
fixture definition (it creates nulls the driver data lacks); it never filters
rows away.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

ADAPTERS: dict[str, str] = {
    "stg_application": """
SELECT c_custkey AS sk_id_curr,
       CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target,
       c_mktsegment AS name_contract_type,
       CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE NULL END AS code_gender,
       CAST(c_custkey % 5 AS INT) AS cnt_children,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS amt_income_total,
       c_acctbal * 3 AS amt_credit,
       c_acctbal / 4 AS amt_annuity,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal * 2 END AS amt_goods_price,
       CAST(1 + c_custkey % 6 AS DOUBLE) AS cnt_fam_members,
       CAST(c_custkey % 24 AS DOUBLE) AS hour_appr_process_start,
       1 AS flag_mobil, CAST(c_custkey % 2 AS INT) AS flag_email,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS DOUBLE) END AS amt_req_credit_bureau_hour,
       CAST(c_custkey % 12 AS DOUBLE) AS amt_req_credit_bureau_year,
       CAST(c_custkey % 997 AS DOUBLE) / 997 AS ext_source_2,
       CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) / 100 END AS ext_source_3,
       n_name AS organization_type,
       CAST(n_regionkey + 1 AS INT) AS region_rating_client,
       CAST(-7000 - c_custkey % 15000 AS INT) AS days_birth,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 1000 AS DOUBLE) / 1000 END AS ext_source_1,
       CAST(c_custkey % 2 AS INT) AS flag_document_2,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 1 END AS flag_document_10,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 50 AS DOUBLE) / 50 END AS apartments_avg,
       'PENDING_MIGRATION' AS internal_sync_token
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "stg_bureau": """
SELECT o_orderkey AS sk_id_bureau, o_custkey AS sk_id_curr,
       o_orderstatus AS credit_active,
       CAST((year(o_orderdate) - 2002) * 365 + dayofyear(o_orderdate) AS INT) AS days_credit,
       o_totalprice AS amt_credit_sum,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS amt_credit_sum_debt,
       CAST(o_orderkey % 3 AS DOUBLE) AS amt_credit_sum_overdue,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 900 AS DOUBLE) END AS days_credit_enddate,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS credit_type
FROM {orders}""",
    "stg_bureau_balance": """
SELECT l_orderkey AS sk_id_bureau, CAST(-l_linenumber AS INT) AS months_balance, l_linestatus AS status
FROM {lineitem}""",
    "stg_previous_application": """
SELECT o_orderkey AS sk_id_prev, o_custkey AS sk_id_curr,
       o_totalprice AS amt_application,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amt_credit,
       o_totalprice / 8 AS amt_annuity, o_totalprice / 16 AS amt_down_payment, o_totalprice / 2 AS amt_goods_price,
       o_orderstatus AS name_contract_status, o_orderpriority AS name_product_type,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS name_payment_type
FROM {orders}""",
    "stg_pos_cash_balance": """
SELECT l_orderkey AS sk_id_prev, o_custkey AS sk_id_curr, CAST(-l_linenumber AS INT) AS months_balance,
       l_quantity AS cnt_instalment, l_quantity - l_linenumber AS cnt_instalment_future,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS name_contract_status,
       CAST(floor(l_discount * 100 + 0.5) AS INT) AS sk_dpd,
       CAST(floor(l_tax * 100 + 0.5) AS INT) AS sk_dpd_def
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "stg_credit_card_balance": """
SELECT l_orderkey AS sk_id_prev, o_custkey AS sk_id_curr, CAST(-l_linenumber AS INT) AS months_balance,
       l_extendedprice AS amt_balance, o_totalprice AS amt_credit_limit_actual,
       CAST(floor(l_discount * 100 + 0.5) AS INT) AS sk_dpd, CAST(floor(l_tax * 100 + 0.5) AS INT) AS sk_dpd_def,
       l_linestatus AS name_contract_status
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "stg_installments_payments": """
SELECT l_orderkey AS sk_id_prev, 1 AS num_instalment_version, l_linenumber AS num_instalment_number,
       CAST((year(l_shipdate) - 2002) * 365 + dayofyear(l_shipdate) AS INT) AS days_instalment,
       l_extendedprice AS amt_instalment, l_extendedprice * (1 - l_discount) AS amt_payment
FROM {lineitem}""",
    "crm_client": """
SELECT c_custkey AS client_id, c_mktsegment AS education,
       CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex, CAST(20 + c_custkey % 50 AS INT) AS age,
       c_custkey % 3 = 0 AS car, c_custkey % 6 = 0 AS car_type, CAST(c_acctbal AS DECIMAL(12,2)) AS income,
       c_custkey % 5 = 0 AS foreign_passport,
       CAST(c_custkey % 4 AS INT) AS decline_app_cnt, c_custkey % 7 <> 0 AS good_work,
       CAST(c_custkey % 7 AS INT) AS bki_request_cnt, n_name AS home_address, c_custkey % 2 = 0 AS first_time
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "crm_score_request": """
SELECT o_orderkey AS application_id, o_custkey AS client_id, CAST(o_orderdate AS DATE) AS app_date,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS income,
       CAST(20 + o_custkey % 50 AS DOUBLE) AS age,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 120 AS DOUBLE) / 100 END AS debt_to_income,
       CAST(o_orderkey % 7 AS DOUBLE) AS bki_request_cnt
FROM {orders}""",
    "stream_score_request": """
SELECT event_id AS request_id, user_id AS application_id, ts AS requested_at,
       value * 1000 AS income, event_type AS channel, props
FROM {events}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def adapter_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(ADAPTERS[name])))


# adapters whose rows feed per-row heavy work (scoring, explanation text)
# directly, with no shuffle in between: their scans are spread over all cores
WIDE_ADAPTERS = {"crm_score_request", "stream_score_request"}


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run adapter ``name`` over the driver tables in ``sf_dir``."""
    text = ADAPTERS[name]
    frames = {t: read_table(spark, sf_dir, t, wide=name in WIDE_ADAPTERS) for t in adapter_tables(name)}
    return spark.sql(text, **frames)


def adapter_sql(name: str) -> str:
    """The adapter text with plain table names (DuckDB / any SQL engine)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), ADAPTERS[name])



_OUT_ALIAS = re.compile(r"\bAS\s+(\w+)\s*(?=,|\n|$)")


def adapter_columns(name: str) -> list[str]:
    """Output column names of an adapter, in order (parsed from its text)."""
    select = ADAPTERS[name].split("\nFROM")[0]
    return [m for m in _OUT_ALIAS.findall(select)]
