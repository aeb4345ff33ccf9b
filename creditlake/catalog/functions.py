"""Scalar-function queries (F-01 .. F-18, P-18, P-19)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType

from ..functions import decisions as D
from ..functions import hashing as H
from ..functions.json_text import json_entries, json_get_double, json_hashdiff, json_object_text, json_of_entries
from ..functions.pytext import py_double_str
from ..functions.requests import request_features, request_id
from ..plans import explain as X
from ..sources.fixtures import staged
from ..sources.tables import read_table
from . import register
from .sqlkit import hashdiff, json_text, md5_key, txt, with_ctes


def hash_keys(spark, sf_dir):
    b = staged(spark, sf_dir, "stg_bureau")
    return b.select("sk_id_bureau", "sk_id_curr",
                    H.hk_application(F.col("sk_id_curr")).alias("hk_application"),
                    H.hk_bureau_credit(F.col("sk_id_bureau")).alias("hk_bureau_credit"),
                    H.hk_link_application_bureau(F.col("sk_id_curr"), F.col("sk_id_bureau"))
                    .alias("hk_link_application_bureau"))


register("hash_keys", with_ctes(
    f"SELECT sk_id_bureau, sk_id_curr, {md5_key('application', 'sk_id_curr')} AS hk_application, "
    f"{md5_key('bureau', 'sk_id_bureau')} AS hk_bureau_credit, "
    f"{md5_key('link_app_bureau', 'sk_id_curr', 'sk_id_bureau')} AS hk_link_application_bureau FROM stg_bureau",
    ("stg_bureau",)))(hash_keys)


def hash_link(spark, sf_dir):
    p = staged(spark, sf_dir, "stg_previous_application")
    return p.select("sk_id_prev", "sk_id_curr",
                    H.hk_prev_application(F.col("sk_id_prev")).alias("hk_prev_application"),
                    H.hk_link_application_prev(F.col("sk_id_curr"), F.col("sk_id_prev"))
                    .alias("hk_link_application_prev"))


register("hash_link", with_ctes(
    f"SELECT sk_id_prev, sk_id_curr, {md5_key('prev_application', 'sk_id_prev')} AS hk_prev_application, "
    f"{md5_key('link_app_prev', 'sk_id_curr', 'sk_id_prev')} AS hk_link_application_prev "
    "FROM stg_previous_application", ("stg_previous_application",)))(hash_link)


# F-03/F-04: Python number text over five orders of magnitude, and the hashdiff
_NUM_COLS = {
    "v_price": "l_extendedprice",
    "v_big": "l_extendedprice * l_quantity * 1000.0",
    "v_huge": "l_extendedprice * 1.0e12",
    "v_small": "l_discount / 1000.0",
    "v_milli": "l_tax / 100.0 + 0.0001",
}


def hashdiff_rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", wide=True).selectExpr(
        "l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _NUM_COLS.items()], "l_returnflag")
    texts = li.select("l_orderkey", "l_linenumber", "l_returnflag",
                      *[py_double_str(F.col(n)).alias(f"txt_{n[2:]}") for n in _NUM_COLS])
    txt_cols = [f"txt_{n[2:]}" for n in _NUM_COLS]
    return texts.select("l_orderkey", "l_linenumber", *txt_cols,
                        H.hashdiff_of_texts([F.col("l_returnflag")] + [F.col(c) for c in txt_cols]).alias("hashdiff"))


register("hashdiff_rows", with_ctes(
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{txt(n)} AS txt_{n[2:]}" for n in _NUM_COLS)
    + f", {hashdiff('l_returnflag', *_NUM_COLS)} AS hashdiff FROM v",
    v="SELECT l_orderkey, l_linenumber, l_returnflag, "
      + ", ".join(f"{e} AS {n}" for n, e in _NUM_COLS.items()) + " FROM lineitem"))(hashdiff_rows)


# F-05/F-06: JSON pack text (insertion order) and its sorted-key hash
def _order_pack_frame(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "CAST(o_custkey AS INT) AS o_custkey")


_PACK = [("o_orderstatus", StringType(), "str"), ("o_totalprice", DoubleType(), "num"),
         ("o_orderpriority", StringType(), "str"), ("o_custkey", None, "num")]


def json_pack(spark, sf_dir):
    df = _order_pack_frame(spark, sf_dir)
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [(n, F.col(n), types[n]) for n, _, _ in _PACK]
    return df.select("o_orderkey", json_object_text(fields).alias("attrs"),
                     json_hashdiff(fields).alias("hashdiff"))


_PACK_CTE = dict(p="SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END "
                   "AS o_totalprice, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS "
                   "o_orderpriority, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders")
_PACK_FIELDS = [(n, k) for n, _, k in _PACK]
register("json_pack", with_ctes(
    f"SELECT o_orderkey, {json_text(_PACK_FIELDS)} AS attrs, md5({json_text(_PACK_FIELDS, sort_keys=True)}) "
    "AS hashdiff FROM p", **_PACK_CTE))(json_pack)


def json_unpack(spark, sf_dir):
    """F-07: packed attributes read back to typed columns."""
    packed = json_pack(spark, sf_dir)
    return packed.select("o_orderkey",
                         F.get_json_object("attrs", "$.o_orderstatus").alias("o_orderstatus"),
                         json_get_double(F.col("attrs"), "o_totalprice").alias("o_totalprice"),
                         F.get_json_object("attrs", "$.o_custkey").cast("int").alias("o_custkey"))


register("json_unpack", with_ctes(
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM p", **_PACK_CTE))(json_unpack)


# F-08 .. F-12, F-17
def risk_bucket(spark, sf_dir):
    r = staged(spark, sf_dir, "crm_score_request")
    return r.select("application_id", "debt_to_income",
                    D.risk_bucket(F.col("debt_to_income")).alias("risk_bucket"))


register("risk_bucket", with_ctes(
    "SELECT application_id, debt_to_income, CASE WHEN debt_to_income > 0 AND debt_to_income <= 0.3 THEN 'low' "
    "WHEN debt_to_income > 0.3 AND debt_to_income <= 0.5 THEN 'medium' "
    "WHEN debt_to_income > 0.5 AND debt_to_income <= 1.0 THEN 'high' END AS risk_bucket FROM crm_score_request",
    ("crm_score_request",)))(risk_bucket)


def decisions(spark, sf_dir):
    s = X.score_heuristic(staged(spark, sf_dir, "crm_score_request"))
    p = F.col("default_probability")
    b = D.binary_decision(p)
    return s.select("application_id", "default_probability",
                    D.decision_by_probability(p).alias("decision"),
                    b.alias("binary_decision"), D.decision_label(b).alias("decision_label"),
                    D.credit_rating(p).alias("credit_rating"), D.risk_band(p).alias("risk_band"),
                    D.model_prediction(p).alias("predicted_default"),
                    D.model_confidence(p).alias("model_confidence"))


def _decisions_sql():
    from .explain import SCORE_CTES, pyround
    return with_ctes(
        "SELECT application_id, default_probability, "
        "CASE WHEN default_probability < 0.3 THEN 'approve' WHEN default_probability < 0.5 THEN "
        "'conditionally_approve' ELSE 'conditionally_reject' END AS decision, "
        "CASE WHEN default_probability <= 0.5 THEN 1 ELSE 0 END AS binary_decision, "
        "CASE WHEN default_probability <= 0.5 THEN 'выдавать кредит' ELSE 'не выдавать кредит' END AS decision_label, "
        f"{pyround('least(greatest((1.0 - default_probability) * 100.0, 0.0), 100.0)', 2)} AS credit_rating, "
        "CASE WHEN default_probability * 100.0 < 20 THEN 'approve' WHEN default_probability * 100.0 < 50 "
        "THEN 'review' ELSE 'reject' END AS risk_band, default_probability >= 0.5 AS predicted_default, "
        f"{pyround('least(greatest(0.65 + 0.3 * abs(0.5 - default_probability), 0.01), 0.99)', 4)} AS model_confidence "
        "FROM scored", ("crm_score_request",), **{k: SCORE_CTES[k] for k in ("h", "s", "scored")})


register("decisions", _decisions_sql())(decisions)


# F-18: form-text coercions over text fields derived from events
def _form_frame(spark, sf_dir):
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS STRING) END AS age_text",
        "CASE event_type WHEN 'view' THEN '0' WHEN 'error' THEN '' ELSE CAST(value AS STRING) END AS income_text",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'True' ELSE 'False' END AS flag_text")


def form_coercion(spark, sf_dir):
    f = _form_frame(spark, sf_dir)
    return f.select("event_id", D.coerce_form_int(F.col("age_text")).alias("age"),
                    D.coerce_form_money(F.col("income_text")).alias("income"),
                    D.coerce_form_flag(F.col("flag_text")).alias("good_work"))


register("form_coercion", with_ctes(
    "SELECT event_id, CASE WHEN trim(age_text) = '' THEN NULL ELSE TRY_CAST(trim(age_text) AS INTEGER) END AS age, "
    "CASE WHEN TRY_CAST(trim(income_text) AS DOUBLE) = 0 THEN NULL ELSE TRY_CAST(trim(income_text) AS DOUBLE) END "
    "AS income, coalesce(flag_text = 'True', false) AS good_work FROM f",
    f="SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END AS age_text, "
      "CASE event_type WHEN 'view' THEN '0' WHEN 'error' THEN '' ELSE CAST(value AS VARCHAR) END AS income_text, "
      "CASE WHEN event_type IN ('purchase', 'signup') THEN 'True' ELSE 'False' END AS flag_text FROM events"
))(form_coercion)


# P-18/P-19: request texts in both forms, built from events
def request_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "CASE WHEN event_type IN ('signup', 'purchase') THEN "
        "concat('{\"application_id\": ', CAST(user_id AS STRING), ', \"features\": {\"income\": ', "
        "CAST(value AS STRING), ', \"k\": ', get_json_object(props, '$.k'), ', \"note\": null}}') "
        "ELSE concat(' ', CAST(user_id AS STRING), ' | income=', CAST(value AS STRING), ' | channel=', event_type, "
        "' |  | k=', get_json_object(props, '$.k'), ' | flag') END AS request_text")


def parse_requests(spark, sf_dir):
    t = request_texts(spark, sf_dir)
    parsed = t.select("request_id", request_id(F.col("request_text")).alias("application_id"),
                      request_features(F.col("request_text")).alias("features"))
    return parsed.select("request_id", "application_id",
                         F.explode_outer("features").alias("feature", "value"))


register("parse_requests", with_ctes(
    """SELECT request_id, application_id, feature, value FROM (
  SELECT request_id, TRY_CAST(user_id AS BIGINT) AS application_id, 'income' AS feature, value FROM ev
  UNION ALL SELECT request_id, user_id, 'k', TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM ev
)""",
    ev="SELECT event_id AS request_id, user_id, value, props, event_type FROM events"))(parse_requests)


def json_pack_types(spark, sf_dir):
    """F-05/F-06 on text, boolean, date and NaN: hash of the packed object."""
    d = read_table(spark, sf_dir, "documents")
    flag, day = F.col("n_chars") > 1000, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    share = F.when(F.col("n_chars") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 8.0)
    fields = [("text", F.col("text"), StringType()), ("flag", flag, BooleanType()), ("day", day, DateType()),
              ("share", share, DoubleType())]
    # each value is written once, for both orders of the keys
    written = d.select("doc_id", *[e.alias(n) for n, e in json_entries(fields)])
    entries = [(n, F.col(n)) for n, _, _ in fields]
    return written.select("doc_id", F.md5(json_of_entries(entries)).alias("pack_md5"),
                          F.md5(json_of_entries(entries, sort_keys=True)).alias("hashdiff"))


_JSON_TEXT = (
    "'\"' || array_to_string([CASE WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' "
    "WHEN c = chr(9) THEN '\\t' WHEN c = chr(13) THEN '\\r' "
    "WHEN unicode(c) > 127 OR unicode(c) < 32 THEN printf('\\u%04x', unicode(c)) ELSE c END "
    "FOR c IN string_split(text, '')], '') || '\"'")
register("json_pack_types", f"""
WITH v AS (
  SELECT doc_id, '\"text\": ' || {_JSON_TEXT} AS t, '\"flag\": ' || CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS f,
         '\"day\": \"' || CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR) || '\"' AS d,
         CASE WHEN n_chars % 2 = 1 THEN '\"share\": ' || CAST(n_chars / 8.0 AS VARCHAR) END AS s
  FROM documents)
SELECT doc_id, md5('{{' || concat_ws(', ', t, f, d, s) || '}}') AS pack_md5,
       md5('{{' || concat_ws(', ', d, f, s, t) || '}}') AS hashdiff FROM v""")(json_pack_types)
