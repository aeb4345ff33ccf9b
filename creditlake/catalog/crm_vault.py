"""CRM vault (C-07) and score / explanation satellites (C-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.vault import hub_frame, link_frame, sat_frame
from ..plans import crm as C
from ..plans import explain as X
from ..plans import vault_specs as V
from ..plans.vault_load import LOAD_DTS
from . import register
from .sqlkit import LOAD_TS, md5_key, with_ctes


def _crm_source(spark, sf_dir):
    apps = C.applications(spark, sf_dir).select(
        "application_id", "client_id", "app_date", F.col("income").alias("req_income"), "debt_to_income")
    return apps.join(C.clients(spark, sf_dir), "client_id")


def _txt(c: str, kind: str) -> str:
    if kind == "bool":
        return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END"
    return f"CAST({c} AS VARCHAR)"


def _hd(cols) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce({_txt(c, k)}, '')" for c, k in cols) + "))"


def _json(fields, sort=False) -> str:
    items = sorted(fields) if sort else fields
    ents = [f"CASE WHEN {n} IS NOT NULL THEN '\"{n}\": ' || "
            f"{'to_json(' + n + ')' if k == 'str' else 'CAST(' + n + ' AS VARCHAR)'} END" for n, k in items]
    return "'{' || concat_ws(', ', " + ", ".join(ents) + ") || '}'"


_SRC = ("SELECT a.application_id, a.client_id, a.app_date, a.income AS req_income, a.debt_to_income, c.* "
        "EXCLUDE (client_id) FROM crm_score_request a JOIN crm_client c ON c.client_id = a.client_id")
_TAIL = f"'{{rs}}' AS record_source, {LOAD_TS} AS load_dts, {LOAD_TS} AS effective_from"


def _reg(name, sql, fn):
    register(name, with_ctes(sql, ("crm_score_request", "crm_client"), src=_SRC))(fn)


_reg("dv_crm_hub_client",
     f"SELECT DISTINCT {md5_key('client', 'client_id')} AS hk_client, client_id, 'webapp' AS record_source, "
     f"{LOAD_TS} AS load_dts FROM src",
     lambda spark, sf: hub_frame(_crm_source(spark, sf), V.HUB_CRM_CLIENT, LOAD_DTS))
_reg("dv_crm_hub_application",
     f"SELECT DISTINCT {md5_key('crm_application', 'application_id')} AS hk_application, application_id, "
     f"'webapp' AS record_source, {LOAD_TS} AS load_dts FROM src",
     lambda spark, sf: hub_frame(_crm_source(spark, sf), V.HUB_CRM_APPLICATION, LOAD_DTS))
_reg("dv_crm_link",
     f"SELECT DISTINCT {md5_key('link_client_app', 'client_id', 'application_id')} AS hk_link_client_application, "
     f"{md5_key('client', 'client_id')} AS hk_client, {md5_key('crm_application', 'application_id')} AS hk_application, "
     f"'webapp' AS record_source, {LOAD_TS} AS load_dts FROM src",
     lambda spark, sf: link_frame(_crm_source(spark, sf), V.LINK_CRM, LOAD_DTS))

_CLIENT_COLS = [("education", "s"), ("sex", "s"), ("age", "n"), ("car", "bool"), ("car_type", "bool"),
                ("income", "n"), ("foreign_passport", "bool")]
_reg("dv_crm_sat_client",
     f"SELECT {md5_key('client', 'client_id')} AS hk_client, {_hd(_CLIENT_COLS)} AS hashdiff, education, sex, "
     "age, car, car_type, income, foreign_passport, " + _TAIL.format(rs="webapp") + " FROM crm_client",
     lambda spark, sf: sat_frame(C.clients(spark, sf), V.SAT_CRM_CLIENT, LOAD_DTS))
_reg("dv_crm_sat_financial",
     f"SELECT {md5_key('client', 'client_id')} AS hk_client, "
     f"{_hd([('decline_app_cnt', 'n'), ('good_work', 'bool'), ('bki_request_cnt', 'n')])} AS hashdiff, "
     "decline_app_cnt, good_work, bki_request_cnt, CAST(NULL AS DECIMAL(5,2)) AS region_rating, "
     + _TAIL.format(rs="webapp") + " FROM crm_client",
     lambda spark, sf: sat_frame(C.clients(spark, sf), V.SAT_CRM_FINANCIAL, LOAD_DTS))
_reg("dv_crm_sat_behavior",
     f"SELECT {md5_key('client', 'client_id')} AS hk_client, {_hd([('home_address', 's'), ('first_time', 'bool')])} "
     "AS hashdiff, home_address, CAST(NULL AS VARCHAR) AS work_address, CAST(NULL AS VARCHAR) AS sna, first_time, "
     + _TAIL.format(rs="webapp") + " FROM crm_client",
     lambda spark, sf: sat_frame(C.clients(spark, sf), V.SAT_CRM_BEHAVIOR, LOAD_DTS))
_reg("dv_crm_sat_application",
     f"SELECT {md5_key('crm_application', 'application_id')} AS hk_application, "
     f"{_hd([('app_date', 'n'), ('req_income', 'n'), ('debt_to_income', 'n')])} AS hashdiff, app_date, "
     f"{_json([('req_income', 'num'), ('debt_to_income', 'num')])} AS features, " + _TAIL.format(rs="webapp")
     + " FROM src",
     lambda spark, sf: sat_frame(_crm_source(spark, sf), V.SAT_CRM_APP, LOAD_DTS))


# ---- C-06: scoring result and explanation satellites ----

def _scores(spark, sf):
    return C.scoring_info(C.applications(spark, sf))


def dv_sat_score(spark, sf):
    s = _scores(spark, sf).select("application_id", "default_probability", "model_version", "confidence")
    return sat_frame(s, V.SAT_SCORING, LOAD_DTS)


def dv_sat_explain(spark, sf):
    apps = C.applications(spark, sf)
    e = X.explain(X.score_heuristic(apps), "detailed").select("application_id", "decision", "confidence", "mode")
    return sat_frame(e, V.SAT_EXPLANATION, LOAD_DTS)


def _score_sql() -> str:
    from .explain import SCORE_CTES
    return with_ctes(
        f"SELECT {md5_key('crm_application', 'application_id')} AS hk_application, "
        f"{_hd([('default_probability', 'n'), ('model_version', 's'), ('confidence', 'n')])} AS hashdiff, "
        "CAST(CAST(CAST(default_probability AS VARCHAR) AS DECIMAL(8,6)) AS DECIMAL(8,6)) AS default_probability, "
        "model_version, CAST(CAST(confidence AS VARCHAR) AS DECIMAL(8,6)) AS confidence, "
        f"{_json([('default_probability', 'num'), ('model_version', 'str'), ('confidence', 'num')])} AS scoring_payload, "
        + _TAIL.format(rs="mlservice") + " FROM scored",
        ("crm_score_request",), **{k: SCORE_CTES[k] for k in ("h", "s", "scored")})


def _explain_sql() -> str:
    from .explain import SCORE_CTES
    fields = [("decision", "str"), ("confidence", "num"), ("mode", "str")]
    return with_ctes(
        f"SELECT {md5_key('crm_application', 'application_id')} AS hk_application, md5({_json(fields, sort=True)}) "
        f"AS hashdiff, mode, {_json(fields)} AS explanation_payload, " + _TAIL.format(rs="agentservice")
        + " FROM (SELECT application_id, decision, confidence, 'detailed' AS mode FROM expl)",
        ("crm_score_request",), **SCORE_CTES)


register("dv_sat_score", _score_sql())(dv_sat_score)
register("dv_sat_explain", _explain_sql())(dv_sat_explain)
