"""CRM queries (A-09, T-01, T-02, J-07, J-09, P-16, K-04, C-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import crm as C
from ..plans import explain as X
from ..session import scratch_path
from ..sources import buckets
from ..sources.fixtures import staged
from . import register
from .explain import SCORE_CTES
from .sqlkit import with_ctes

_CTES = {k: SCORE_CTES[k] for k in ("h", "s", "scored")}
_CTES["scoring_info"] = "SELECT application_id, default_probability, model_version, confidence FROM scored"
# applications for which a request has arrived
_ASKED = "SELECT DISTINCT application_id FROM stream_score_request"
_CTES["listing"] = """SELECT a.application_id, a.client_id, a.app_date, c.education, c.sex, c.age,
       c.income AS client_income, s.default_probability, s.model_version,
       CASE WHEN s.default_probability * 100.0 < 20 THEN 'approve' WHEN s.default_probability * 100.0 < 50
            THEN 'review' WHEN s.default_probability IS NOT NULL THEN 'reject' END AS risk_band
FROM crm_score_request a JOIN crm_client c ON c.client_id = a.client_id
LEFT JOIN scoring_info s ON s.application_id = a.application_id"""
_ADP = ("crm_score_request", "crm_client", "stream_score_request")


def _q(sql: str) -> str:
    return with_ctes(sql, _ADP, **_CTES)


def _frames(spark, sf_dir):
    apps, cl = C.applications(spark, sf_dir), C.clients(spark, sf_dir)
    return apps, cl, C.scoring_info(apps)


def _asked(spark, sf_dir):
    """Applications for which a request has arrived."""
    requests = staged(spark, sf_dir, "stream_score_request").select("application_id").distinct()
    return C.applications(spark, sf_dir).join(requests, "application_id", "left_semi")


def _stored(spark, *loads):
    """The score table that these loads leave, one after the other."""
    root = scratch_path(spark, "crm_scores")
    for scores in loads:
        buckets.upsert(scores, root, ["application_id"], ["generated_at"])
    return buckets.read(spark, root)


def crm_dashboard(spark, sf_dir):
    return C.dashboard(*_frames(spark, sf_dir))


register("crm_dashboard", _q(
    "SELECT (SELECT count(*) FROM crm_score_request) AS total_applications, "
    "(SELECT count(*) FROM crm_client) AS total_clients, "
    "(SELECT count(*) FROM scoring_info) AS scored_applications"))(crm_dashboard)


def crm_recent5(spark, sf_dir):
    return C.recent(C.applications(spark, sf_dir), 5)


register("crm_recent5", _q(
    "SELECT application_id, client_id, app_date FROM crm_score_request "
    "ORDER BY app_date DESC, application_id DESC LIMIT 5"))(crm_recent5)


def crm_list(spark, sf_dir):
    return C.application_list(*_frames(spark, sf_dir))


register("crm_list", _q("SELECT * FROM listing ORDER BY app_date DESC, application_id DESC"))(crm_list)


def crm_detail(spark, sf_dir):
    return C.detail(C.application_list(*_frames(spark, sf_dir)))


register("crm_detail", _q(
    "SELECT * FROM listing WHERE application_id = (SELECT application_id FROM listing "
    "ORDER BY app_date DESC, application_id DESC LIMIT 1)"))(crm_detail)


def crm_upsert_score(spark, sf_dir):
    """K-04: imported scores of all applications, then new ones of those for
    which a request has arrived; only the buckets of these are rewritten."""
    imported = C.scoring_info(C.applications(spark, sf_dir), C.SCORED_AT, "import-v0")
    return _stored(spark, imported, C.scoring_info(_asked(spark, sf_dir), C.RESCORED_AT)).drop("importances")


register("crm_upsert_score", _q(f"""
SELECT application_id, default_probability, CASE WHEN asked THEN model_version ELSE 'import-v0' END AS model_version, confidence,
       CASE WHEN asked THEN TIMESTAMP '{C.RESCORED_AT}' ELSE TIMESTAMP '{C.SCORED_AT}' END AS generated_at
FROM (SELECT *, application_id IN ({_ASKED}) AS asked FROM scored)"""))(crm_upsert_score)


def crm_intake(spark, sf_dir):
    apps, cl = C.applications(spark, sf_dir), C.clients(spark, sf_dir)
    t = C.split_intake(C.intake_records(apps, cl))
    return t["clients"].join(t["financial_profiles"], "client_id").join(
        t["behavioral_contexts"], "client_id").join(t["applications"], "client_id")


register("crm_intake", _q(
    "SELECT a.application_id AS client_id, c.education, c.sex, c.age, c.car, c.car_type, c.income, "
    "c.foreign_passport, c.decline_app_cnt, c.good_work, c.bki_request_cnt, c.home_address, c.first_time, "
    "a.application_id, a.app_date FROM crm_score_request a JOIN crm_client c ON c.client_id = a.client_id"
))(crm_intake)


# J-09: explanations only for scored applications; the rest is reported.  The
# stored scores are those of an earlier load: of the requests that have arrived.
def crm_explain_scored(spark, sf_dir):
    known = _stored(spark, C.scoring_info(_asked(spark, sf_dir)))
    scored = X.score_heuristic(C.applications(spark, sf_dir).join(known.select("application_id"), "application_id", "left_semi"))
    return X.explain(scored, "detailed").select("application_id", "decision", "explanation_text", "confidence")


register("crm_explain_scored", with_ctes(
    f"SELECT application_id, decision, base_text || ' Детализация факторов: ' || details AS explanation_text, "
    f"confidence FROM expl WHERE application_id IN ({_ASKED})",
    ("crm_score_request", "stream_score_request"), **SCORE_CTES))(crm_explain_scored)


def crm_unscored(spark, sf_dir):
    known = _stored(spark, C.scoring_info(_asked(spark, sf_dir)))
    return C.applications(spark, sf_dir).join(known.select("application_id"), "application_id", "left_anti").select(
        "application_id", F.lit("not_scored").alias("status"),
        F.lit("Сначала необходимо провести скоринг").alias("message"))


register("crm_unscored", _q(
    f"SELECT application_id, 'not_scored' AS status, 'Сначала необходимо провести скоринг' AS message "
    f"FROM crm_score_request WHERE application_id NOT IN ({_ASKED})"
))(crm_unscored)
