"""Scoring, explanation and agent-sheet queries (F-09..F-17, M-07, W-01, J-08, J-09, C-10, C-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..plans import explain as X
from ..sources.fixtures import staged
from . import register
from .sqlkit import with_ctes


def scored_requests(spark, sf_dir):
    return X.score_heuristic(staged(spark, sf_dir, "crm_score_request"))


def heuristic_score(spark, sf_dir):
    """F-12/F-13: rule score of every score request."""
    r = staged(spark, sf_dir, "crm_score_request")
    h = D.heuristic_columns(F.col("income"), F.col("age"), F.col("debt_to_income"), F.col("bki_request_cnt"))
    return r.select("application_id", h["default_probability"].alias("default_probability"),
                    h["confidence"].alias("confidence"),
                    F.lit(D.HEURISTIC_MODEL_VERSION).alias("model_version"),
                    *[h[f"imp_{f}"].alias(f"imp_{f}") for f in X.HEURISTIC_FEATURES])


def explain_batch(spark, sf_dir):
    return X.explain(scored_requests(spark, sf_dir), "brief")


def top_factors(spark, sf_dir):
    return X.top_factors_long(spark, scored_requests(spark, sf_dir))


def score_sheet(spark, sf_dir):
    return X.score_sheet(scored_requests(spark, sf_dir))


def advice_sheet(spark, sf_dir):
    return X.advice_sheet(scored_requests(spark, sf_dir))


def decision_sheet(spark, sf_dir):
    return X.decision_sheet(scored_requests(spark, sf_dir))


# ------------------------------------------------------------ oracle SQL

def pyround(expr: str, d: int) -> str:
    return f"CAST(printf('%.{d}f', {expr}) AS DOUBLE)"


_RULE_ROWS = ", ".join(
    "('{}', '{}', '{}', {})".format(f, a, t, i) for f, _, a, t, i in X.RULES)

SCORE_CTES = dict(
    h="""SELECT *, coalesce(income, 50000.0) AS inc, coalesce(age, 35.0) AS ag,
       coalesce(debt_to_income, 0.3) AS dt, coalesce(bki_request_cnt, 1.0) AS bk FROM crm_score_request""",
    s="SELECT *, greatest(least(0.45 + dt * 0.7 + bk * 0.04 - inc / 300000.0 - ag / 400.0, 0.99), 0.01) AS praw FROM h",
    scored=f"""SELECT *, {pyround('praw', 4)} AS default_probability,
       least(0.98, {pyround('0.65 + 0.3 * abs(0.5 - praw)', 4)}) AS confidence,
       'heuristic-v1' AS model_version FROM s""",
    imp=f"""SELECT application_id, 'debt_to_income' AS feature, 0 AS pos, {pyround('least(0.35, dt * 0.5)', 4)} AS importance, debt_to_income AS fvalue FROM scored
UNION ALL SELECT application_id, 'bki_request_cnt', 1, {pyround('least(0.2, bk * 0.03)', 4)}, bki_request_cnt FROM scored
UNION ALL SELECT application_id, 'income', 2, {pyround('greatest(-0.25, -(inc / 500000.0))', 4)}, income FROM scored
UNION ALL SELECT application_id, 'age', 3, {pyround('greatest(-0.1, -(ag / 1000.0))', 4)}, age FROM scored""",
    rules=f"SELECT * FROM (VALUES {_RULE_ROWS}) AS t(feature, advice, rec_type, impact_estimate)",
    top="""SELECT i.application_id, i.feature, coalesce(i.fvalue, 0.0) AS value, i.importance AS impact,
       row_number() OVER (PARTITION BY i.application_id ORDER BY abs(i.importance) DESC, i.pos) AS factor_rank,
       coalesce(r.advice, 'Улучшить общий финансовый профиль.') AS advice,
       coalesce(r.rec_type, 'short_term') AS rec_type,
       coalesce(r.impact_estimate, 0.01) AS impact_estimate
FROM imp i LEFT JOIN rules r ON r.feature = i.feature
QUALIFY factor_rank <= 5""",
    agg="""SELECT application_id,
       list({'feature': feature, 'value': value, 'impact': impact, 'advice': advice} ORDER BY factor_rank) AS key_factors,
       list({'type': rec_type, 'text': advice, 'impact_estimate': impact_estimate} ORDER BY factor_rank) AS recommendations,
       string_agg(feature || ': вклад ' || printf('%+.3f', impact), '; ' ORDER BY factor_rank) AS details,
       list_reduce(list(abs(impact) ORDER BY factor_rank), lambda a, b: a + b) AS sum_abs
FROM top GROUP BY application_id""",
    expl=f"""SELECT s.application_id, s.default_probability,
       CASE WHEN s.default_probability < 0.3 THEN 'approve' WHEN s.default_probability < 0.5
            THEN 'conditionally_approve' ELSE 'conditionally_reject' END AS decision,
       s.model_version,
       'Вероятность дефолта составляет ' || printf('%.2f', s.default_probability * 100.0)
         || '%. Основные факторы решения модели выделены ниже.' AS base_text,
       a.details, a.key_factors, a.recommendations,
       least(0.99, {pyround('0.7 + least(0.25, a.sum_abs / 2.0)', 4)}) AS confidence,
       CASE WHEN s.default_probability <= 0.5 THEN 1 ELSE 0 END AS bin_decision,
       {pyround('least(greatest((1.0 - s.default_probability) * 100.0, 0.0), 100.0)', 2)} AS credit_rating
FROM scored s JOIN agg a USING (application_id)""",
)


def _q(sql: str) -> str:
    return with_ctes(sql, ("crm_score_request",), **SCORE_CTES)


register("heuristic_score", _q(
    "SELECT application_id, default_probability, confidence, model_version, "
    + ", ".join(f"max(CASE WHEN feature = '{f}' THEN importance END) AS imp_{f}" for f in X.HEURISTIC_FEATURES)
    + " FROM scored JOIN imp USING (application_id) GROUP BY application_id, default_probability, confidence, model_version"
))(heuristic_score)
register("top_factors", _q(
    "SELECT application_id, factor_rank, feature, value, impact, advice, rec_type, impact_estimate FROM top"
))(top_factors)
register("explain_batch", _q(
    "SELECT application_id, default_probability, decision, model_version, 'brief' AS mode, "
    "base_text AS explanation_text, key_factors, recommendations, confidence FROM expl"))(explain_batch)
register("score_sheet", _q(
    "SELECT e.application_id, bin_decision AS decision, CASE WHEN bin_decision = 1 THEN 'выдавать кредит' "
    "ELSE 'не выдавать кредит' END AS decision_label, default_probability, credit_rating, "
    "(SELECT list({'feature': feature, 'importance': impact} ORDER BY factor_rank) FROM top t "
    " WHERE t.application_id = e.application_id) AS important_features, model_version FROM expl e"))(score_sheet)
register("advice_sheet", _q(
    "SELECT application_id, decision, default_probability, recommendations, key_factors, confidence FROM expl"
))(advice_sheet)
register("decision_sheet", _q(
    "SELECT application_id, bin_decision AS decision, default_probability, credit_rating, "
    "base_text || ' Решение сформировано на основе интерпретируемых факторов без дискриминационных признаков. ' "
    "|| details AS explanation_text, key_factors, recommendations, model_version FROM expl"))(decision_sheet)


def importance_normalized(spark, sf_dir):
    """A-14 over the rule scores: long form (application, position, feature,
    raw and normalised importance)."""
    s = scored_requests(spark, sf_dir)
    z = F.arrays_zip(F.col("importances").alias("raw"), X.normalized_importances(F.col("importances")).alias("norm"))
    return s.select("application_id", F.posexplode(z).alias("pos", "z")).select(
        "application_id", "pos", F.col("z.raw.feature").alias("feature"),
        F.col("z.raw.importance").alias("importance"), F.col("z.norm.importance").alias("normalized"))


register("importance_normalized", _q(
    "SELECT i.application_id, i.pos, i.feature, i.importance, CASE WHEN t.total > 0 THEN "
    + pyround("i.importance / t.total", 4) + " ELSE i.importance END AS normalized FROM imp i JOIN "
    "(SELECT application_id, list_reduce(list(abs(importance) ORDER BY pos), lambda a, b: a + b) AS total "
    "FROM imp GROUP BY application_id) t USING (application_id)"))(importance_normalized)
