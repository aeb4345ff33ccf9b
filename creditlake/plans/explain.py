"""Scoring and explanation of applications (M-07, C-10, C-11, W-01, J-08, J-09).

Everything is per row: an application's feature importances are an ordered
array of (feature, importance) structs, ranked and cut to the top k with
``array_sort``/``slice`` inside the row.  No shuffle is needed to explain
a batch of any size, and no group can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D

# ---- fixed values: explanation rules (feature -> description, advice, type, impact) ----
RULES = (
    ("debt_to_income", "Высокая долговая нагрузка",
     "Снизить долю задолженности ниже 40% от дохода.", "short_term", 0.06),
    ("income", "Недостаточный подтвержденный доход",
     "Подтвердить дополнительный источник дохода или привлечь созаёмщика.", "medium_term", 0.05),
    ("bki_request_cnt", "Высокая частота запросов в БКИ",
     "Снизить число одновременных кредитных заявок.", "short_term", 0.04),
    ("age", "Возрастной профиль влияет на риск",
     "Увеличить подтверждённый стаж и стабильность занятости.", "long_term", 0.02),
)
DEFAULT_ADVICE = "Улучшить общий финансовый профиль."
DEFAULT_TYPE = "short_term"
DEFAULT_IMPACT = 0.01
TEXT_BASE = "Вероятность дефолта составляет {pct}%. Основные факторы решения модели выделены ниже."
TEXT_DETAILED = " Детализация факторов: "
TEXT_POLICY = " Решение сформировано на основе интерпретируемых факторов без дискриминационных признаков. "
FACTOR_TEXT = "{}: вклад {}"
MODES = ("brief", "detailed", "policy")
TOP_K = 5
HEURISTIC_FEATURES = ("debt_to_income", "bki_request_cnt", "income", "age")


def rules_frame(spark: SparkSession) -> DataFrame:
    """J-08 lookup table (4 rows: a proven, fixed size, broadcast safely)."""
    return spark.createDataFrame(
        [(f, d, a, t, i) for f, d, a, t, i in RULES],
        "feature string, description string, advice string, rec_type string, impact_estimate double")


def _rule_map(idx: int) -> Column:
    return F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.lit(r[idx]))])


# --------------------------------------------------------------- scoring

def score_heuristic(requests: DataFrame) -> DataFrame:
    """M-07 fallback path (no model): F-13 per request.  Adds
    default_probability, confidence, model_version, importances (ordered
    array of (feature, importance)) and features (feature -> value)."""
    have = set(requests.columns)

    def col(name: str):
        return F.col(name) if name in have else F.lit(None).cast("double")
    h = D.heuristic_columns(col("income"), col("age"), col("debt_to_income"), col("bki_request_cnt"))
    imps = F.array(*[F.struct(F.lit(f).alias("feature"), h[f"imp_{f}"].alias("importance"))
                     for f in HEURISTIC_FEATURES])
    feats = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(f).alias("k"), col(f).cast("double").alias("v"))
                  for f in HEURISTIC_FEATURES]),
        lambda e: e["v"].isNotNull()))
    return requests.select(
        "*",
        h["default_probability"].alias("default_probability"),
        h["confidence"].alias("confidence"),
        F.lit(D.HEURISTIC_MODEL_VERSION).alias("model_version"),
        imps.alias("importances"),
        feats.alias("features"),
    )


# ----------------------------------------------------------- top factors

def ranked_importances(importances: Column, top_k: int = TOP_K) -> Column:
    """W-01 inside the row: by |importance| desc; ties keep input order
    (Python's stable sort), then cut to ``top_k``."""
    indexed = F.transform(importances, lambda e, i: F.struct(
        e["feature"].alias("feature"), e["importance"].alias("importance"), i.alias("pos")))

    def cmp(l, r):
        al, ar = F.abs(l["importance"]), F.abs(r["importance"])
        return (F.when(al > ar, F.lit(-1)).when(al < ar, F.lit(1))
                .when(l["pos"] < r["pos"], F.lit(-1)).when(l["pos"] > r["pos"], F.lit(1))
                .otherwise(F.lit(0)))
    return F.slice(F.array_sort(indexed, cmp), 1, top_k)


def key_factors(importances: Column, features: Column, top_k: int = TOP_K) -> Column:
    """array<struct<feature, value, impact, advice>>, rank order."""
    advice = _rule_map(2)
    return F.transform(ranked_importances(importances, top_k), lambda e: F.struct(
        e["feature"].alias("feature"),
        F.coalesce(F.element_at(features, e["feature"]), F.lit(0.0)).alias("value"),
        e["importance"].alias("impact"),
        F.coalesce(F.element_at(advice, e["feature"]), F.lit(DEFAULT_ADVICE)).alias("advice"),
    ))


def recommendations(factors: Column) -> Column:
    rtype, rimpact = _rule_map(3), _rule_map(4)
    return F.transform(factors, lambda f: F.struct(
        F.coalesce(F.element_at(rtype, f["feature"]), F.lit(DEFAULT_TYPE)).alias("type"),
        f["advice"].alias("text"),
        F.coalesce(F.element_at(rimpact, f["feature"]), F.lit(DEFAULT_IMPACT)).alias("impact_estimate"),
    ))


def factor_details(factors: Column) -> Column:
    return F.array_join(F.transform(factors, lambda f: F.concat(
        f["feature"], F.lit(FACTOR_TEXT.strip("{}")), _impact_text(f["impact"]))), "; ")


def _impact_text(v: Column) -> Column:
    return D.py_fixed(v, 3, plus=True, in_lambda=True)


def explanation_text(prob: Column, mode: Column, factors: Column) -> Column:
    """F-15: brief / detailed / policy text."""
    pct = D.py_fixed(prob * 100.0, 2)
    head, tail = TEXT_BASE.split("{pct}")
    base = F.concat(F.lit(head), pct, F.lit(tail))
    details = factor_details(factors)
    return (F.when(mode == "policy", F.concat(base, F.lit(TEXT_POLICY), details))
            .when(mode == "detailed", F.concat(base, F.lit(TEXT_DETAILED), details))
            .otherwise(base))


def explain(scored: DataFrame, mode: str | Column = "brief", top_k: int = TOP_K,
            decision_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """C-10: one explanation per scored row, with the columns ``keep`` of it.
    Rows without importances are not explained (the reference answers them with
    an error)."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    rows = scored.where(F.size("importances") > 0)
    supplied = F.col(decision_col) if decision_col else None
    # the ranked factors are computed once (their own projection; Spark does
    # not merge a projection that would repeat a costly expression) and
    # every later column reads them
    ranked = rows.select(
        *keep, "application_id", "default_probability", "model_version",
        D.decision_by_probability(F.col("default_probability"), supplied).alias("decision"),
        m.alias("mode"),
        key_factors(F.col("importances"), F.col("features"), top_k).alias("key_factors"))
    factors = F.col("key_factors")
    sum_abs = F.aggregate(factors, F.lit(0.0), lambda acc, f: acc + F.abs(f["impact"]))
    return ranked.select(
        *keep, "application_id", "default_probability", "decision", "model_version", "mode",
        explanation_text(F.col("default_probability"), F.col("mode"), factors).alias("explanation_text"),
        factors.alias("key_factors"),
        recommendations(factors).alias("recommendations"),
        D.explanation_confidence(sum_abs).alias("confidence"),
    )


def top_factors_long(spark: SparkSession, scored: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """W-01 + J-08 in long form: one row per (application, rank), advice
    from the broadcast rules table with the default row for unknown features."""
    exploded = scored.select(
        "application_id", "features",
        F.posexplode(ranked_importances(F.col("importances"), top_k)).alias("pos", "f"))
    rules = F.broadcast(rules_frame(spark))
    j = exploded.join(rules, exploded["f.feature"] == rules["feature"], "left")
    return j.select(
        "application_id",
        (F.col("pos") + 1).alias("factor_rank"),
        F.col("f.feature").alias("feature"),
        F.coalesce(F.element_at("features", F.col("f.feature")), F.lit(0.0)).alias("value"),
        F.col("f.importance").alias("impact"),
        F.coalesce(F.col("advice"), F.lit(DEFAULT_ADVICE)).alias("advice"),
        F.coalesce(F.col("rec_type"), F.lit(DEFAULT_TYPE)).alias("rec_type"),
        F.coalesce(rules["impact_estimate"], F.lit(DEFAULT_IMPACT)).alias("impact_estimate"),
    )


# ----------------------------------------------------- agent sheets (C-11)

def score_sheet(scored: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """C-11 'score': decision 1/0, label, probability, rating, top features."""
    dec = D.binary_decision(F.col("default_probability"))
    top = F.transform(ranked_importances(F.col("importances"), top_k), lambda e: F.struct(
        e["feature"].alias("feature"), e["importance"].alias("importance")))
    return scored.select(
        "application_id",
        dec.alias("decision"),
        D.decision_label(dec).alias("decision_label"),
        "default_probability",
        D.credit_rating(F.col("default_probability")).alias("credit_rating"),
        top.alias("important_features"),
        "model_version",
    )


def advice_sheet(scored: DataFrame) -> DataFrame:
    """C-11 'advise': detailed explanation projected to advice fields."""
    e = explain(scored, "detailed")
    return e.select("application_id", "decision", "default_probability", "recommendations",
                    "key_factors", "confidence")


def decision_sheet(scored: DataFrame) -> DataFrame:
    """C-11 'explain decision': policy text with the binary decision and rating."""
    e = explain(scored, "policy")
    dec = D.binary_decision(F.col("default_probability"))
    return e.select("application_id", dec.alias("decision"), "default_probability",
                    D.credit_rating(F.col("default_probability")).alias("credit_rating"),
                    "explanation_text", "key_factors", "recommendations", "model_version")


def normalized_importances(importances: Column) -> Column:
    """A-14: each importance divided by the sum of absolute importances
    (input order, plain left-to-right sum), rounded to 4 places; unchanged
    when the sum is 0."""
    total = F.aggregate(importances, F.lit(0.0), lambda acc, e: acc + F.abs(e["importance"]))
    return F.transform(importances, lambda e: F.struct(
        e["feature"].alias("feature"),
        F.when(total > 0, D.py_round(e["importance"] / total, 4, in_lambda=True))
        .otherwise(e["importance"]).alias("importance")))
