"""Scores, decisions, bands and text as Column expressions (F-08 .. F-19).

Fixed values (thresholds, coefficients, labels, rule table) follow the
reference's scoring service, explanation service, agent tools, ETL
prototype and result page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqlfuncs import call

# ---- fixed values ----
BUCKET_EDGES = (0.0, 0.3, 0.5, 1.0)
BUCKET_LABELS = ("low", "medium", "high")
DECISION_APPROVE_BELOW = 0.3
DECISION_CONDITIONAL_BELOW = 0.5
DECISIONS = ("approve", "conditionally_approve", "conditionally_reject")
BINARY_THRESHOLD = 0.5
DECISION_LABEL_GRANT = "выдавать кредит"
DECISION_LABEL_REFUSE = "не выдавать кредит"
BAND_APPROVE_BELOW_PCT = 20
BAND_REVIEW_BELOW_PCT = 50
BANDS = ("approve", "review", "reject")
HEURISTIC_DEFAULTS = {"income": 50000.0, "age": 35.0, "debt_to_income": 0.3, "bki_request_cnt": 1.0}
HEURISTIC_MODEL_VERSION = "heuristic-v1"



def py_round(c: Column, digits: int, in_lambda: bool = False) -> Column:
    """Python ``round(x, d)``: the decimal nearest to the exact binary value,
    ties to even, returned as the nearest double.

    x * 10^d is split into a rounded product and its exact error (Dekker's
    two-product with a Veltkamp split; 10^d is exact), which decides the
    direction exactly; the final division by 10^d is correctly rounded.
    On columns this is the session SQL function ``cl_py_round``; inside a
    higher-order-function lambda (where SQL functions cannot take lambda
    variables) the same arithmetic is built in a few lambda stages."""
    if not in_lambda:
        return call("cl_py_round", c.cast("double"), F.lit(float(10 ** digits)))
    scale = F.lit(float(10 ** digits))
    s1 = F.array(F.struct(c.cast("double").alias("x")))
    s2 = F.transform(s1, lambda r: F.struct(r["x"].alias("x"), F.abs(r["x"]).alias("a"),
                                            (F.abs(r["x"]) * F.lit(134217729.0)).alias("sp")))
    s3 = F.transform(s2, lambda r: F.struct(r["x"].alias("x"), r["a"].alias("a"), (r["a"] * scale).alias("p"),
                                            (r["sp"] - (r["sp"] - r["a"])).alias("hi")))
    s4 = F.transform(s3, lambda r: F.struct(
        r["x"].alias("x"), r["a"].alias("a"), r["p"].alias("p"), F.floor(r["p"]).cast("double").alias("n"),
        ((r["hi"] * scale - r["p"]) + (r["a"] - r["hi"]) * scale).alias("err")))

    def final(r):
        half = (r["p"] - r["n"] - F.lit(0.5)) + r["err"]
        up = (F.when(half > 0, F.lit(1.0)).when(half < 0, F.lit(0.0))
              .when((r["n"] % F.lit(2.0)) == 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))
        mag = F.when(r["p"] >= F.lit(4503599627370496.0), r["a"]).otherwise((r["n"] + up) / scale)
        x = r["x"]
        return F.when(x.isNull() | F.isnan(x) | (x == 0), x).when(x < 0, -mag).otherwise(mag)
    return F.element_at(F.transform(s4, final), 1)


def py_fixed(c: Column, digits: int, plus: bool = False, in_lambda: bool = False) -> Column:
    """Python ``f"{x:.{d}f}"`` (``+`` flag optional) as text: the exactly
    rounded value printed with d decimals (no tie is left to the printer)."""
    r = py_round(c, digits, in_lambda)
    t = F.regexp_replace(F.format_number(r, digits), ",", "")
    if plus:
        t = F.when(t.startswith("-"), t).otherwise(F.concat(F.lit("+"), t))
    return t


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def risk_bucket(x: Column) -> Column:
    """F-08: ``pd.cut(x, [0, .3, .5, 1], labels)``: right-closed bins, 0 and >1 give null."""
    e = BUCKET_EDGES
    return (F.when((x > e[0]) & (x <= e[1]), F.lit(BUCKET_LABELS[0]))
            .when((x > e[1]) & (x <= e[2]), F.lit(BUCKET_LABELS[1]))
            .when((x > e[2]) & (x <= e[3]), F.lit(BUCKET_LABELS[2])))


def decision_by_probability(p: Column, supplied: Column | None = None) -> Column:
    """F-09: a supplied decision wins, else three bands of the probability."""
    d = (F.when(p < DECISION_APPROVE_BELOW, F.lit(DECISIONS[0]))
         .when(p < DECISION_CONDITIONAL_BELOW, F.lit(DECISIONS[1]))
         .when(p.isNotNull(), F.lit(DECISIONS[2])))
    if supplied is None:
        return d
    return F.coalesce(F.when(supplied != "", supplied), d)


def binary_decision(p: Column, threshold: float = BINARY_THRESHOLD) -> Column:
    """F-10: 1 = grant when the default probability is at most the threshold."""
    return F.when(p <= threshold, F.lit(1)).when(p.isNotNull(), F.lit(0))


def credit_rating(p: Column) -> Column:
    """F-10: ``round(clamp((1 - p) * 100, 0, 100), 2)``."""
    return py_round(clamp((F.lit(1.0) - p) * 100.0, 0.0, 100.0), 2)


def decision_label(decision: Column) -> Column:
    """F-17."""
    return F.when(decision == 1, F.lit(DECISION_LABEL_GRANT)).when(
        decision.isNotNull(), F.lit(DECISION_LABEL_REFUSE))


def risk_band(p: Column) -> Column:
    """F-11: band on the percentage (the page compared a 0-1 value with 20/50)."""
    pct = p * 100.0
    return (F.when(pct < BAND_APPROVE_BELOW_PCT, F.lit(BANDS[0]))
            .when(pct < BAND_REVIEW_BELOW_PCT, F.lit(BANDS[1]))
            .when(pct.isNotNull(), F.lit(BANDS[2])))


def model_prediction(p: Column) -> Column:
    """F-12: default predicted when p >= 0.5."""
    return p >= 0.5


def model_confidence(p: Column) -> Column:
    """F-12: ``round(clamp(0.65 + 0.3 * |0.5 - p|, 0.01, 0.99), 4)``."""
    return py_round(clamp(F.lit(0.65) + F.lit(0.3) * F.abs(F.lit(0.5) - p), 0.01, 0.99), 4)


def heuristic_columns(income: Column, age: Column, dti: Column, bki: Column) -> dict[str, Column]:
    """F-13: rule score when no model is available.  Missing inputs take
    the defaults.  Returns probability (4 dp), four importances (4 dp) and
    confidence (capped at 0.98, computed on the unrounded probability)."""
    d = HEURISTIC_DEFAULTS
    inc = F.coalesce(income.cast("double"), F.lit(d["income"]))
    ag = F.coalesce(age.cast("double"), F.lit(d["age"]))
    dt = F.coalesce(dti.cast("double"), F.lit(d["debt_to_income"]))
    bk = F.coalesce(bki.cast("double"), F.lit(d["bki_request_cnt"]))
    linear = F.lit(0.45) + dt * 0.7 + bk * 0.04 - inc / 300000.0 - ag / 400.0
    prob = clamp(linear, 0.01, 0.99)
    conf = F.least(F.lit(0.98), py_round(F.lit(0.65) + F.lit(0.3) * F.abs(F.lit(0.5) - prob), 4))
    return {
        "default_probability": py_round(prob, 4),
        "imp_debt_to_income": py_round(F.least(F.lit(0.35), dt * 0.5), 4),
        "imp_bki_request_cnt": py_round(F.least(F.lit(0.2), bk * 0.03), 4),
        "imp_income": py_round(F.greatest(F.lit(-0.25), -(inc / 500000.0)), 4),
        "imp_age": py_round(F.greatest(F.lit(-0.1), -(ag / 1000.0)), 4),
        "confidence": conf,
    }


def explanation_confidence(sum_abs_impact: Column) -> Column:
    """F-14: ``min(0.99, round(0.7 + min(0.25, sum|impact| / 2), 4))``."""
    return F.least(F.lit(0.99), py_round(
        F.lit(0.7) + F.least(F.lit(0.25), sum_abs_impact / 2.0), 4))


def coerce_form_int(text: Column) -> Column:
    """F-18: blank -> null, else integer (bad text -> null)."""
    t = F.trim(text)
    return F.when(t == "", F.lit(None).cast("int")).otherwise(t.try_cast("int"))


def coerce_form_money(text: Column) -> Column:
    """F-18: ``x and float(x) or None``: blank or zero -> null."""
    v = F.trim(text).try_cast("double")
    return F.when(v == 0, F.lit(None).cast("double")).otherwise(v)


def coerce_form_flag(text: Column) -> Column:
    """F-18: only the text 'True' is true."""
    return F.coalesce(text == "True", F.lit(False))
