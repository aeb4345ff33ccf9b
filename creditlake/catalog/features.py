"""Feature queries: A-01, A-06, A-07, W-02, C-09, U-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import label_encode, mean_all, nunique_null_as_category
from ..plans import explain as X
from ..plans.file_features import file_features_from
from ..sources.fixtures import adapter_columns, staged
from . import register
from .sqlkit import with_ctes


def _mean_sql(c: str, is_double: bool) -> str:
    x = f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,10))" if is_double else c
    return f"CAST(SUM({x}) AS DOUBLE) / COUNT({x})"


# ---- A-01: counts and means per decision status ----
def agg_status(spark, sf_dir):
    s = X.score_heuristic(staged(spark, sf_dir, "crm_score_request"))
    s = s.withColumn("status", F.expr("CASE WHEN default_probability < 0.3 THEN 'approve' "
                                      "WHEN default_probability < 0.5 THEN 'conditionally_approve' "
                                      "ELSE 'conditionally_reject' END"))
    return s.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum("age"), F.count("age")).alias("avg_age"),
        F.try_divide(F.sum(F.col("income").cast("decimal(38,10)")).cast("double"), F.count("income")).alias("avg_income"),
        F.try_divide(F.sum(F.col("debt_to_income").cast("decimal(38,10)")).cast("double"),
                     F.count("debt_to_income")).alias("avg_debt_ratio"))


def _agg_status_sql():
    from .explain import SCORE_CTES
    return with_ctes(
        "SELECT status, count(*) AS n, SUM(age) / COUNT(age) AS avg_age, "
        f"{_mean_sql('income', True)} AS avg_income, {_mean_sql('debt_to_income', True)} AS avg_debt_ratio "
        "FROM (SELECT *, CASE WHEN default_probability < 0.3 THEN 'approve' WHEN default_probability < 0.5 "
        "THEN 'conditionally_approve' ELSE 'conditionally_reject' END AS status FROM scored) GROUP BY status",
        ("crm_score_request",), **{k: SCORE_CTES[k] for k in ("h", "s", "scored")})


register("agg_status", _agg_status_sql())(agg_status)


# ---- A-06: mean of every numeric column per key ----
def feat_mean_all(spark, sf_dir):
    return mean_all(staged(spark, sf_dir, "stg_bureau"), "sk_id_curr", exclude=("sk_id_bureau",))


_BUREAU_NUM = {"days_credit": False, "amt_credit_sum": True, "amt_credit_sum_debt": True,
               "amt_credit_sum_overdue": True, "days_credit_enddate": True}
register("feat_mean_all", with_ctes(
    "SELECT sk_id_curr, " + ", ".join(f"{_mean_sql(c, d)} AS {c}" for c, d in _BUREAU_NUM.items())
    + " FROM stg_bureau WHERE sk_id_curr IS NOT NULL GROUP BY sk_id_curr", ("stg_bureau",)))(feat_mean_all)


# ---- A-07: distinct counts, null as a category and null ignored ----
def feat_nunique_nullcat(spark, sf_dir):
    b = staged(spark, sf_dir, "stg_bureau").where(F.col("sk_id_curr").isNotNull())
    return b.groupBy("sk_id_curr").agg(
        nunique_null_as_category("credit_type").alias("credit_type_nunique_nan"),
        F.count_distinct("credit_type").alias("credit_type_nunique"),
        nunique_null_as_category("credit_active").alias("credit_active_nunique_nan"))


register("feat_nunique_nullcat", with_ctes(
    "SELECT sk_id_curr, count(DISTINCT coalesce(credit_type, 'nan')) AS credit_type_nunique_nan, "
    "count(DISTINCT credit_type) AS credit_type_nunique, "
    "count(DISTINCT coalesce(credit_active, 'nan')) AS credit_active_nunique_nan "
    "FROM stg_bureau WHERE sk_id_curr IS NOT NULL GROUP BY sk_id_curr", ("stg_bureau",)))(feat_nunique_nullcat)


# ---- W-02: label encoding ----
def label_encode_q(spark, sf_dir):
    b = staged(spark, sf_dir, "stg_bureau").select("sk_id_bureau", "credit_type", "credit_active")
    enc = label_encode(b, ["credit_type", "credit_active"])
    return enc.select("sk_id_bureau", F.col("credit_type").alias("credit_type_code"),
                      F.col("credit_active").alias("credit_active_code"))


def _code_sql(c: str, src: str) -> str:
    return (f"(SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
            f"(SELECT DISTINCT coalesce({c}, 'nan') AS v FROM {src}))")


register("label_encode", with_ctes(
    "SELECT b.sk_id_bureau, t.code AS credit_type_code, a.code AS credit_active_code FROM stg_bureau b "
    f"JOIN {_code_sql('credit_type', 'stg_bureau')} t ON t.v = coalesce(b.credit_type, 'nan') "
    f"JOIN {_code_sql('credit_active', 'stg_bureau')} a ON a.v = coalesce(b.credit_active, 'nan')",
    ("stg_bureau",)))(label_encode_q)


# ---- C-09: file features (train and test) ----
def file_features(spark, sf_dir):
    return file_features_from(spark, sf_dir)[0]


def file_features_test(spark, sf_dir):
    return file_features_from(spark, sf_dir)[1]


_APP_COLS = [c for c in adapter_columns("stg_application") if c != "internal_sync_token"]
_APP_TEXT = ["name_contract_type", "code_gender", "organization_type"]
_APP_INT = {"sk_id_curr", "target", "cnt_children", "flag_mobil", "flag_email", "region_rating_client",
            "days_birth", "flag_document_2", "flag_document_10"}
_CHILD = {
    "pos": ("stg_pos_cash_balance", ["sk_id_curr", "months_balance", "cnt_instalment", "cnt_instalment_future",
                                     "sk_dpd", "sk_dpd_def"],
            {"months_balance": False, "cnt_instalment": True, "cnt_instalment_future": True,
             "sk_dpd": False, "sk_dpd_def": False},
            [("name_contract_status", "nunique_status_pos_cash")]),
    "cc": ("stg_credit_card_balance", None,
           {"months_balance": False, "amt_balance": True, "amt_credit_limit_actual": True,
            "sk_dpd": False, "sk_dpd_def": False},
           [("name_contract_status", "nunique_status_credit_card")]),
    "bureau": ("stg_bureau", None, _BUREAU_NUM,
               [("credit_active", "nunique_credit_active_bureau"), ("credit_type", "nunique_credit_type_bureau")]),
    "prev": ("stg_previous_application", None,
             {"amt_application": True, "amt_credit": True, "amt_annuity": True, "amt_down_payment": True,
              "amt_goods_price": True},
             [("name_contract_status", "nunique_name_contract_status_prev_app"),
              ("name_product_type", "nunique_name_product_type_prev_app"),
              ("name_payment_type", "nunique_name_payment_type_prev_app")]),
}


def _child_cte(prefix: str) -> str:
    src, _, nums, cats = _CHILD[prefix]
    cols = [f"{_mean_sql(c, d)} AS {prefix}_{c}" for c, d in nums.items()]
    cols += [f"CAST(count(DISTINCT coalesce({c}, 'nan')) AS DOUBLE) AS {prefix}_{n}" for c, n in cats]
    return f"SELECT sk_id_curr, {', '.join(cols)} FROM {src} WHERE sk_id_curr IS NOT NULL GROUP BY sk_id_curr"


def _file_sql(part: str) -> str:
    app_cols = [c for c in _APP_COLS if not (part == "test" and c == "target")]
    where = "target IS NOT NULL" if part == "train" else "target IS NULL"
    ctes = {f"c_{p}": _child_cte(p) for p in _CHILD}
    ctes["base"] = (f"SELECT {', '.join(app_cols)} FROM stg_application WHERE {where}")
    for c in _APP_TEXT:
        ctes[f"m_{c}"] = _code_sql(c, "base")
    sel = []
    for c in app_cols:
        if c in _APP_TEXT:
            sel.append(f"m_{c}.code AS {c}")
        elif c in ("sk_id_curr", "target"):
            sel.append(f"b.{c}")
        else:
            sel.append(f"coalesce(b.{c}, -1) AS {c}")
    for p, (_, _, nums, cats) in _CHILD.items():
        sel += [f"coalesce({p}_{c}, -1) AS {p}_{c}" for c in nums]
        sel += [f"coalesce({p}_{n}, -1) AS {p}_{n}" for _, n in cats]
    joins = " ".join(f"LEFT JOIN c_{p} USING (sk_id_curr)" for p in _CHILD)
    joins += " " + " ".join(f"JOIN m_{c} ON m_{c}.v = coalesce(b.{c}, 'nan')" for c in _APP_TEXT)
    body = f"SELECT {', '.join(sel)} FROM base b {joins}"
    return with_ctes(body, ("stg_application", "stg_bureau", "stg_previous_application",
                            "stg_pos_cash_balance", "stg_credit_card_balance"), **ctes)


register("file_features", _file_sql("train"))(file_features)
register("file_features_test", _file_sql("test"))(file_features_test)


# ---- U-02: application train and test as one hub source ----
def union_train_test(spark, sf_dir):
    from ..plans.file_features import staged_inputs
    i = staged_inputs(spark, sf_dir)
    train = i["app_train"].select("sk_id_curr", "target", F.lit("train").alias("split"))
    test = i["app_test"].select("sk_id_curr", F.lit("test").alias("split"))
    return train.unionByName(test, allowMissingColumns=True)


register("union_train_test", with_ctes(
    "SELECT sk_id_curr, target, CASE WHEN target IS NULL THEN 'test' ELSE 'train' END AS split "
    "FROM stg_application", ("stg_application",)))(union_train_test)
