"""Files -> model features (C-09): child-table aggregates joined to the
applications, text columns label-encoded, gaps filled with -1.

Every child table is reduced to one row per application in a single
aggregation before it meets the application table, so the four left joins
are 1:1 on ``sk_id_curr`` and keep the application row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import (
    child_aggregate, fill_minus_one, label_encode, string_columns,
)
from ..schemas import DATASETS
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import staged

KEY = "sk_id_curr"


def child_features(bureau: DataFrame, cc: DataFrame, pos: DataFrame, prev: DataFrame) -> list[DataFrame]:
    pos_agg = child_aggregate(pos, KEY, ["sk_id_prev"], ["name_contract_status"], "pos",
                              lambda c: "nunique_status_pos_cash")
    cc_agg = child_aggregate(cc, KEY, ["sk_id_prev"], ["name_contract_status"], "cc",
                             lambda c: "nunique_status_credit_card")
    bureau_agg = child_aggregate(bureau, KEY, ["sk_id_bureau"], string_columns(bureau), "bureau",
                                 lambda c: f"nunique_{c}_bureau")
    prev_agg = child_aggregate(prev, KEY, ["sk_id_prev"], string_columns(prev), "prev",
                               lambda c: f"nunique_{c}_prev_app")
    return [pos_agg, cc_agg, bureau_agg, prev_agg]


def assemble(app: DataFrame, children: list[DataFrame]) -> DataFrame:
    out = app
    for agg in children:
        out = out.join(agg, KEY, "left")
    return out


def file_features(app_train: DataFrame, app_test: DataFrame, bureau: DataFrame, cc: DataFrame,
                  pos: DataFrame, prev: DataFrame, encode_fit: str = "separate") -> tuple[DataFrame, DataFrame]:
    """Returns (train, test).  Train keeps ``sk_id_curr`` and ``target``
    beside the features, test keeps ``sk_id_curr`` (the reference writes
    them to separate id/target files).  ``encode_fit='separate'`` fits the
    label codes on each frame (reference behaviour, D19); ``'train'`` reuses
    the training classes for the test frame (unseen -> -1)."""
    # both frames join the children: they are aggregated once
    ensure_checkpoint_dir(app_train.sparkSession)
    children = [c.checkpoint() for c in child_features(bureau, cc, pos, prev)]
    train = assemble(app_train, children)
    test = assemble(app_test, children)
    cats = string_columns(train, exclude=(KEY,))
    train_enc = label_encode(train, cats)
    test_cats = [c for c in cats if c in test.columns]
    test_enc = label_encode(test, test_cats, fit=None if encode_fit == "separate" else train)
    return (fill_minus_one(train_enc, exclude=(KEY, "target")),
            fill_minus_one(test_enc, exclude=(KEY,)))


def staged_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Driver-table fixtures as the six files of the reference (junk stripped);
    applications without a known target form the test file (U-02)."""
    app = staged(spark, sf_dir, "stg_application").drop(*DATASETS["application_train"].junk)
    return {
        "app_train": app.where(F.col("target").isNotNull()),
        "app_test": app.where(F.col("target").isNull()).drop("target"),
        "bureau": staged(spark, sf_dir, "stg_bureau"),
        "cc": staged(spark, sf_dir, "stg_credit_card_balance"),
        "pos": staged(spark, sf_dir, "stg_pos_cash_balance"),
        "prev": staged(spark, sf_dir, "stg_previous_application"),
    }


def file_features_from(spark: SparkSession, sf_dir: str, encode_fit: str = "separate"):
    i = staged_inputs(spark, sf_dir)
    return file_features(i["app_train"], i["app_test"], i["bureau"], i["cc"], i["pos"], i["prev"], encode_fit)
