"""S-09 / S-10: training-set source with a fallback chain.  When the
warehouse mart is empty or missing, a deterministic synthetic set is
generated by Spark itself (``spark.range`` + hash-derived columns: the same
rows on every run and executor, no driver-side data).  Used only as the
fallback of ``training_source``; no registered query runs on it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values of the reference's fallback set ----
SYNTHETIC_ROWS = 1000
POSITIVE_SHARE = 0.2


def _u(i: Column, salt: str) -> Column:
    """Uniform [0, 1) from a hash of (row, salt)."""
    return (F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(salt))), 1, 12), 16, 10)
            .cast("double") / float(16 ** 12))


def synthetic_training_set(spark: SparkSession, n: int = SYNTHETIC_ROWS) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        (F.lit(100000) + i).alias("sk_id_curr"),
        (_u(i, "target") < POSITIVE_SHARE).cast("int").alias("target"),
        (F.lit(20000.0) + _u(i, "inc") * 480000.0).alias("amt_income_total"),
        (F.lit(50000.0) + _u(i, "cred") * 1950000.0).alias("amt_credit"),
        (F.lit(5000.0) + _u(i, "ann") * 95000.0).alias("amt_annuity"),
        F.element_at(F.array(F.lit("M"), F.lit("F")), (_u(i, "g") * 2).cast("int") + 1).alias("code_gender"),
        F.element_at(F.array(F.lit("Cash loans"), F.lit("Revolving loans")),
                     (_u(i, "t") * 2).cast("int") + 1).alias("name_contract_type"),
        (-(F.lit(7000) + (_u(i, "age") * 18000).cast("int"))).alias("days_birth"),
        (_u(i, "ch") * 4).cast("int").alias("cnt_children"),
        _u(i, "e1").alias("ext_source_1"), _u(i, "e2").alias("ext_source_2"), _u(i, "e3").alias("ext_source_3"),
    )


def training_source(spark: SparkSession, mart_path: str | None) -> DataFrame:
    """The mart if it exists and has rows, else the synthetic set."""
    if mart_path:
        try:
            mart = spark.read.parquet(mart_path)
            if not mart.isEmpty():
                return mart
        except AnalysisException as e:        # only a missing table falls back
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return synthetic_training_set(spark)
