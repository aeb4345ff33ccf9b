"""Source and cleaning queries (S-03..S-07, P-01..P-07, P-12, P-13, K-05)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.conform import conform, fill_nulls, normalize_columns, strip_junk
from ..schemas import DATASETS
from ..session import scratch_path
from ..sources import csv as CSV
from ..sources.fixtures import adapter_columns, staged
from . import register
from .sqlkit import with_ctes


def _csv_roundtrip(spark, sf_dir, adapter: str, key: str, name: str, include_junk=False) -> str:
    """Write the adapter's rows as the dataset's CSV file (all columns,
    upper-case header) under the shared scratch folder; return the folder."""
    spec = DATASETS[key]
    df = conform(staged(spark, sf_dir, adapter), spec, keep_junk=include_junk)
    path = scratch_path(spark, name)
    CSV.write_csv(df, path)
    return path


def src_csv_typed(spark, sf_dir):
    path = _csv_roundtrip(spark, sf_dir, "stg_bureau", "bureau", "bureau_csv")
    return CSV.load_file(spark, "bureau", path)


_BUREAU_TYPES = dict(DATASETS["bureau"].columns)


def _typed_bureau_sql() -> str:
    have = set(adapter_columns("stg_bureau"))
    cols = []
    for c in DATASETS["bureau"].data_columns:
        t = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}[_BUREAU_TYPES[c]]
        if c == "sk_id_curr":
            cols.append("CAST(sk_id_curr AS VARCHAR) AS sk_id_curr")
        elif c in have:
            cols.append(f"CAST({c} AS {t}) AS {c}")
        else:
            cols.append(f"CAST(NULL AS {t}) AS {c}")
    return with_ctes(f"SELECT {', '.join(cols)} FROM stg_bureau", ("stg_bureau",))


register("src_csv_typed", _typed_bureau_sql())(src_csv_typed)


def src_csv_enrich(spark, sf_dir):
    """P-06 before P-07: application file enriched, junk kept for inspection."""
    path = _csv_roundtrip(spark, sf_dir, "stg_application", "application_train", "app_csv")
    df = CSV.load_file(spark, "application_train", path, strip_junk=False, enrich_junk=True)
    return df.select("sk_id_curr", "amt_income_total", "legacy_amt_income_text", "internal_sync_token")


register("src_csv_enrich", with_ctes(
    "SELECT sk_id_curr, amt_income_total, CASE WHEN amt_income_total IS NULL OR amt_income_total = 0 THEN '' "
    "ELSE CAST(amt_income_total AS VARCHAR) END AS legacy_amt_income_text, "
    "'PENDING_MIGRATION' AS internal_sync_token FROM stg_application", ("stg_application",)))(src_csv_enrich)


def src_csv_bureau_balance(spark, sf_dir):
    """S-05 on a multi-row dataset with enrichment and strip together (strip wins)."""
    path = _csv_roundtrip(spark, sf_dir, "stg_bureau_balance", "bureau_balance", "bb_csv")
    enriched = CSV.load_file(spark, "bureau_balance", path, strip_junk=False, enrich_junk=True)
    stripped = CSV.load_file(spark, "bureau_balance", path, strip_junk=True, enrich_junk=True)
    return enriched.select("sk_id_bureau", "months_balance", "status", "raw_status_dump").withColumn(
        "stripped_columns", F.lit(",".join(stripped.columns)))


register("src_csv_bureau_balance", with_ctes(
    "SELECT CAST(sk_id_bureau AS VARCHAR) AS sk_id_bureau, months_balance, status, "
    "'status=' || coalesce(status, 'None') || '|raw' AS raw_status_dump, "
    "'sk_id_bureau,months_balance,status' AS stripped_columns FROM stg_bureau_balance",
    ("stg_bureau_balance",)))(src_csv_bureau_balance)


_DIR_FILES = (("stg_bureau", "bureau"), ("stg_bureau_balance", "bureau_balance"),
              ("stg_previous_application", "previous_application"))


def src_csv_directory_status(spark, sf_dir):
    """S-06: three of the eight dataset files present; the others are
    reported as missing without stopping the load."""
    root = scratch_path(spark, "csv_dir")
    for adapter, key in _DIR_FILES:
        spec = DATASETS[key]
        df = conform(staged(spark, sf_dir, adapter), spec)
        CSV.write_csv(df, f"{root}/{spec.filename}")
    _, status = CSV.load_directory(spark, root)
    return status


def _dir_status_sql() -> str:
    rows = []
    present = {k for _, k in _DIR_FILES}
    for key, spec in DATASETS.items():
        if key in present:
            adapter = [a for a, k in _DIR_FILES if k == key][0]
            rows.append(f"SELECT '{key}' AS dataset, '{spec.filename}' AS filename, "
                        f"(SELECT count(*) FROM {adapter}) AS row_count, true AS ok, CAST(NULL AS VARCHAR) AS error")
        else:
            rows.append(f"SELECT '{key}' AS dataset, '{spec.filename}' AS filename, CAST(0 AS BIGINT) AS row_count, "
                        "false AS ok, 'file not found' AS error")
    return with_ctes("\nUNION ALL ".join(rows), tuple(a for a, _ in _DIR_FILES))


register("src_csv_directory_status", _dir_status_sql())(src_csv_directory_status)


def src_ordered_limit(spark, sf_dir):
    """S-03/T-03: ordered extract capped at a row limit (the cap is the
    feature), names normalised to lower case."""
    raw = staged(spark, sf_dir, "stg_bureau")
    upper = raw.toDF(*[f" {c.upper()} " for c in raw.columns])
    return normalize_columns(upper).orderBy("sk_id_bureau").limit(1000)


register("src_ordered_limit", with_ctes(
    "SELECT * FROM stg_bureau ORDER BY sk_id_bureau LIMIT 1000", ("stg_bureau",)))(src_ordered_limit)


def clean_junk(spark, sf_dir):
    return strip_junk(staged(spark, sf_dir, "stg_application"), DATASETS["application_train"])


register("clean_junk", with_ctes(
    "SELECT * EXCLUDE (internal_sync_token) FROM stg_application", ("stg_application",)))(clean_junk)


def clean_dedup_fill(spark, sf_dir):
    """P-13 + P-12: whole-row distinct, then one default for one column."""
    r = staged(spark, sf_dir, "crm_score_request").select(
        "client_id", "age", "income", "debt_to_income", "bki_request_cnt")
    return fill_nulls(r.distinct(), {"debt_to_income": 0.4})


register("clean_dedup_fill", with_ctes(
    "SELECT client_id, age, income, coalesce(debt_to_income, 0.4) AS debt_to_income, bki_request_cnt "
    "FROM (SELECT DISTINCT client_id, age, income, debt_to_income, bki_request_cnt FROM crm_score_request)",
    ("crm_score_request",)))(clean_dedup_fill)


def src_preview(spark, sf_dir):
    """P-17: the first five rows of a typed file, in key order (a preview is
    the feature; the order makes it repeatable)."""
    path = _csv_roundtrip(spark, sf_dir, "stg_bureau_balance", "bureau_balance", "bb_preview")
    return CSV.load_file(spark, "bureau_balance", path).orderBy("sk_id_bureau", "months_balance", "status").limit(5)


register("src_preview", with_ctes(
    "SELECT CAST(sk_id_bureau AS VARCHAR) AS sk_id_bureau, months_balance, status FROM stg_bureau_balance "
    "ORDER BY CAST(sk_id_bureau AS VARCHAR), months_balance, status NULLS FIRST LIMIT 5",
    ("stg_bureau_balance",)))(src_preview)


# faults put into a file of bureau rows: (column, text) where the condition holds, and lines of another length
_DIRTY = (("days_credit", "abc", "sk_id_bureau % 7 = 0"), ("days_credit", "inf", "sk_id_bureau % 11 = 0"),
          ("days_credit", "1e999", "sk_id_bureau % 13 = 0"), ("days_credit", "3000000000", "sk_id_bureau % 29 = 0"),
          ("amt_credit_sum", "n/a", "sk_id_bureau % 17 = 0"))
_SHORT, _LONG = "sk_id_bureau % 19 = 0", "sk_id_bureau % 23 = 0"


def _dirty_text(column: str, otherwise: str) -> str:
    cases = " ".join(f"WHEN {w} THEN '{t}'" for c, t, w in _DIRTY if c == column)
    return f"CASE {cases} ELSE {otherwise} END"


def src_csv_rejects(spark, sf_dir):
    """P-03 / S-05: bureau rows in a file with unreadable fields and lines of
    another length; what the loader nulled or padded, counted, and the rows it
    loaded."""
    spec = DATASETS["bureau"]
    df = conform(staged(spark, sf_dir, "stg_bureau"), spec)
    text = [F.expr(_dirty_text(c, f"CAST({c} AS STRING)")) if any(c == d for d, _, _ in _DIRTY) else F.col(c).cast("string")
            for c in df.columns]
    cells = F.array(*[F.coalesce(t, F.lit("")) for t in text])
    cells = F.when(F.expr(_SHORT), F.slice(cells, 1, len(text) - 2)).when(
        F.expr(_LONG), F.concat(cells, F.array(F.lit("more")))).otherwise(cells)
    header = ",".join(df.columns).upper()

    def with_header(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, names=["value"])
    path = scratch_path(spark, "dirty_csv")
    df.select(F.array_join(cells, ",").alias("value")).mapInArrow(with_header, "value string").write.text(path)
    rows, faults = CSV.load_checked(spark, "bureau", path)
    told = faults.groupBy(F.coalesce("column", F.lit("*")).alias("column_name"),
                          F.when(F.col("column").isNotNull(), F.col("text")).alias("text"), "reason").agg(F.count(F.lit(1)).alias("n"))
    loaded = rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("*").alias("column_name"), F.lit(None).cast("string").alias("text"), F.lit("loaded").alias("reason"), "n")
    return told.unionByName(loaded)


register("src_csv_rejects", with_ctes(
    f"""SELECT * FROM (
SELECT 'days_credit' AS column_name, {_dirty_text('days_credit', 'NULL')} AS text,
       CASE {_dirty_text('days_credit', 'NULL')} WHEN 'abc' THEN 'not a number' WHEN '3000000000' THEN 'out of range' ELSE 'infinite' END AS reason,
       count(*) AS n FROM stg_bureau GROUP BY ALL
UNION ALL SELECT 'amt_credit_sum', {_dirty_text('amt_credit_sum', 'NULL')}, 'not a number', count(*) FROM stg_bureau GROUP BY ALL)
WHERE text IS NOT NULL
UNION ALL SELECT '*', NULL, 'wrong number of fields', count(*) FROM stg_bureau WHERE {_SHORT} OR {_LONG}
UNION ALL SELECT '*', NULL, 'loaded', count(*) FROM stg_bureau""", ("stg_bureau",)))(src_csv_rejects)
