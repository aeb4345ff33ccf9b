"""Typed CSV datasets (S-04 .. S-07, P-01 .. P-07, K-05).

A file is read with every column as text, its header checked against the
dataset registry, then each column is coerced by one expression:
integers as ``int(float(text))`` (truncating; bad text -> null), doubles as
``float(text)``, text with '' -> null, foreign keys as integer text when
numeric and the raw text otherwise.  Junk columns can be filled (enrich)
and are dropped (strip) last, so strip wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.pytext import py_double_str
from ..functions.requests import py_float
from ..operators.conform import missing_columns, normalize_columns
from ..schemas import DATASETS, FOREIGN_KEYS, DatasetSpec

# ---- fixed values: junk-column enrichment (constants and derived text) ----
ENRICH_CONSTANTS = {
    "application_train": {"internal_sync_token": "PENDING_MIGRATION"},
    "application_test": {"export_batch_label": "BATCH_UNKNOWN"},
    "installments_payments": {"source_file_row_no": 0.0},
    "pos_cash_balance": {"abs_operator_note": ""},
}


def _enrich_derived(key: str) -> dict[str, Column]:
    if key == "application_train":
        inc = F.col("amt_income_total")
        return {"legacy_amt_income_text": F.when(inc.isNull() | (inc == 0), F.lit("")).otherwise(py_double_str(inc))}
    if key == "bureau":
        return {"old_sys_bureau_ref": F.concat(F.lit("LEG-"), F.coalesce(F.col("sk_id_bureau").cast("string"), F.lit("None")))}
    if key == "bureau_balance":
        return {"raw_status_dump": F.concat(F.lit("status="), F.coalesce(F.col("status"), F.lit("None")), F.lit("|raw"))}
    return {}


def text_schema(spec: DatasetSpec, include_junk: bool = False) -> StructType:
    """All-text schema with upper-case names, as the source files carry them."""
    return StructType([StructField(c.upper(), StringType(), True)
                       for c, _ in spec.columns if include_junk or c not in spec.junk])


def coerce(text: Column, typ: str, foreign_key: bool = False) -> Column:
    blank = text.isNull() | (text == "")
    if foreign_key:
        as_int = py_float(text).try_cast("bigint").cast("string")
        return F.when(blank, F.lit(None).cast("string")).otherwise(F.coalesce(as_int, text))
    if typ in ("int", "bigint"):
        return F.when(blank, F.lit(None).cast(typ)).otherwise(py_float(text).try_cast(typ))
    if typ == "double":
        return F.when(blank, F.lit(None).cast("double")).otherwise(py_float(text))
    return F.when(blank, F.lit(None).cast("string")).otherwise(text)


def typed(raw: DataFrame, key: str, strip_junk: bool = True, enrich_junk: bool = False,
          limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """S-05 on an all-text frame: header check, coercion, enrich, strip, limit."""
    spec = DATASETS[key]
    df = normalize_columns(raw)
    missing = missing_columns(df, spec.data_columns)
    if missing:
        more = "..." if len(missing) > 10 else ""
        raise ValueError(f"{key}: missing columns: {', '.join(c.upper() for c in missing[:10])}{more}")
    fks = set(FOREIGN_KEYS.get(key, ()))
    have = set(df.columns)
    cols = []
    for c, t in spec.columns:
        if c in spec.junk:
            src = F.col(c) if c in have else F.lit(None).cast("string")
            cols.append(coerce(src, t).alias(c) if c in have else src.cast(t).alias(c))
        else:
            cols.append(coerce(F.col(c), t, c in fks).alias(c))
    out = df.select(*cols)
    if enrich_junk:
        derived = _enrich_derived(key)
        consts = {k: F.lit(v) for k, v in ENRICH_CONSTANTS.get(key, {}).items()}
        out = out.withColumns({**{k: v.cast(spec.types()[k]) for k, v in consts.items()}, **derived})
    if strip_junk:
        out = out.drop(*spec.junk)
    if limit is not None:
        # all columns break ties, so the extract is the same in every run
        first = [order_by] if order_by else list(spec.keys)
        out = out.orderBy(*first, *[c for c in out.columns if c not in first]).limit(limit)
    return out


def read_raw(spark: SparkSession, path: str, encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    """Quotes inside a quoted field are doubled.  ``multiline`` allows line ends
    inside quotes; such a file can't be split and is read by one task."""
    return (spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
            .option("multiLine", multiline).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))


CORRUPT = "_corrupt_record"
_PLACE = ("_file", "_block", "_at")
REJECTS = ("file", "record", "column", "text", "reason")


def read_checked(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """All-text rows by the header, the raw text of lines with another number of
    fields, and where each row stands."""
    header = read_raw(spark, path, encoding).schema
    schema = StructType([*header.fields, StructField(CORRUPT, StringType(), True)])
    rows = (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))
    return rows.select("*", F.col("_metadata.file_path").alias(_PLACE[0]), F.col("_metadata.file_block_start").alias(_PLACE[1]),
                       F.monotonically_increasing_id().alias(_PLACE[2]))


def _fault(text: Column, typ: str, foreign_key: bool) -> Column:
    """Why a field that is not blank has no value, null if it has one."""
    if typ == "string" or foreign_key:
        return F.lit(None).cast("string")
    number = py_float(text)
    endless = F.lower(F.trim(text)).rlike("^[+-]?inf(inity)?$") | F.coalesce(F.abs(number) == float("inf"), F.lit(False))
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(endless, F.lit("infinite")).when(
        number.isNull(), F.lit("not a number")).when(coerce(text, typ).isNull(), F.lit("out of range"))


def rejects(checked: DataFrame, key: str) -> DataFrame:
    """P-03: (file, record, column, text, reason) of every field that became null
    or is infinite, and (without a column) of every line with another number of
    fields than the header, whose missing fields are null.  ``record`` counts
    the rows of a file from 1; empty lines and the header are none.

    Rows are numbered where they are read: the first number and the count of
    each part of a file (one row per part) place them."""
    spec = DATASETS[key]
    raw = normalize_columns(checked)
    have, fks = set(raw.columns), set(FOREIGN_KEYS.get(key, ()))
    cell = "struct<column:string,text:string,reason:string>"
    faults = [F.struct(F.lit(c).alias("column"), F.col(c).alias("text"), _fault(F.col(c), t, c in fks).alias("reason"))
              for c, t in spec.columns if c in have and t != "string"]
    ragged = F.when(F.col(CORRUPT).isNotNull(), F.array(F.struct(
        F.lit(None).cast("string").alias("column"), F.col(CORRUPT).alias("text"), F.lit("wrong number of fields").alias("reason"))))
    found = F.concat(F.coalesce(ragged, F.array().cast(f"array<{cell}>")),
                     F.filter(F.array(*faults), lambda x: x["reason"].isNotNull()).cast(f"array<{cell}>"))
    bad = raw.select(*_PLACE, F.inline(found))
    parts = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return bad.join(parts, ["_file", "_block"]).select(
        F.col("_file").alias("file"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("record"), "column", "text", "reason")


def load_checked(spark: SparkSession, key: str, path: str, strip_junk: bool = True, enrich_junk: bool = False,
                 encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects) of a file: S-05 with its faults told."""
    checked = read_checked(spark, path, encoding)
    return typed(checked.drop(CORRUPT, *_PLACE), key, strip_junk, enrich_junk), rejects(checked, key)


def load_file(spark: SparkSession, key: str, path: str, strip_junk: bool = True,
              enrich_junk: bool = False, limit: int | None = None, encoding: str = "utf-8",
              multiline: bool = False) -> DataFrame:
    return typed(read_raw(spark, path, encoding, multiline), key, strip_junk, enrich_junk, limit)


def write_csv(df: DataFrame, path: str, upper: bool = True) -> None:
    """K-05: headered CSV (one folder of part files)."""
    out = df.toDF(*[c.upper() for c in df.columns]) if upper else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_directory(spark: SparkSession, directory: str, datasets=None, strip_junk: bool = True,
                   enrich_junk: bool = False, limit_per_file: int | None = None):
    """S-06: every known dataset under ``directory/<file name>``; a missing or
    malformed file gives an error row and does not stop the others.
    Returns (frames, status) where status has one row per dataset."""
    frames: dict[str, DataFrame] = {}
    status_rows = []
    counts = []
    for key in datasets or list(DATASETS):
        spec = DATASETS[key]
        path = f"{directory.rstrip('/')}/{spec.filename}"
        try:
            df = load_file(spark, key, path, strip_junk, enrich_junk, limit_per_file)
        except Exception as exc:  # noqa: BLE001  (file missing or header wrong)
            status_rows.append((key, spec.filename, 0, False, _short_error(exc)))
            continue
        frames[key] = df
        counts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(key).alias("dataset"), F.lit(spec.filename).alias("filename"), "row_count",
            F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
    schema = "dataset string, filename string, row_count bigint, ok boolean, error string"
    status = spark.createDataFrame(status_rows, schema)
    for c in counts:
        status = status.unionByName(c)
    return frames, status


def _short_error(exc: Exception) -> str:
    text = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
    if "PATH_NOT_FOUND" in text or "Path does not exist" in text:
        return "file not found"
    return text[:200]
