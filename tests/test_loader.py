"""The reference's three loader tests, on DataFrames, plus coercion goldens."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from creditlake.operators.conform import missing_columns, strip_junk
from creditlake.schemas import DATASETS, get_dataset_spec
from creditlake.sources import csv as CSV


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="creditlake-test-")
    with open(os.path.join(d, "f.csv"), "w") as fh:
        fh.write(text)
    return d


def test_load_bureau_balance(spark):
    path = _write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,0\n")
    df = CSV.load_file(spark, "bureau_balance", path)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0].sk_id_bureau == "1" and rows[0].months_balance == -1 and rows[0].status == "0"


def test_strip_junk_helper(spark):
    df = spark.createDataFrame([(100001, "270000.0", "PENDING")],
                               "sk_id_curr long, legacy_amt_income_text string, internal_sync_token string")
    out = strip_junk(df, DATASETS["application_train"])
    assert out.columns == ["sk_id_curr"]


def test_validate_headers_missing(spark):
    df = spark.createDataFrame([("1",)], "SK_ID_BUREAU string")
    assert "months_balance" in missing_columns(df, get_dataset_spec("bureau_balance").data_columns)
    with pytest.raises(ValueError, match="MONTHS_BALANCE"):
        CSV.typed(df, "bureau_balance")


def test_unknown_dataset():
    with pytest.raises(KeyError):
        get_dataset_spec("nope")


def test_integer_coercion_truncates_and_nulls(spark):
    path = _write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1.9,X\n2,,\n3,abc,C\n4,1.5d,C\n5,inf,C\n6,2e1,C\n")
    df = CSV.load_file(spark, "bureau_balance", path).orderBy("sk_id_bureau")
    got = [(r.sk_id_bureau, r.months_balance, r.status) for r in df.collect()]
    assert got == [("1", -1, "X"), ("2", None, None), ("3", None, "C"), ("4", None, "C"), ("5", None, "C"),
                   ("6", 20, "C")]


def test_foreign_key_keeps_text(spark):
    path = _write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n7.0,1,A\nLEG-9,2,B\n")
    got = sorted(r.sk_id_bureau for r in CSV.load_file(spark, "bureau_balance", path).collect())
    assert got == ["7", "LEG-9"]


def test_enrich_then_strip(spark):
    path = _write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,\n")
    kept = CSV.load_file(spark, "bureau_balance", path, strip_junk=False, enrich_junk=True).first()
    assert kept.raw_status_dump == "status=None|raw"
    stripped = CSV.load_file(spark, "bureau_balance", path, strip_junk=True, enrich_junk=True)
    assert "raw_status_dump" not in stripped.columns


def test_directory_load_reports_missing(spark):
    d = tempfile.mkdtemp(prefix="creditlake-dir-")
    os.makedirs(os.path.join(d, "bureau_balance.csv"))
    with open(os.path.join(d, "bureau_balance.csv", "part-0.csv"), "w") as fh:
        fh.write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,0\n2,-2,C\n")
    frames, status = CSV.load_directory(spark, d)
    st = {r.dataset: (r.row_count, r.ok, r.error) for r in status.collect()}
    assert st["bureau_balance"] == (2, True, None)
    assert st["bureau"][1] is False and st["bureau"][2] == "file not found"
    assert set(frames) == {"bureau_balance"}
    assert F is not None


def test_quoted_fields(spark):
    path = _write('SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,"say ""hi"", ok"\n2,-2,"a\nb"\n')
    rows = CSV.load_file(spark, "bureau_balance", path, multiline=True).orderBy("sk_id_bureau").collect()
    assert [(r.sk_id_bureau, r.status) for r in rows] == [("1", 'say "hi", ok'), ("2", "a\nb")]


def test_stream_maps_each_file_by_its_header(spark, tmp_path):
    from creditlake.streaming.jobs import ingest_csv_stream
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text('MONTHS_BALANCE,RAW_STATUS_DUMP,STATUS,SK_ID_BUREAU\n-1,junk,"C, ""x""",555\n')
    (src / "b.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n7,-2,X\n")
    (src / "c.csv").write_text("SK_ID_BUREAU,STATUS\n8,X\n")
    out = str(tmp_path / "out")
    ingest_csv_stream(spark, "bureau_balance", str(src), out, str(tmp_path / "ckpt")).awaitTermination()
    rows = spark.read.parquet(out).orderBy("sk_id_bureau").collect()
    assert [(r.sk_id_bureau, r.months_balance, r.status) for r in rows] == [("555", -1, 'C, "x"'), ("7", -2, "X")]
    bad = spark.read.parquet(f"{out}_errors").collect()
    assert len(bad) == 1 and bad[0].path.endswith("c.csv") and "MONTHS_BALANCE" in bad[0].error


def test_required_inputs_are_listed():
    from creditlake.plans.quality import REQUIRED_FILES, require_inputs
    require_inputs(REQUIRED_FILES)
    with pytest.raises(FileNotFoundError, match="bureau, pos_cash_balance"):
        require_inputs([f for f in REQUIRED_FILES if f not in ("bureau", "pos_cash_balance")])


def test_rejects_are_told(spark):
    path = _write('SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,0\n2,abc,C\n\n3,inf,"a, b"\n4,,X\n5,1e999\n6,3000000000,C,more\n7,-1.9,\n')
    rows, bad = CSV.load_checked(spark, "bureau_balance", path)
    got = sorted((r.record, r.column, r.text, r.reason) for r in bad.collect() if r.column)
    assert got == [(2, "months_balance", "abc", "not a number"), (3, "months_balance", "inf", "infinite"),
                   (5, "months_balance", "1e999", "infinite"), (6, "months_balance", "3000000000", "out of range")]
    lines = sorted((r.record, r.text, r.reason) for r in bad.collect() if not r.column)
    assert lines == [(5, "5,1e999", "wrong number of fields"), (6, "6,3000000000,C,more", "wrong number of fields")]
    assert all(r.file.endswith("f.csv") for r in bad.collect())
    assert sorted((r.sk_id_bureau, r.months_balance, r.status) for r in rows.collect())[4] == ("5", None, None)
    assert rows.count() == 7


def test_reject_records_count_through_file_parts(spark):
    path = _write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n" + "".join(f"{i},{'x' if i % 100 == 0 else i},C\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        _, bad = CSV.load_checked(spark, "bureau_balance", path)
        assert bad.sparkSession.read.text(path).rdd.getNumPartitions() > 4
        assert sorted(r.record for r in bad.collect()) == list(range(100, 3001, 100))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream_scans_lines_once(spark, tmp_path):
    """Quoted commas, blank lines, many parts of a file, extra columns, and files
    whose first line lacks columns."""
    from creditlake.streaming.jobs import lines_by_header
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(" months_balance ,EXTRA,STATUS,SK_ID_BUREAU\n" + "".join(f'-{i},x,"s, ""{i}""",{i}\n\n' for i in range(1, 900)))
    (src / "b.csv").write_text("STATUS,OTHER\nX,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = spark.read.text(str(src)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        good, bad = lines_by_header(lines, "bureau_balance")
        rows = {r.sk_id_bureau: (r.months_balance, r.status) for r in CSV.typed(good, "bureau_balance").collect()}
        assert rows == {str(i): (-i, f's, "{i}"') for i in range(1, 900)}
        assert [(r.path[-5:], r.error) for r in bad.collect()] == [("b.csv", "bureau_balance: missing columns: SK_ID_BUREAU, MONTHS_BALANCE")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
