"""Streaming jobs.  Batch and stream share the same transformation
functions; the sinks are idempotent per micro-batch id (a re-run of a
batch after an executor or driver loss rewrites the same folder, or finds its
version of the table committed and changes nothing)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import explain as X
from ..schemas import DATASETS
from ..sources import buckets
from ..sources import csv as CSV
from ..sources.fixtures import ADAPTERS


def _batch_writer(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch_id={batch_id}")
    return write


FILES_PER_BATCH = 64
#: fields of a line that are read, besides twice the dataset's columns
MORE_FIELDS = 64


def _read_files(spark: SparkSession, key: str, paths: list[str], **how) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Each file by its own header; (typed frames, (path, error) of the files
    that can't be read that way)."""
    good, bad = [], []
    for path in paths:
        try:
            good.append(CSV.load_file(spark, key, path, **how))
        except (ValueError, AnalysisException) as e:
            bad.append((path, str(e).strip().splitlines()[0][:200]))
    return good, bad


def _fields(line: Column, n: int) -> Column:
    """The first ``n`` fields of a CSV line as an array of text."""
    row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"'})
    return F.array(*[row[f"c{i}"] for i in range(n)])


def lines_by_header(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV lines (value, file, block: where the line's part of
    the file begins): text columns of dataset ``key``, found in each line by the
    names in the first line of its file; and (path, error) of the files whose
    first line lacks columns, of which no row is returned.

    ``lines`` is read once for both if it is persisted.  One row per file meets
    the lines in a join; nothing is read on the driver."""
    spec = DATASETS[key]
    wanted = [c for c, _ in spec.columns]
    n = 2 * len(wanted) + MORE_FIELDS
    numbered = lines.select("value", "file", "block", F.monotonically_increasing_id().alias("at"))
    first = numbered.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("head_at"))
    names = F.transform(_fields(F.col("header"), n), lambda x: F.lower(F.trim(x)))
    lacking = F.filter(F.array(*[F.lit(c) for c in spec.data_columns]), lambda c: ~F.array_contains(F.col("names"), c))
    heads = first.withColumn("names", F.array_compact(names)).withColumn("lacking", lacking).select(
        "file", "head_at", F.array(*[F.array_position("names", F.lit(c)) for c in wanted]).alias("places"), "lacking")
    more = F.when(F.size("lacking") > 10, F.lit("...")).otherwise(F.lit(""))
    errors = heads.where(F.size("lacking") > 0).select(F.col("file").alias("path"), F.concat(
        F.lit(f"{key}: missing columns: "), F.upper(F.array_join(F.slice("lacking", 1, 10), ", ")), more).alias("error"))
    body = numbered.join(heads.where(F.size("lacking") == 0), "file").where((F.col("at") != F.col("head_at")) & (F.trim("value") != ""))
    body = body.select(_fields(F.col("value"), n).alias("fields"), "places")
    rows = body.select(*[F.get("fields", F.get("places", F.lit(i)) - 1).alias(c) for i, c in enumerate(wanted)])
    return rows, errors


def ingest_csv_stream(spark: SparkSession, key: str, input_dir: str, target_dir: str,
                      checkpoint: str, strip_junk: bool = True, enrich_junk: bool = False,
                      available_now: bool = True, multiline: bool = False):
    """R-01 / S-11: new CSV files of one dataset -> typed rows -> parquet,
    one folder per micro-batch.  A micro-batch (at most ``FILES_PER_BATCH``
    files) is one scan of lines; columns are found by the names in each file's
    own first line.  A file that lacks columns becomes a row below
    ``<target>_errors`` and stops no other; an empty file has nothing to tell.
    ``multiline`` (line ends inside quotes) can't be read by lines: then the
    stream only discovers files and each is read whole.
    Returns the started query."""
    how = {"strip_junk": strip_junk, "enrich_junk": enrich_junk}
    rows, errors = _batch_writer(target_dir), _batch_writer(f"{target_dir.rstrip('/')}_errors")

    def land(batch: DataFrame, batch_id: int) -> None:
        lines = batch.persist()
        try:
            good, bad = lines_by_header(lines, key)
            rows(CSV.typed(good, key, **how), batch_id)
            bad = bad.persist()
            if not bad.isEmpty():
                errors(bad, batch_id)
            bad.unpersist()
        finally:
            lines.unpersist()

    def land_whole(batch: DataFrame, batch_id: int) -> None:
        good, bad = _read_files(spark, key, sorted(r.path for r in batch.collect()), multiline=True, **how)
        if good:
            rows(reduce(DataFrame.unionByName, good), batch_id)
        if bad:
            errors(spark.createDataFrame(bad, "path string, error string"), batch_id)
    stream = spark.readStream.option("maxFilesPerTrigger", FILES_PER_BATCH).option("pathGlobFilter", "*.csv")
    if multiline:
        found = (stream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
                 .load(input_dir).select("path"))
    else:
        found = stream.text(input_dir).select("value", F.col("_metadata.file_path").alias("file"),
                                              F.col("_metadata.file_block_start").alias("block"))
    w = found.writeStream.foreachBatch(land_whole if multiline else land).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def score_requests(requests: DataFrame) -> DataFrame:
    """Shared by batch and stream: rule score, decision, ranked factors,
    recommendations and brief text of each request (all per row: no state, no
    shuffle)."""
    scored = X.score_heuristic(requests).withColumnRenamed("confidence", "score_confidence")
    e = X.explain(scored, "brief", keep=("request_id", "requested_at", "score_confidence"))
    return e.select("request_id", "application_id", "requested_at", "default_probability", F.col("score_confidence").alias("confidence"),
                    "model_version", "decision", "explanation_text", "key_factors", "recommendations",
                    F.col("confidence").alias("explanation_confidence"))


def score_stream(spark: SparkSession, events_dir: str, target_dir: str, checkpoint: str,
                 available_now: bool = True, glob: str = "events.parquet"):
    """R-02: arriving events -> score requests -> the latest result of each
    application in a bucketed table, upserted with the batch id as version: a
    batch that is run again changes nothing, and readers need no window."""
    schema = spark.read.parquet(f"{events_dir.rstrip('/')}/{glob}").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", 16).parquet(events_dir))
    scored = score_requests(spark.sql(ADAPTERS["stream_score_request"], events=events))

    def land(batch: DataFrame, batch_id: int) -> None:
        buckets.upsert(batch, target_dir, ["application_id"], ["requested_at", "request_id"], version=batch_id)
    w = scored.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """K-04 view: the latest row per key (by time, then id, then a hash of the row)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_cols], F.xxhash64(*df.columns).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
