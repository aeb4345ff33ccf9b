"""Tables with one row per key, kept in hash buckets (K-04, W-03, R-02).

A version of a table is a manifest: for each bucket the version that last wrote
it.  An upsert reads and rewrites only the buckets that its rows fall into, into
a folder of its own version, and then writes the next manifest; all other
buckets stay the files that they are.  Readers see committed manifests only, so
an upsert that fails leaves the table as it was and is written anew by a retry.
An upsert that names its version (a stream's batch id) and finds it committed
changes nothing.

A first batch goes to its buckets at once; a later one is stored once in the
shared folder, compressed, until the version is committed, so that the buckets
it touches and the rows merged with them are of one evaluation.  Rows of one per
key travel once, dealt by bucket; shuffle files go as soon as a write ends.

The number of buckets is fixed when a table is made; keys are spread over them
by a hash, so buckets are of one size.  What reaches the driver is one row per
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import DROP_SHUFFLES, scratch_path, session_conf
from . import sinks

BUCKETS = 64
BUCKET, FRESH = "in_bucket", "is_fresh"
MANIFEST = f"{BUCKET} int, data_version long"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def latest(rows: DataFrame, keys: list[str], order: list[str], fresh: bool = False) -> DataFrame:
    """One row per key, the greatest by ``order`` (nulls lowest); of equal ones
    a fresh row if marked, then the greatest hash of the row.  The aggregate is
    partial before the shuffle, so a hot key is reduced where it is read."""
    cols = [c for c in rows.columns if c not in (BUCKET, FRESH)]
    by = F.struct(*order, *([FRESH] if fresh else []), F.xxhash64(*cols).alias("_hash"))
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    top = rows.groupBy(*keys).agg(F.max_by(rest, by).alias("_row"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, int]]:
    """(version, {bucket: data version}) as last committed; version -1 if none."""
    at = f"{root.rstrip('/')}/manifest"
    known = sinks.versions(spark, at)
    if not known:
        return -1, {}
    return known[-1], {r[BUCKET]: r["data_version"] for r in spark.read.schema(MANIFEST).parquet(f"{at}/v={known[-1]}").collect()}


def _paths(root: str, of: dict[int, int]) -> list[str]:
    return [f"{root.rstrip('/')}/data/v={v}/{BUCKET}={b}" for b, v in sorted(of.items())]


def read(spark: SparkSession, root: str, only: set[int] | None = None) -> DataFrame | None:
    """The table's rows (those of some buckets), None if there are none."""
    _, of = manifest(spark, root)
    paths = _paths(root, of if only is None else {b: v for b, v in of.items() if b in only})
    return spark.read.parquet(*paths) if paths else None


def _dealt(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows with their bucket, one task per bucket."""
    return rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET)


def _latest_dealt(rows: DataFrame, keys: list[str], order: list[str], buckets: int, fresh: bool = False) -> DataFrame:
    """``latest`` of rows that are one or few per key: they travel once and
    are reduced in their bucket."""
    return latest(_dealt(rows, keys, buckets), [BUCKET, *keys], order, fresh)


def _write(rows: DataFrame, path: str) -> list[int]:
    """One file per bucket; returns the buckets that have rows."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(path)
    return sinks.numbered(rows.sparkSession, path, BUCKET)


def _merge(batch: DataFrame, root: str, path: str, keys: list[str], order: list[str], buckets: int) -> list[int]:
    """Write the buckets that the batch falls into, with its rows."""
    spark, kept = batch.sparkSession, scratch_path(batch.sparkSession, "upsert")
    latest(batch, keys, order).withColumn(BUCKET, bucket_of(keys, buckets)).write.option("compression", "zstd").parquet(kept)
    fresh = spark.read.parquet(kept)
    touched = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
    if touched:
        old = read(spark, root, touched)
        rows = fresh.drop(BUCKET).withColumn(FRESH, F.lit(1))
        if old is not None:
            rows = old.withColumn(FRESH, F.lit(0)).unionByName(rows)
        _write(_latest_dealt(rows, keys, order, buckets, fresh=True).drop(FRESH), path)
    sinks.drop(spark, kept)
    return sorted(touched)


def upsert(batch: DataFrame, root: str, keys: list[str], order: list[str], version: int | None = None, buckets: int = BUCKETS,
           few_per_key: bool = False) -> int:
    """Put the batch's rows into the table, the latest per key by ``order``
    (of equal ones the batch's); returns the table's version.  A batch with
    ``few_per_key`` is not reduced before its rows travel."""
    spark = batch.sparkSession
    last, of = manifest(spark, root)
    if version is not None and version <= last:
        return last
    version = last + 1 if version is None else version
    path = f"{root.rstrip('/')}/data/v={version}"
    with session_conf(spark, DROP_SHUFFLES):
        if of:
            touched = _merge(batch, root, path, keys, order, buckets)
        else:
            rows = _latest_dealt(batch, keys, order, buckets) if few_per_key else _dealt(latest(batch, keys, order), keys, buckets)
            touched = _write(rows, path)
    now = sorted((of | dict.fromkeys(touched, version)).items())
    sinks.write_version(spark.createDataFrame(now, MANIFEST).coalesce(1), f"{root.rstrip('/')}/manifest", version)
    return version
