"""File sinks: vault appends, versioned tables for idempotent re-runs and
upserts without a MERGE-capable format (K-03, K-04, K-05, K-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def numbered(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers n of the folders ``<name>=<n>`` under ``root``."""
    p, fs = _fs(spark, root)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x.partition("=")[2]) for x in names if x.startswith(f"{name}="))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root`` (folders ``v=<n>`` with a _SUCCESS marker)."""
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
                st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    v = versions(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/v={v[-1]}") if v else None


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a complete new version.  Re-running the same version number
    rewrites the same folder (idempotent after a failure); readers only see
    versions whose write committed (_SUCCESS)."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def upsert_versioned(spark: SparkSession, batch: DataFrame, root: str, key: str, ts: str) -> str:
    """K-04 on files: current version UNION batch, latest row per key, written
    as the next version (no in-place update; lineage is cut by the write)."""
    from ..plans.crm import upsert_latest
    cur = read_current(spark, root)
    nxt = (versions(spark, root) or [-1])[-1] + 1
    merged = batch if cur is None else upsert_latest(cur, batch.select(*cur.columns), key, ts)
    return write_version(merged, root, nxt)
