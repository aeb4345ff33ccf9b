"""Driver parquet tables.

Every reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the parquet scan, so callers never pre-select columns here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """``wide``: spread a narrow scan over all cores (for per-row heavy work
    that follows the scan directly, before any shuffle)."""
    if name not in DRIVER_TABLES:
        raise KeyError(f"unknown driver table: {name}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(spark, df) if wide else df


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Spread a scan of fewer files than half the cluster's cores (a few
    large files with one row group each) over all cores.  On real
    input of many files the scan is already wide and this is a no-op; the
    shuffle only exists when the input layout would leave cores idle.
    Columns are pruned below the shuffle, filters pushed into the scan.  Off
    unless the session sets ``creditlake.spreadScans`` (local runs over one
    file): it lists the input's files on the driver."""
    if spark.conf.get("creditlake.spreadScans", "false") != "true":
        return df
    cores = spark.sparkContext.defaultParallelism
    # file count, not split count: a file with one row group yields one
    # busy split however it is cut (the listing is already in the index)
    if len(df.inputFiles()) * 2 <= cores:
        return df.repartition(cores)
    return df
