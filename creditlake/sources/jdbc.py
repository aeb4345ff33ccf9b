"""JDBC source and sinks (S-01, S-02, K-01, K-02).

Not exercised by the registered queries: they need a database, and this
build starts none (not even an in-process one).  The code is the plain
Spark JDBC data source with the options a large read or write needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WRITE_BATCH_ROWS = 2000          # the reference's insert page size


def read_partitioned(spark: SparkSession, url: str, table: str, key: str, properties: dict,
                     num_partitions: int = 64, fetch_size: int = 10000) -> DataFrame:
    """S-01: a table read in ``num_partitions`` parallel range queries on a
    numeric key (bounds from one pushed-down min/max query), instead of the
    single-connection full scan of an unpartitioned ``read.jdbc``."""
    bounds = (spark.read.format("jdbc").options(**properties).option("url", url)
              .option("query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {table}").load().first())
    if bounds is None or bounds["lo"] is None:
        return spark.read.format("jdbc").options(**properties).option("url", url).option("dbtable", table).load()
    return (spark.read.format("jdbc").options(**properties)
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", key).option("lowerBound", str(bounds["lo"]))
            .option("upperBound", str(int(bounds["hi"]) + 1)).option("numPartitions", str(num_partitions))
            .option("fetchsize", str(fetch_size)).load())


def read_options(spark: SparkSession, options: dict) -> DataFrame:
    """S-02: option-form read (``url``, ``dbtable``/``query``, driver, user...)."""
    return spark.read.format("jdbc").options(**options).load()


def overwrite(df: DataFrame, url: str, table: str, properties: dict) -> None:
    """K-01: replace the table's rows but keep its definition (keys,
    defaults, indexes): ``truncate`` instead of drop-and-create."""
    (df.write.format("jdbc").options(**properties).option("url", url).option("dbtable", table)
     .option("truncate", "true").option("batchsize", str(WRITE_BATCH_ROWS)).mode("overwrite").save())


def append(df: DataFrame, url: str, table: str, properties: dict) -> None:
    """K-02: batched inserts, one connection per partition of ``df`` (the
    caller chooses their number; running tasks bound the open ones)."""
    (df.write.format("jdbc").options(**properties).option("url", url).option("dbtable", table)
     .option("batchsize", str(WRITE_BATCH_ROWS)).option("isolationLevel", "READ_COMMITTED")
     .mode("append").save())
