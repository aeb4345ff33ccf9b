"""Ranking and ordered-scan operators that stay parallel at any size
(W-05 stratified split, A-13 exact AUC, W-01/T-04 top-k).

A global rank or running total is computed without a single-task window:
rows are first spread over many hash buckets or range partitions, ranked
inside each in parallel, and offset by the running totals of a small table of
counts per bucket or range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HASH_BUCKETS_HEX = 5          # 16^5 (about a million) hash buckets per class


def split_hash(key: Column, seed: int) -> Column:
    """Order key of a row for the split: md5 of 'seed|key' (hex text)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.1,
                     seed: int = 17, flag: str = "is_validation") -> DataFrame:
    """W-05: per label class, the first ``ceil(fraction * n_class)`` rows in
    hash order are the validation part; exact and repeatable.

    Rows themselves are never shuffled.  Counts per (class, hash bucket) tell in
    which bucket the last validation row lies; the hashes of that bucket alone
    (about a millionth of the class) are ranked, which gives one cut-off hash
    per class, and every row is compared with it.  Rows of one key have one
    hash and stay together, also at the cut-off."""
    hashes = df.select(F.col(label).alias("_y"), split_hash(F.col(key), seed).alias("_h"))
    bucket = F.substring("_h", 1, HASH_BUCKETS_HEX)
    counts = hashes.groupBy("_y", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_y").orderBy("_b"))
    want = F.ceil(F.sum("_n").over(Window.partitionBy("_y")) * F.lit(fraction))
    # one row per class of the label
    last = F.broadcast(counts.select("_y", "_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), want.alias("_want"))
                       .where("_before < _want and _want <= _upto"))
    inside = (hashes.alias("x").join(last.alias("l"), F.col("x._y").eqNullSafe(F.col("l._y"))
                                     & (F.substring("x._h", 1, HASH_BUCKETS_HEX) == F.col("l._b")))
              .select(F.col("x._y").alias("_y"), "_h", (F.col("_want") - F.col("_before")).alias("_k")))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy("_h")))
    # one row per class of the label
    cut = F.broadcast(ranked.where("_r = _k").select("_y", F.col("_h").alias("_cut")))
    return (df.join(cut, df[label].eqNullSafe(cut["_y"]), "left")
            .withColumn(flag, F.coalesce(split_hash(F.col(key), seed) <= F.col("_cut"), F.lit(False)))
            .drop("_y", "_cut"))


def _ranges(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """The frame dealt into ranges of ``cols`` with the range's number ``_p``,
    checkpointed: whatever is computed from it sees the same boundaries (a
    range exchange that is planned twice samples twice)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(n, *cols).withColumn("_p", F.spark_partition_id()).checkpoint()


def _before(ranged: DataFrame, amount: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, _p, out): the amount in all lower ranges; one row per range (and
    group that it has)."""
    totals = ranged.groupBy(*by, "_p").agg(amount.alias("_t"))
    running = Window.partitionBy(*by).orderBy("_p")
    table = totals.select(*by, "_p", (F.sum("_t").over(running) - F.col("_t")).alias(out))
    return table if by else F.broadcast(table)


def exact_auc(df: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    """A-13: ROC AUC with mid-ranks for ties, exact:
    sum over distinct scores of pos(s) * (neg_below(s) + neg(s) / 2) / (P * N).
    Distinct scores are dealt into ranges; the running negative count is a
    running sum inside the range plus the totals of lower ranges (one row per
    range)."""
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    per_score = base.groupBy(score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))
    ranged = _ranges(per_score, score, partitions=partitions)
    below = F.sum("_neg").over(Window.partitionBy("_p").orderBy(score)) - F.col("_neg")
    j = ranged.withColumn("_below", below).join(_before(ranged, F.sum("_neg"), "_lower"), "_p")
    contrib = F.col("_pos") * (F.col("_lower") + F.col("_below") + F.col("_neg") / 2.0)
    agg = j.agg(F.sum(contrib).alias("_num"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return agg.select(
        F.try_divide(F.col("_num"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
        F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def ordered_index(values: DataFrame, col: str, out: str = "index", partitions: int | None = None, by: str | None = None) -> DataFrame:
    """0-based position of each (distinct) value in sorted order, of all or of
    those equal in ``by``, without a single-task window: values are dealt into
    ranges, numbered inside each in parallel, and offset by the sizes of the
    lower ranges (one row per range and group)."""
    group = (by,) if by else ()
    ranged = _ranges(values, *group, col, partitions=partitions)
    own = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(col))
    j = ranged.withColumn("_r", own).join(_before(ranged, F.count(F.lit(1)), "_off", group), [*group, "_p"])
    return j.select(*values.columns, (F.col("_off") + F.col("_r") - 1).cast("int").alias(out))
