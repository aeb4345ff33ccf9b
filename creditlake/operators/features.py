"""Feature operators of the file-based ETL (A-06, A-07, J-04, W-02, P-12, P-14).

pandas semantics kept: null keys are dropped before grouping, a categorical
null is the category 'nan', label codes are the 0-based rank of the sorted
distinct text values.  Means are exact (decimal sums), so results do not
depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..session import ensure_checkpoint_dir

NULL_CATEGORY = "nan"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def category_text(c: Column) -> Column:
    """pandas ``astype(str)`` of an object column: null -> 'nan'."""
    return F.coalesce(c.cast("string"), F.lit(NULL_CATEGORY))


def mean_exact(df: DataFrame, c: str) -> Column:
    """Mean of one column (NaN left out).  Where all values of the group have
    at most ten decimals and fit a decimal, their sum is exact and the mean
    does not depend on the order of the rows; other values are averaged as
    doubles."""
    x = F.col(c)
    if df.schema[c].dataType.typeName() not in ("double", "float"):
        return F.try_divide(F.sum(x).cast("double"), F.count(x))
    x = F.when(~F.isnan(x), x.cast("double"))
    d = x.try_cast("decimal(38,10)")
    exact = F.bool_and(F.when(x.isNotNull(), F.coalesce(d.cast("double") == x, F.lit(False))))
    return F.coalesce(F.when(exact, F.try_divide(F.try_sum(d).cast("double"), F.count(d))), F.avg(x))


def mean_all(df: DataFrame, key: str, exclude=()) -> DataFrame:
    """A-06: ``groupby(key).mean()`` of every numeric column (null keys dropped)."""
    cols = numeric_columns(df, exclude=(key, *exclude))
    return (df.where(F.col(key).isNotNull())
            .groupBy(key).agg(*[mean_exact(df, c).alias(c) for c in cols]))


def nunique_null_as_category(c: str) -> Column:
    """A-07: distinct count with null counted as one more value (categorical
    columns: a map-side set per key, see ``functions.stats.nunique_small``)."""
    return F.size(F.collect_set(category_text(F.col(c))))


def encoder_table(fit: DataFrame, cols: list[str]) -> DataFrame:
    """W-02: (column, value, code) of all text columns at once: the 0-based rank
    of each distinct text among those of its column.  Distinct values, not rows,
    are dealt by ranges of (column, value) and numbered in parallel, whatever
    the number of columns or their cardinality."""
    from .ranking import ordered_index
    long = fit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category_text(F.col(c)).alias("value")) for c in cols]))
                      .alias("v")) if cols else fit.select(F.lit(None).cast("struct<column:string,value:string>").alias("v")).limit(0)
    return ordered_index(long.select("v.column", "v.value").distinct(), "value", "code", by="column")


def label_codes(fit: DataFrame, c: str, code_col: str | None = None) -> DataFrame:
    """W-02: mapping (text -> code) of one column from the distinct values of ``fit``."""
    return encoder_table(fit, [c]).select(F.col("value").alias("__v"), F.col("code").alias(code_col or f"{c}__code"))


def label_encode(df: DataFrame, cols: list[str], fit: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace each text column by its label code, all in one join.  The classes
    are learned from ``fit`` (default: ``df`` itself, as ``fit_transform``) or
    given as ``codes``; values unseen there get -1.

    Every row offers its texts as (row, column, value); they meet the codes in
    one join and come back as one map per row, so the number of exchanges does
    not grow with the columns.  Rows are numbered in a checkpoint: a task that
    runs again finds the same numbers."""
    if not cols:
        return df
    codes = encoder_table(df if fit is None else fit, cols) if codes is None else codes
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    texts = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category_text(F.col(c)).alias("value"))
                                                    for c in cols])).alias("v")).select("_row", "v.column", "v.value")
    found = texts.join(codes, ["column", "value"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "code"))).alias("_codes"))
    out = rows.join(found, "_row", "left")
    return out.select(*[F.coalesce(F.try_element_at("_codes", F.lit(c)), F.lit(-1)).cast("int").alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def fill_minus_one(df: DataFrame, exclude=()) -> DataFrame:
    """P-12: ``fillna(-1)`` over numeric columns (NaN counts as missing)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, NumericType) and f.name not in exclude:
            if f.dataType.typeName() in ("double", "float"):
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            c = F.coalesce(c, F.lit(-1).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def child_aggregate(df: DataFrame, key: str, drop: list[str], categorical: list[str],
                    prefix: str, nunique_name) -> DataFrame:
    """C-09 per child table: nunique (null as category) of each categorical
    column plus the mean of every numeric column, in ONE aggregation (the
    reference attaches each nunique to every row and averages it back: the
    mean of a per-group constant is the constant).

    Rows are dealt by the key before, so what is shuffled is the rows: the
    sums, counts and sets of a group take several times the room of a row, and
    the more keys there are, the fewer rows of a task share one."""
    base = df.where(F.col(key).isNotNull()).drop(*drop).repartition(key)
    nums = numeric_columns(base, exclude=(key,))
    aggs = [mean_exact(base, c).alias(c) for c in nums]
    aggs += [nunique_null_as_category(c).cast("double").alias(nunique_name(c)) for c in categorical]
    agg = base.groupBy(key).agg(*aggs)
    return agg.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in agg.columns if c != key])
