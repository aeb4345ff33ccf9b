"""Schema conformance and cleaning steps (P-01, P-02, P-07, P-08, P-11..P-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DatasetSpec


def normalize_columns(df: DataFrame) -> DataFrame:
    """P-01: strip and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def missing_columns(df: DataFrame, required) -> list[str]:
    """P-02: required columns absent from ``df`` (in required order)."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]


def require_columns(df: DataFrame, required, what: str = "input") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what}: missing required columns: {missing[:10]}")
    return df


def conform(df: DataFrame, spec: DatasetSpec, keep_junk: bool = False, full: bool = True) -> DataFrame:
    """Select the columns of ``spec`` in order, cast to the declared type.
    ``full``: absent columns are added as typed nulls (a file-shaped frame);
    otherwise only the present ones are kept (narrow: later steps treat an
    absent column as null, and the plan stays small).  Junk columns are
    dropped unless ``keep_junk`` (P-07 strip)."""
    have = set(df.columns)
    cols: list[Column] = []
    for name, typ in spec.columns:
        if name in spec.junk and not keep_junk:
            continue
        if name not in have and not full:
            continue
        src = F.col(name) if name in have else F.lit(None)
        cols.append(src.cast(typ).alias(name))
    return df.select(*cols)


def strip_junk(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """P-07: drop the dataset's junk columns (absent ones are ignored)."""
    return df.drop(*spec.junk)



def fill_nulls(df: DataFrame, value: float | dict) -> DataFrame:
    """P-12: pandas ``fillna``: for numeric columns NaN counts as missing too."""
    if isinstance(value, dict):
        targets = value
    else:
        numeric = {f.name for f in df.schema.fields
                   if f.dataType.typeName() in ("double", "float", "integer", "long",
                                                "short", "decimal", "byte")}
        targets = {c: value for c in df.columns if c in numeric}
    cols = []
    for f in df.schema.fields:
        if f.name in targets:
            c = F.col(f.name)
            if f.dataType.typeName() in ("double", "float"):
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            cols.append(F.coalesce(c, F.lit(targets[f.name]).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
