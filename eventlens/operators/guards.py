"""Input guards and output normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str], target: T.StructType,
                    extra: Sequence[str] = ()) -> DataFrame:
    """``df`` itself when all required columns exist, else an empty
    DataFrame with the target schema (plus ``extra`` string columns).
    P2 needs nothing: every operator keeps its schema on empty input."""
    if not missing_columns(df, required):
        return df
    fields = [T.StructField(c, T.StringType()) for c in extra] + list(target.fields)
    return df.sparkSession.createDataFrame([], T.StructType(fields))


def optional_col(df: DataFrame, name: str, default) -> Column:
    """The column if it exists, else a literal default. (The default
    applies to a *missing column*, not to null values.)"""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        cols.append(c)
    return df.select(*cols)
