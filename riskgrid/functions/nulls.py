"""Null rules of the library: one place for clip, flags, ratios and NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Limit to ``[low, high]``; a null stays null (``greatest`` alone would drop it)."""
    c = as_column(c)
    out = c
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """``a / b``, or ``default`` where the quotient is undefined."""
    quotient = F.try_divide(a.cast("double"), b.cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, once, next to the scan."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select([F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in floating else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Names of numeric columns in schema order, read from the schema only."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in exclude]


def present(df: DataFrame, names) -> list[str]:
    """Those of ``names`` the frame has, in the order given."""
    have = set(df.columns)
    return [n for n in names if n in have]
