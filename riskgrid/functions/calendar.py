"""Calendar parts, cyclic encodings and season flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import as_column, flag


def floor_hour(ts: Column | str) -> Column:
    """Start of the hour, without a detour through the session time zone."""
    ts = as_column(ts)
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def hour_index(ts: Column | str) -> Column:
    """Hours since 1970-01-01 00:00, independent of the session time zone."""
    ts = as_column(ts)
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(ts)).cast("bigint")


def _cycle(prefix: str, part: Column, period: int) -> list[Column]:
    turn = F.lit(2 * math.pi) * part / F.lit(period)
    return [F.sin(turn).alias(f"{prefix}_sin"), F.cos(turn).alias(f"{prefix}_cos")]


def season(month: Column) -> Column:
    """0 for Dec-Feb, then 1, 2, 3 for the following quarters."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def date_parts(date: Column | str) -> list[Column]:
    d = as_column(date)
    month, doy, dow = F.month(d), F.dayofyear(d), F.weekday(d)
    return [
        F.year(d).alias("Year"),
        month.alias("Month"),
        doy.alias("DayOfYear"),
        dow.alias("DayOfWeek"),
        F.weekofyear(d).alias("WeekOfYear"),
        *_cycle("Month", month, 12),
        *_cycle("DoY", doy, 365),
        *_cycle("DoW", dow, 7),
        season(month).alias("Season"),
        flag(month.between(6, 8)).alias("is_summer"),
        flag(month.isin(12, 1, 2)).alias("is_winter"),
        flag(month.between(5, 9)).alias("is_fire_season"),
    ]


def hour_parts(ts: Column | str, day_from: int = 6, day_to: int = 20) -> list[Column]:
    hour = F.hour(as_column(ts))
    return [hour.alias("Hour"), *_cycle("Hour", hour, 24), flag(hour.between(day_from, day_to)).alias("is_daytime")]


def with_columns_replaced(df: DataFrame, columns: list[Column], names: list[str]) -> DataFrame:
    """One projection that adds ``columns`` and lets them win over same-named ones."""
    new = set(names)
    return df.select(*[c for c in df.columns if c not in new], *columns)


DATE_PART_NAMES = [
    "Year", "Month", "DayOfYear", "DayOfWeek", "WeekOfYear", "Month_sin", "Month_cos", "DoY_sin", "DoY_cos",
    "DoW_sin", "DoW_cos", "Season", "is_summer", "is_winter", "is_fire_season",
]
HOUR_PART_NAMES = ["Hour", "Hour_sin", "Hour_cos", "is_daytime"]


def add_date_parts(df: DataFrame, date: str = "Date") -> DataFrame:
    return with_columns_replaced(df, date_parts(date), DATE_PART_NAMES)


def add_hour_parts(df: DataFrame, ts: str = "Timestamp", day_from: int = 6, day_to: int = 20) -> DataFrame:
    return with_columns_replaced(df, hour_parts(ts, day_from, day_to), HOUR_PART_NAMES)


def temporal_split(t: Column | str, validation_from: str, test_from: str) -> Column:
    """train / val / test label from two boundary dates."""
    t = as_column(t)
    return (
        F.when(t < F.lit(validation_from).cast("date"), "train")
        .when(t < F.lit(test_from).cast("date"), "val")
        .otherwise("test")
    )
