"""Data queries behind the dashboard views, over the public daily and hourly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def usable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("probability").isNotNull() & F.col("region").isNotNull())


def point_lookup(df: DataFrame, region: str, date: str) -> DataFrame:
    """The region's row for the date, else its first row."""
    exact = F.when(F.col("date") == date, 0).otherwise(1)
    return df.filter(F.col("region") == region).orderBy(exact, "date").limit(1)


def map_snapshot(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col("date") == date)


def first_hours(hourly: DataFrame) -> DataFrame:
    """Earliest hour of each region."""
    return hourly.groupBy(F.col("region").alias("__r")).agg(F.min_by(F.struct(*hourly.columns), "timestamp").alias("r")).select("r.*")


def table_view(df: DataFrame, region: str | None = None, tier: str | None = None, date: str | None = None) -> DataFrame:
    """Rows matching every filter that is set."""
    for column, value in (("region", region), ("risk_level", tier), ("date", date)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def distinct_dates(df: DataFrame) -> DataFrame:
    return df.select("date").distinct().orderBy("date")


def distinct_regions(df: DataFrame) -> DataFrame:
    return df.select("region").distinct().orderBy("region")


def region_series(df: DataFrame, region: str, time: str = "date") -> DataFrame:
    return df.filter(F.col("region") == region).orderBy(time)


def animation_frames(df: DataFrame) -> DataFrame:
    """One row per date and region with the risk in percent and a label."""
    pct = F.round(F.col("probability") * 100, 1)
    return df.select(
        "date", "region", "Latitude", "Longitude", "risk_level", pct.alias("risk_pct"), F.concat_ws(" ", "region", F.format_string("%.1f%%", pct)).alias("label")
    )


def snapshot_dates(df: DataFrame, every: int = 5) -> DataFrame:
    """Every n-th distinct date plus the last one."""
    # one row per calendar date, hence a bounded single window
    w = Window.orderBy("date")
    numbered = df.select("date").distinct().select("date", F.row_number().over(w).alias("n"), F.lead("date").over(w).alias("next"))
    return numbered.filter((F.pmod(F.col("n") - 1, F.lit(every)) == 0) | F.col("next").isNull()).select("date")
