"""Incremental save: append newer rows, or upsert by key, rewriting only touched partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskgrid.operators.panel import comparable, keep_one, overlay
from riskgrid.session import cut_lineage


def keep_latest(new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, then by all columns, so a repeated key always gives the same row."""
    return keep_one(new, key, [*order, *comparable(new)])


def append_after(stored: DataFrame, new: DataFrame, time: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Stored rows plus new rows later than the stored maximum; one row per key, stored first.

    Corrections of stored days are ignored, see ``upsert``; a repeated key of the new rows is settled by ``keep_latest``.
    """
    last = stored.agg(F.max(time).alias("m")).scalar()
    # later rows cannot share a key with stored ones, so only they need de-duplication
    fresh = keep_latest(new.filter(F.coalesce(F.col(time) > last, F.lit(True))), key, order)
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Stored rows with new rows added or replacing those of the same key, see ``overlay`` for repeated keys."""
    return overlay(stored, new, key, order)


def save_by_month(df: DataFrame, path: str, date: str = "Date") -> None:
    """Write partitioned by year and month; an existing table keeps the months ``df`` does not hold."""
    parts = df.withColumns({"year": F.year(date), "month": F.month(date)})
    (
        # a month with many rows is split, small ones are joined; rows stay grouped by month
        parts.hint("rebalance", "year", "month")
        .sortWithinPartitions("year", "month", date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )


def upsert_table(new: DataFrame, path: str, key: Sequence[str], date: str = "Date") -> None:
    """Upsert into a table written by ``save_by_month``: reads and rewrites the touched months only."""
    spark = new.sparkSession
    months = new.select(F.year(date).alias("year"), F.month(date).alias("month")).distinct()
    stored = spark.read.parquet(path)
    touched = stored.join(months, ["year", "month"], "left_semi").select(*new.columns)
    # the result replaces files it was read from, so it is materialised first
    save_by_month(cut_lineage(upsert(touched, new, key)), path, date)
