"""The recurring jobs as table-or-stream operators.

Each transformation accepts a static or a streaming frame and gives the same
rows for a bounded input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskgrid.functions.risk import anchored
from riskgrid.operators.resample import day_features
from riskgrid.plans.incremental import keep_latest, save_by_month, upsert_table
from riskgrid.sources.readers import table_exists


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def daily_rollup(readings: DataFrame, delay: str = "2 hours", entity: str = "City", ts: str = "Timestamp") -> DataFrame:
    """Daily aggregates of hourly readings; a day is emitted once the watermark passes its end."""
    mean = lambda v: F.avg(v).alias(f"{v}_mean")
    # windows are defined on zoned timestamps; with a UTC session they are calendar days
    zoned = readings.withColumn("__ts", F.col(ts).cast("timestamp"))
    grouped = _watermarked(zoned, "__ts", delay).groupBy(entity, F.window("__ts", "1 day"))
    out = grouped.agg(
        mean("Temperature_C"),
        mean("Humidity_percent"),
        mean("Wind_Speed_kmh"),
        F.sum("Rain_mm").alias("Rain_mm_sum"),
        *day_features(ts),
    )
    return out.withColumn("Date", F.to_date("window.start")).drop("window")


def event_labels(points: DataFrame, key: Sequence[str], delay: str = "1 day", entity: str = "City", ts: str = "acq_date") -> DataFrame:
    """Daily labels from matched detections; repeated deliveries of one detection count once."""
    zoned = points.withColumn("__ts", F.col(ts).cast("timestamp"))
    marked = _watermarked(zoned, "__ts", delay)
    once = marked.dropDuplicatesWithinWatermark(list(key)) if points.isStreaming else marked.dropDuplicates(list(key))
    return (
        once.groupBy(entity, F.window("__ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("fire_count"), F.avg("brightness").alias("mean_brightness"), F.max("frp").alias("max_frp"))
        .withColumns({"Date": F.to_date("window.start"), "Fire_Occurred": F.lit(1)})
        .drop("window")
    )


def anchored_hours(hourly: DataFrame, daily: DataFrame, entity: str = "City", ts: str = "Timestamp") -> DataFrame:
    """Stream of hourly probabilities capped by a static daily table."""
    caps = daily.select(entity, F.col("Date").alias("__day"), F.col("probability").alias("__daily"))
    joined = hourly.withColumn("__day", F.to_date(ts)).join(caps, [entity, "__day"], "left")
    return joined.withColumn("probability", anchored("probability", "__daily")).select(*hourly.columns)


def upsert_sink(stream: DataFrame, path: str, key: Sequence[str], checkpoint: str, date: str = "Date") -> DataStreamWriter:
    """Write every micro-batch into a month-partitioned table; replaying a batch gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if table_exists(batch.sparkSession, path):
            upsert_table(batch, path, key, date)
        else:
            save_by_month(keep_latest(batch, key), path, date)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
