"""Sinks: parquet, CSV, JSON records and documents, model bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet, replaced as a whole: readers see the old files until the job commits."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_records(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written, not left out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_document(document: DataFrame, path: str) -> None:
    """A one-row nested document as a single JSON file."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def records_array(df: DataFrame, per_region: str = "region", order: str = "date") -> DataFrame:
    """One JSON array text per region, for the small published slice of a bounded horizon."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.groupBy(per_region).agg(F.to_json(items, {"ignoreNullFields": "false"}).alias("records"))


def save_dimension(spark: SparkSession, rows: dict[str, tuple[float, float]], path: str) -> None:
    """Places table from a name to coordinates mapping."""
    df = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in rows.items()], "City string, Latitude double, Longitude double")
    save_table(df, path)


def save_bundle(model: PipelineModel, path: str, manifest: dict) -> None:
    """Fitted pipeline plus a one-row JSON manifest (name, threshold, feature list, metrics)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    save_document(spark.createDataFrame([manifest]), f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/manifest")
