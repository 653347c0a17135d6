"""Scans: parquet with fallback, detection archives, side tables, landed weather payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from riskgrid.functions.nulls import nan_to_null
from riskgrid.operators.clean import coerce, drop_unkeyed
from riskgrid.session import sized_side
from riskgrid.spec import API_NAMES


def _absent(error: AnalysisException) -> bool:
    """The path isn't there, or holds no file: the only failures for which a fallback stands in."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        return False
    return True


def load_table(spark: SparkSession, path: str, fallback: str | None = None, dates: Sequence[str] = ()) -> DataFrame:
    """Parquet at ``path``, else at ``fallback``; date columns cast, NaN turned into null at the scan."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if fallback is None or not _absent(error):
            raise
        df = spark.read.parquet(fallback)
    return nan_to_null(df.withColumns({c: F.to_date(c) for c in dates if c in df.columns}))


def load_entity_cache(spark: SparkSession, folder: str, ts: str = "Timestamp") -> DataFrame:
    """A folder with one sub-folder per entity (``City=...``), as one partitioned scan."""
    return spark.read.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def load_side_table(spark: SparkSession, path: str, schema: str | StructType, dates: Sequence[str] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV by its header's names, with the declared types; a missing file is an empty table of that schema.

    All fields are read as text and cast one by one, so a value that is no number becomes null and its row stays,
    whatever the order of the columns and whichever are selected. A declared column that the file lacks is null.
    """
    declared = spark.createDataFrame([], schema).schema
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        raw = spark.createDataFrame([], schema)

    def field(f):
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType)
        text = F.trim(F.col(f"`{f.name}`").cast("string"))
        return F.to_date(F.try_to_timestamp(text, F.lit(date_format))) if f.name in dates else text.try_cast(f.dataType)

    return raw.select(*[field(f).alias(f.name) for f in declared])


# Accepted header names of the detection archives, in order of preference.
DETECTION_FIELDS = {
    "acq_date": ("acq_date",),
    "latitude": ("latitude",),
    "longitude": ("longitude",),
    "brightness": ("brightness", "bright_ti4", "bright_t31"),
    "frp": ("frp",),
    "confidence": ("confidence",),
}


def read_detections(spark: SparkSession, folder: str, min_confidence: Column | None = None) -> DataFrame:
    """All detection CSV files below ``folder``, whatever their header family.

    Files are read as text.  A header line names its own fields, so each line is
    read by the header of its file; no file is opened on the driver.  Commas
    within quotes belong to their field, fields beyond the header are ignored,
    and so are ``readme`` files.  A file is one header and its lines; if there
    are several headers the first in text order counts.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
        .filter(~F.lower("name").startswith("readme"))
    )
    is_header = F.lower("value").contains("latitude") & F.lower("value").contains("acq_date")
    # a comma is a separator if an even number of quotes follows
    fields = lambda text: F.transform(F.split(text, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    # one row per file: hinted as a small side if it is one, so the lines of one huge archive stay apart
    headers = sized_side(lines.filter(is_header).groupBy("file").agg(F.min("value").alias("header")))
    rows = lines.filter(~is_header).join(headers, "file").select(fields(F.col("value")).alias("v"), fields(F.lower("header")).alias("h"))

    def field(names: Sequence[str]) -> Column:
        at = lambda n: F.array_position("h", F.lit(n)).cast("int")
        value = lambda n: F.when(at(n) > 0, F.try_element_at("v", at(n)))
        return F.nullif(F.coalesce(*[F.nullif(value(n), F.lit("")) for n in names]), F.lit(""))

    raw = rows.select(*[field(names).alias(c) for c, names in DETECTION_FIELDS.items()])
    if min_confidence is not None:
        raw = raw.filter(min_confidence)
    return raw


def normalise_detections(raw: DataFrame) -> DataFrame:
    """Typed detections; rows without date or coordinates are dropped."""
    typed = coerce(raw, dates=["acq_date"], numbers=["latitude", "longitude", "brightness", "frp"])
    return drop_unkeyed(typed, ["acq_date", "latitude", "longitude"])


PAYLOAD_SCHEMA = "struct<hourly: struct<time: array<string>, " + ", ".join(f"{c}: array<double>" for c in API_NAMES) + ">>"


def explode_payload(documents: DataFrame, payload: str = "payload", entity: str = "City") -> DataFrame:
    """One row per hour from documents that hold parallel arrays under ``hourly``."""
    parsed = documents.select(entity, F.from_json(F.col(payload), PAYLOAD_SCHEMA).alias("d")).select(entity, "d.hourly.*")
    names = ["time", *API_NAMES]
    rows = parsed.select(entity, F.inline(F.arrays_zip(*names)))
    stamp = F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm"))
    return rows.select(entity, stamp.alias("Timestamp"), *[F.col(a).alias(b) for a, b in API_NAMES.items()])


def explode_axis(blocks: DataFrame, arrays: Sequence[str], entity: str = "City", start: str = "start", end: str = "end", step: str = "step") -> DataFrame:
    """Rows from value arrays on a half-open axis [start, end) of epoch seconds."""
    axis = F.sequence(F.col(start), F.col(end) - F.col(step), F.col(step)).alias("at")
    rows = blocks.select(entity, axis, *arrays).select(entity, F.inline(F.arrays_zip("at", *arrays)))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = origin + F.make_dt_interval(hours=F.floor(F.col("at") / 3600).cast("int"), secs=F.pmod("at", F.lit(3600)).cast("decimal(18,6)"))
    return rows.select(entity, stamp.alias("Timestamp"), *arrays)


def rename_variables(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(API_NAMES)
