"""Coercion, imputation, clipping and schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import clip, numeric_columns, present
from riskgrid.operators.stats import as_scalar_row, fit_clip_limits, fit_medians
from riskgrid.spec import FORECAST_BOUNDS, NON_FEATURES


def coerce(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Parse text leniently: what cannot be read becomes null."""
    out = {c: F.to_date(F.try_to_timestamp(F.trim(c), F.lit(date_format))) for c in dates}
    out |= {c: F.col(c).try_cast("double") for c in numbers}
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def drop_unkeyed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(key))


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns else numeric_columns(df))


def clip_physical(df: DataFrame, bounds: dict[str, tuple[float, float]] = FORECAST_BOUNDS) -> DataFrame:
    return df.select(*[clip(c, *bounds[c]).alias(c) if c in bounds else F.col(c) for c in df.columns])


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, limits: DataFrame | None = None) -> DataFrame:
    """Clip at global percentiles, fitted here or passed in."""
    limits = fit_clip_limits(df, columns, low, high) if limits is None else limits
    row = F.col("__limits")
    out = {c: clip(c, row.getField(f"{c}_low"), row.getField(f"{c}_high")) for c in columns}
    with_row = df.select("*", as_scalar_row(limits).alias("__limits"))
    return with_row.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def impute_entity_median(df: DataFrame, columns: Sequence[str], entity: str = "City", medians: DataFrame | None = None) -> DataFrame:
    """Null to the entity's median, then to 0; whole-number columns keep their type (the median is rounded)."""
    columns = present(df, columns)
    medians = fit_medians(df, columns, [entity]) if medians is None else medians
    joined = df.join(medians, entity, "left")
    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}

    def filled(c: str) -> Column:
        median = F.round(f"{c}_median").cast(df.schema[c].dataType) if c in whole else F.col(f"{c}_median")
        return F.coalesce(F.col(c), median, F.lit(0).cast(df.schema[c].dataType) if c in whole else F.lit(0.0)).alias(c)

    return joined.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def repair_features(
    df: DataFrame,
    wanted: Sequence[str],
    medians: DataFrame,
    base: Sequence[str],
    calendar: Sequence[str],
    entity: str = "City",
) -> DataFrame:
    """Bring a horizon frame to the model's columns.

    Calendar columns: null to 0.  Columns the frame lacks and base variables:
    null (for base also zero) to the entity median.  Other columns: null to the
    entity median.  What is still null becomes 0.
    """
    joined = df.join(medians, entity, "left")
    fitted = {c for c in wanted if f"{c}_median" in medians.columns}

    def repaired(c: str) -> Column:
        own = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        if c in calendar or c not in fitted:
            return F.coalesce(own, F.lit(0.0))
        if c in base:
            own = F.nullif(own, F.lit(0.0))
            return F.coalesce(own, F.col(f"{c}_median").cast("double"), F.lit(0.0))
        return F.coalesce(own, F.col(f"{c}_median").cast("double"), F.lit(0.0))

    ids = [c for c in df.columns if c not in wanted]
    return joined.select(*ids, *[repaired(c).alias(c) for c in wanted])


def feature_columns(df: DataFrame, exclude: Sequence[str] = NON_FEATURES) -> list[str]:
    """Numeric non-leaking columns in sorted order."""
    return sorted(numeric_columns(df, list(exclude)))


def align_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's columns in its order; absent or null ones are 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.select(*keep, *[value(c).alias(c) for c in wanted])


def with_defaults(df: DataFrame, wanted: Sequence[str], default: float = 0.0) -> DataFrame:
    """Existing columns as they are, absent ones as a constant."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in wanted])


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str = "city") -> DataFrame:
    """0/1 column per listed value; the column itself is kept as key."""
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in values])


def one_hot_value(columns: Sequence[str], prefix: str = "city") -> Column:
    """Name of the column that holds 1 (first on ties)."""
    cut = len(prefix) + 1
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c[cut:])) for c in columns])


def add_mean_suffix(df: DataFrame, keys: Sequence[str] = ("City", "Date")) -> DataFrame:
    """Bare variable names get ``_mean`` unless that name exists."""
    suffixes = ("_mean", "_sum", "_min", "_max")
    renames = {
        c: f"{c}_mean" for c in df.columns if c not in keys and not any(s in c for s in suffixes) and f"{c}_mean" not in df.columns
    }
    return df.withColumnsRenamed(renames)


def mask_label(label: str, daytime: str) -> Column:
    """The label, but 0 outside daytime."""
    return F.when(F.col(daytime) == 0, F.lit(0)).otherwise(F.col(label))


def estimate_extremes(df: DataFrame, spread: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Daily min and max from the mean and the fitted spread."""
    row = F.col("__spread")
    use = [v for v in variables if f"{v}_mean" in df.columns]
    new = [
        e
        for v in use
        for e in (
            (F.col(f"{v}_mean") + row.getField(f"{v}_up")).alias(f"{v}_max"),
            (F.col(f"{v}_mean") - row.getField(f"{v}_down")).alias(f"{v}_min"),
        )
    ]
    made = {f"{v}_{s}" for v in use for s in ("max", "min")}
    return df.select("*", as_scalar_row(spread).alias("__spread")).select(*[c for c in df.columns if c not in made], *new)


def hour_proxies() -> list[Column]:
    """Hour-based features estimated from daily values only; starts, slopes, limits and the solar hour are fixed values."""
    t, h, w = (F.col(c) for c in ("Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean"))

    def ramp(start: Column, gap: Column, slope: float, top: float) -> Column:
        return F.when(start, clip(gap * slope, 1.0, top)).otherwise(F.lit(0.0))

    return [
        (F.col("Temperature_C_max") - F.col("Temperature_C_min")).alias("temp_range"),
        (F.col("Humidity_percent_max") - F.col("Humidity_percent_min")).alias("Humidity_percent_diurnal_range"),
        ramp(t >= 28, t - 28, 2.0, 12.0).alias("hours_temp_above_30"),
        ramp(h <= 40, F.lit(40.0) - h, 0.5, 10.0).alias("hours_humidity_below_30"),
        ramp(w >= 18, w - 18, 0.8, 8.0).alias("hours_wind_above_20"),
        F.lit(13.0).alias("solar_peak_hour"),
        F.col("Temperature_C_min").alias("temp_night_min"),
    ]


# Event history assumed where none is known.
HISTORY_DEFAULTS = {
    "fire_count_7d": 0.0,
    "fire_count_14d": 0.0,
    "fire_count_30d": 0.0,
    "fire_count_90d": 0.0,
    "days_since_last_fire": 365.0,
    "city_month_fire_rate": 0.02,
    "city_fire_rate": 0.02,
}


def default_history(df: DataFrame) -> DataFrame:
    """Event-history columns where known, constants elsewhere."""
    value = lambda c, d: (F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in df.columns else F.lit(d)).alias(c)
    rest = [c for c in df.columns if c not in HISTORY_DEFAULTS]
    return df.select(*rest, *[value(c, d) for c, d in HISTORY_DEFAULTS.items()])

