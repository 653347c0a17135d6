"""Roll-ups from observations to hours and days, and regular time spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.calendar import floor_hour
from riskgrid.functions.nulls import numeric_columns, present
from riskgrid.spec import Panel


def _rollup_rules(name: str) -> list[str]:
    """Which daily aggregates a variable gets, by its name."""
    if "Rain" in name:
        return ["sum"]
    if "Dir" in name or "Solar" in name:
        return ["mean"]
    return ["mean", "min", "max"]


_AGG = {"mean": F.avg, "min": F.min, "max": F.max, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}


def roll_up_daily(df: DataFrame, entity: str = "City", ts: str = "Timestamp", variables: Sequence[str] | None = None) -> DataFrame:
    """Daily panel with aggregates chosen from the variable names."""
    variables = list(variables) if variables is not None else numeric_columns(df, [entity, ts])
    aggregates = [_AGG[rule](v).alias(f"{v}_{rule}") for v in variables for rule in _rollup_rules(v)]
    return df.groupBy(entity, F.to_date(ts).alias("Date")).agg(*aggregates)


def roll_up_hourly(df: DataFrame, entity: str = "City", ts: str = "Timestamp", variables: Sequence[str] | None = None) -> DataFrame:
    """Hourly panel: mean of every variable, sum of rain."""
    variables = list(variables) if variables is not None else numeric_columns(df, [entity, ts])
    aggregates = [_AGG["sum" if "Rain" in v else "mean"](v).alias(v) for v in variables]
    return df.groupBy(entity, floor_hour(ts).alias("Timestamp")).agg(*aggregates)


def hours_where(value: str, name: str, above: float | None = None, below: float | None = None) -> Column:
    v = F.col(value)
    condition = v > above if above is not None else v < below
    return F.count_if(condition).cast("int").alias(name)


def day_spread(value: str) -> Column:
    return F.max(value) - F.min(value)


def peak_hour(ts: str, value: str, default: int = 12) -> Column:
    """Hour of the largest value (earliest on ties); ``default`` if nothing is above zero."""
    hour = F.hour(ts)
    best = F.max_by(hour, F.when(F.col(value).isNotNull(), F.struct(F.col(value), -hour)))
    return F.coalesce(F.when(F.max(value) > 0, best), F.lit(default)).cast("int")


def part_of_day(ts: str, value: str, how: str, hour_from: int, hour_to: int) -> Column:
    """min or max within hours [from, to]; the day's minimum if no hour qualifies."""
    pick = {"min": F.min, "max": F.max}[how]
    inside = F.when(F.hour(ts).between(hour_from, hour_to), F.col(value))
    return F.coalesce(pick(inside), F.min(value))


def day_features(ts: str = "Timestamp") -> list[Column]:
    """Aggregates over the hours of a day that feed the daily features."""
    t, h, w, s = "Temperature_C", "Humidity_percent", "Wind_Speed_kmh", "Solar_Radiation_Wm2"
    return [
        hours_where(t, "hours_temp_above_30", above=30),
        hours_where(h, "hours_humidity_below_30", below=30),
        hours_where(w, "hours_wind_above_20", above=20),
        day_spread(h).alias("Humidity_percent_diurnal_range"),
        day_spread(t).alias("temp_range"),
        part_of_day(ts, t, "min", 0, 5).alias("temp_night_min"),
        part_of_day(ts, t, "max", 12, 17).alias("temp_afternoon_max"),
        peak_hour(ts, s).alias("solar_peak_hour"),
    ]


def refresh_daily(df: DataFrame, entity: str = "City", ts: str = "Timestamp") -> DataFrame:
    """The fixed aggregate list of the daily refresh, in one pass."""
    mean = lambda v: F.avg(v).alias(f"{v}_mean")
    low = lambda v: F.min(v).alias(f"{v}_min")
    high = lambda v: F.max(v).alias(f"{v}_max")
    columns = [f(v) for v in ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh") for f in (mean, high, low)]
    columns += [mean(v) for v in ("Wind_Dir_deg", "Pressure_hPa", "Solar_Radiation_Wm2", "Soil_Temp_C", "Soil_Moisture")]
    columns += [high(v) for v in ("Soil_Temp_C", "Soil_Moisture")]
    columns.append(F.coalesce(F.sum("Rain_mm"), F.lit(0.0)).alias("Rain_mm_sum"))
    return df.groupBy(entity, F.to_date(ts).alias("Date")).agg(*columns, *day_features(ts))


def events_per_day(points: DataFrame, entity: str = "City", date: str = "acq_date") -> DataFrame:
    """Daily label table from matched point events."""
    return (
        points.groupBy(entity, F.to_date(date).alias("Date"))
        .agg(
            F.count(F.lit(1)).alias("fire_count"),
            F.avg("brightness").alias("mean_brightness"),
            F.max("frp").alias("max_frp"),
        )
        .withColumn("Fire_Occurred", F.lit(1))
    )


def side_series_daily(df: DataFrame, columns: dict[str, str], entity: str = "City", ts: str = "Date") -> DataFrame:
    """Sparse side table at day grain; ``columns`` maps a column to "mean" or "max"."""
    use = {c: how for c, how in columns.items() if c in df.columns}
    return df.groupBy(entity, F.to_date(ts).alias("Date")).agg(*[_AGG[how](c).alias(c) for c, how in use.items()])


def date_spine(entities: DataFrame, panel: Panel, bounds: DataFrame, step: str = "1 day") -> DataFrame:
    """Every step between ``bounds`` for every entity.

    ``entities`` has the entity column; ``bounds`` is one row (lo, hi), read as a scalar.
    """
    b = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    axis = F.explode(F.sequence(b.getField("lo"), b.getField("hi"), F.expr(f"interval {step}")))
    return entities.select(panel.entity).distinct().select(panel.entity, axis.alias(panel.time))


def densify(df: DataFrame, panel: Panel, step: str = "1 day") -> DataFrame:
    """Add the missing steps of each entity between its own first and last row."""
    ends = df.groupBy(panel.entity).agg(F.min(panel.time).alias("lo"), F.max(panel.time).alias("hi"))
    axis = ends.select(
        panel.entity, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(panel.time)
    )
    return axis.join(df, panel.key, "left").select(*df.columns)


def widen(long: DataFrame, panel: Panel, variable: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long (entity, time, variable, value) to one row per key, first non-null value per variable."""
    cells = [F.max(F.when(F.col(variable) == n, F.col(value))).alias(n) for n in names]
    return long.groupBy(*panel.key).agg(*cells)


def lengthen(df: DataFrame, key: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    cells = df.select(*key, *[F.col(c).cast("double").alias(c) for c in present(df, columns)])
    return cells.unpivot(list(key), present(df, columns), variable, value)

