"""Master tables: weather with labels, side series, geography and calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskgrid.functions.nulls import numeric_columns, present
from riskgrid.operators.joins import attach, attach_daily, attach_sparse
from riskgrid.operators.resample import roll_up_daily, side_series_daily
from riskgrid.spec import DAILY, HOURLY, Panel

_VEGETATION = ("NDBI", "NDVI", "EVI")


def _day_grain(side: DataFrame | None, columns: dict[str, str]) -> DataFrame | None:
    return None if side is None else side_series_daily(side, columns)


def _calendar(df: DataFrame, t: str, hourly: bool) -> DataFrame:
    parts = {"Year": F.year(t), "Month": F.month(t), "DayOfYear": F.dayofyear(t), "DayOfWeek": F.weekday(t)}
    if hourly:
        parts["Hour"] = F.hour(t)
    return df.withColumns(parts)


def _finish(df: DataFrame, panel: Panel, geography: DataFrame | None, hourly: bool) -> DataFrame:
    if geography is not None:
        df = attach(df, geography, [panel.entity])
    df = _calendar(df, panel.time, hourly)
    return df.fillna(0, subset=numeric_columns(df))


def build_master_daily(
    weather_hourly: DataFrame,
    fires: DataFrame | None = None,
    burned: DataFrame | None = None,
    vegetation: DataFrame | None = None,
    geography: DataFrame | None = None,
    panel: Panel = DAILY,
) -> DataFrame:
    """One row per place and day; every side is reduced to day grain first, so no join multiplies rows."""
    out = roll_up_daily(weather_hourly, panel.entity, "Timestamp")
    if fires is not None:
        out = attach(out, fires, panel.key)
    else:
        out = out.withColumn("Fire_Occurred", F.lit(0))
    if burned is not None:
        out = attach(out, _day_grain(burned, {"Burned_Area_hectares": "max"}), panel.key)
    out = out.fillna(0, subset=present(out, ("fire_count", "mean_brightness", "max_frp", "Fire_Occurred", "Burned_Area_hectares")))
    if vegetation is not None:
        side = _day_grain(vegetation, {c: "mean" for c in _VEGETATION})
        out = attach_sparse(out, side, panel, _VEGETATION)
    return _finish(out, panel, geography, hourly=False)


def build_master_hourly(
    weather_hourly: DataFrame,
    fires: DataFrame | None = None,
    burned: DataFrame | None = None,
    vegetation: DataFrame | None = None,
    geography: DataFrame | None = None,
    panel: Panel = HOURLY,
) -> DataFrame:
    """One row per place and hour; daily sides are repeated on the hours of their day.

    Vegetation is filled on the daily axis and then joined by day, so the long
    hourly table is never windowed for it.
    """
    out = weather_hourly.withColumn("Date", F.to_date(panel.time))
    day = [panel.entity, "Date"]
    zero = {}
    if fires is not None:
        out = attach_daily(out, fires, panel.entity, panel.time)
        zero |= {c: 0 for c in present(fires, ("fire_count", "mean_brightness", "max_frp", "Fire_Occurred"))}
    else:
        out = out.withColumn("Fire_Occurred", F.lit(0))
    if burned is not None:
        out = attach(out, _day_grain(burned, {"Burned_Area_hectares": "max"}), day)
        zero["Burned_Area_hectares"] = 0
    out = out.fillna(zero) if zero else out
    if vegetation is not None:
        days = weather_hourly.select(panel.entity, F.to_date(panel.time).alias("Date")).distinct()
        side = _day_grain(vegetation, {c: "mean" for c in _VEGETATION})
        filled = attach_sparse(days, side, Panel(panel.entity, "Date"), _VEGETATION)
        out = attach(out, filled, day)
    return _finish(out, panel, geography, hourly=True)
