"""Feature jobs: fit on history, apply to any frame.

Fitted statistics (thresholds, monthly means, medians) are small frames; every
job is one plan in which joins with fitted tables come first and all windows
follow on the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskgrid.functions import indices as I
from riskgrid.functions.calendar import DATE_PART_NAMES, HOUR_PART_NAMES, add_date_parts, add_hour_parts
from riskgrid.functions.nulls import clip, numeric_columns, present
from riskgrid.operators import joins as J
from riskgrid.operators import panel as P
from riskgrid.operators.clean import default_history, estimate_extremes, fill_zero, hour_proxies, impute_entity_median, one_hot, repair_features, winsorise
from riskgrid.operators.stats import as_scalar_row, fit_medians, fit_monthly_means, fit_spread, fit_thresholds
from riskgrid.plans.incremental import keep_latest
from riskgrid.session import cut_lineage
from riskgrid.spec import (
    DAILY, DAILY_WEATHER, EVENT_WINDOWS, HOURLY, LABEL, LAGS_DAILY, LAGS_HOURLY, ROLLS_DAILY, ROLLS_HOURLY, STATIC_COLUMNS, Panel,
)

T, H, W, R = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"
ANOMALY_VARIABLES = (T, H, R, W, "Solar_Radiation_Wm2_mean")
SURFACE_VARIABLES = DAILY_WEATHER + ("FWI_proxy", "VPD_kPa", "dry_days_streak")
HISTORY_VARIABLES = (
    T, "Temperature_C_max", H, "Humidity_percent_min", W, "Wind_Speed_kmh_max", R,
    "Solar_Radiation_Wm2_mean", "Soil_Temp_C_mean", "Soil_Moisture_mean", "FWI_proxy",
)
HOURLY_LAGGED = ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh", "Rain_mm", "Solar_Radiation_Wm2")
_MONTH_MEAN = "_month_mean"


@dataclass(frozen=True)
class Fitted:
    """Statistics taken from history: thresholds (global or per entity) and (entity, month) means."""

    thresholds: DataFrame
    monthly: DataFrame
    per_entity: bool = False


def fit_statistics(history: DataFrame, panel: Panel = DAILY, per_entity: bool = False, variables: Sequence[str] = ANOMALY_VARIABLES) -> Fitted:
    scope = [panel.entity] if per_entity else []
    dated = history if "Month" in history.columns else history.withColumn("Month", F.month(panel.time))
    return Fitted(
        fit_thresholds(history, T, H, W, scope),
        fit_monthly_means(dated, present(history, variables), panel.entity),
        per_entity,
    )


LIMITS = ("hot", "dry", "windy")


def attach_fitted(df: DataFrame, fitted: Fitted, panel: Panel) -> DataFrame:
    """Add the monthly means and the three limits to every row."""
    out = df.join(fitted.monthly, [panel.entity, "Month"], "left")
    if fitted.per_entity:
        return out.join(fitted.thresholds, panel.entity, "left")
    out = out.select("*", as_scalar_row(fitted.thresholds).alias("__limits"))
    return out.select("*", *[F.col("__limits").getField(c).alias(c) for c in LIMITS]).drop("__limits")


def add_fire_weather(df: DataFrame, panel: Panel = DAILY, also: Sequence[P.Builder] = (), lookback: int = 30) -> DataFrame:
    """Fuel moisture, spread, build-up and fire weather proxies; ``also`` rides on the same windows."""
    loaded = df.select(
        "*",
        I.fine_fuel_code(T, H, R).alias("FFMC_proxy"),
        I.duff_load(T, H, R).alias("__duff"),
        I.drought_load(T, R).alias("__drought"),
    )
    builders = [
        P.trailing_mean("__duff", 14, "__dmc", include_current=True),
        P.trailing_sum("__drought", 30, "__dc", include_current=True),
        *also,
    ]
    out = P.row_features(loaded, panel, builders, max(lookback, 30))
    out = out.withColumns({"DMC_proxy": clip("__dmc", low=0.0), "DC_proxy": clip("__dc", low=0.0), "ISI_proxy": I.spread_index("FFMC_proxy", W)})
    out = out.withColumn("BUI_proxy", I.build_up_index("DMC_proxy", "DC_proxy"))
    return out.withColumn("FWI_proxy", I.fire_weather_index("ISI_proxy", "BUI_proxy")).drop("__duff", "__drought", "__dmc", "__dc")


def add_weather_features(df: DataFrame, fitted: Fitted, panel: Panel = DAILY, also: Sequence[P.Builder] = (), lookback: int = 30) -> DataFrame:
    """Fire weather, vapour pressure, dew point, heat index, deficit, streak, flags, interactions, anomalies."""
    out = attach_fitted(df, fitted, panel)
    out = add_fire_weather(out, panel, [P.trailing_sum(R, 30, "Rain_roll30_sum"), *also], lookback)
    out = P.dry_streak(out, panel, R)
    anomalies = [
        (F.col(c.removesuffix(_MONTH_MEAN)) - F.col(c)).alias(c.replace(_MONTH_MEAN, "_anomaly"))
        for c in fitted.monthly.columns
        if c.endswith(_MONTH_MEAN)
    ]
    out = out.select(
        "*",
        I.vapour_pressure_deficit(T, H).alias("VPD_kPa"),
        I.dew_point(T, H).alias("Dew_Point_C"),
        I.heat_index(T, H).alias("Heat_Index"),
        (F.col(f"{R}{_MONTH_MEAN}") * 30 - F.coalesce("Rain_roll30_sum", F.lit(0.0))).alias("Rainfall_Deficit"),
        *I.extreme_flags(T, H, W, "dry_days_streak", *[F.col(c) for c in LIMITS]),
        *I.interactions(T, H, W, "dry_days_streak"),
        *anomalies,
    )
    fitted_columns = [c for c in fitted.monthly.columns if c.endswith(_MONTH_MEAN)]
    return out.drop(*LIMITS, *fitted_columns)


def add_vegetation_terms(df: DataFrame) -> DataFrame:
    """Vegetation by drought, streak and vapour pressure; absent inputs count as 0."""
    absent = {c: F.lit(0.0) for c in ("NDVI", "Trees_pct") if c not in df.columns}
    out = df.withColumns(absent) if absent else df
    drought = "Rainfall_Deficit" if "Rainfall_Deficit" in df.columns else "DC_proxy"
    return out.select("*", *I.vegetation_interactions("NDVI", drought, "Trees_pct", "dry_days_streak", "VPD_kPa")).drop(*absent)


def build_features(df: DataFrame, fitted: Fitted, cities: Sequence[str] = (), panel: Panel = DAILY) -> DataFrame:
    """The surface that can be computed for history and forecast alike."""
    out = add_weather_features(add_date_parts(df, panel.time), fitted, panel)
    use = present(out, SURFACE_VARIABLES)
    out = P.row_features(out, panel, [P.lags(use, LAGS_DAILY), P.rolls(use, ROLLS_DAILY)], max(LAGS_DAILY + ROLLS_DAILY))
    return one_hot(out, panel.entity, cities) if cities else out


def engineer_daily(
    master: DataFrame,
    fitted: Fitted | None = None,
    day_extras: DataFrame | None = None,
    residuals: DataFrame | None = None,
    winsor: Sequence[str] = (),
    panel: Panel = DAILY,
) -> DataFrame:
    """Full daily feature table.

    ``day_extras`` are hour-based day features, ``residuals`` seasonal
    predictions and residuals, both keyed by entity and day.
    """
    # fits and features below all read the panel, so it is materialised once
    clean = cut_lineage(keep_latest(master, panel.key))
    if winsor:
        clean = winsorise(clean, list(winsor))
    clean = impute_entity_median(clean, [c for c in numeric_columns(clean) if c not in (LABEL, "fire_count")], panel.entity)
    fitted = fit_statistics(clean, panel) if fitted is None else fitted
    for side in (day_extras, residuals):
        if side is not None:
            new = [c for c in side.columns if c not in clean.columns]
            clean = clean.join(side.select(*panel.key, *new), panel.key, "left")
    # the one order by month comes first, so that all else shares one sort
    dated = P.event_rate_so_far(add_date_parts(clean, panel.time), panel, name="city_month_fire_rate", by=["Month"])
    out = add_weather_features(dated, fitted, panel, [P.event_counts()], max(EVENT_WINDOWS))
    out = P.rows_since_event(out, panel)
    out = P.event_rate_so_far(out, panel, name="city_fire_rate")
    use = present(out, HISTORY_VARIABLES)
    out = P.row_features(out, panel, [P.lags(use, LAGS_DAILY), P.rolls(use, ROLLS_DAILY)], max(LAGS_DAILY + ROLLS_DAILY))
    if "temp_range" not in out.columns:
        out = out.withColumn("temp_range", F.col("Temperature_C_max") - F.col("Temperature_C_min"))
    return fill_zero(add_vegetation_terms(out))


def engineer_hourly(master: DataFrame, panel: Panel = HOURLY, day_from: int = 6, day_to: int = 20) -> DataFrame:
    """Hourly lags, rolling statistics and calendar."""
    use = present(master, HOURLY_LAGGED)
    dated = add_hour_parts(add_date_parts(master, panel.time), panel.time, day_from, day_to)
    out = P.row_features(
        dated, panel, [P.lags(use, LAGS_HOURLY, "h"), P.rolls(use, ROLLS_HOURLY, unit="h")], max(LAGS_HOURLY + ROLLS_HOURLY)
    )
    return fill_zero(out)


def training_frame(history: DataFrame, cities: Sequence[str] = (), panel: Panel = DAILY, fitted: Fitted | None = None) -> DataFrame:
    """Features of the needed columns; absent static columns become 0."""
    needed = present(history, (*panel.key, LABEL, *DAILY_WEATHER, *STATIC_COLUMNS))
    absent = [c for c in STATIC_COLUMNS if c not in history.columns]
    rows = cut_lineage(history.select(*needed, *[F.lit(0.0).alias(c) for c in absent]))
    return build_features(rows, fit_statistics(rows, panel) if fitted is None else fitted, cities, panel)


def forecast_frame(
    history: DataFrame, forecast: DataFrame, cities: Sequence[str] = (), panel: Panel = DAILY, span: str = "45 days"
) -> DataFrame:
    """Features of the horizon: history tail and forecast together, statistics from full history.

    Only the tail is read into windows, yet thresholds and monthly means come
    from all of history.
    """
    history, forecast = cut_lineage(history), cut_lineage(forecast)
    static = present(history, STATIC_COLUMNS)
    future = J.attach_latest(forecast.drop(*static), history, panel, static)
    tail = J.history_tail(history, forecast, panel, span)
    both = tail.unionByName(future, allowMissingColumns=True)
    columns = present(both, (*panel.key, LABEL, *DAILY_WEATHER, *STATIC_COLUMNS))
    features = build_features(both.select(*columns), fit_statistics(history, panel), cities, panel)
    return J.keep_times_of(features, forecast, panel)


def daily_horizon(
    history: DataFrame,
    forecast: DataFrame,
    geography: DataFrame | None = None,
    panel: Panel = DAILY,
    span: str = "90 days",
    carried: Sequence[str] = (),
) -> DataFrame:
    """Full feature set for the daily horizon, all entities in one plan."""
    # every statistic below reads history: it is stored once
    history, forecast = cut_lineage(history), cut_lineage(forecast)
    spread_of = ["Temperature_C", "Humidity_percent", "Wind_Speed_kmh", "Soil_Temp_C", "Soil_Moisture"]
    known = [v for v in spread_of if all(f"{v}_{s}" in history.columns for s in ("mean", "min", "max"))]
    future = estimate_extremes(forecast, fit_spread(history, known), known)
    if "Wind_Dir_deg_mean" in history.columns and "Wind_Dir_deg_mean" not in future.columns:
        direction = fit_medians(
            history.withColumn("Month", F.month(panel.time)), ["Wind_Dir_deg_mean"], [panel.entity, "Month"], suffix=""
        )
        future = future.withColumn("Month", F.month(panel.time)).join(direction, [panel.entity, "Month"], "left").drop("Month")
    shared = [c for c in future.columns if c in history.columns]
    extra = present(history, (LABEL, "NDVI", "EVI", "NDBI"))
    recent = J.history_tail(history, future, panel, span).select(*shared, *[c for c in extra if c not in shared])
    both = P.overlay(recent, future.select(*shared), panel.key)
    both = P.fill_gaps(both.fillna(0, subset=present(both, [LABEL])), panel, ["NDVI", "EVI", "NDBI"], backward=False)
    dated = P.event_rate_so_far(add_date_parts(both, panel.time), panel, name="city_month_fire_rate", by=["Month"])
    out = add_weather_features(dated, fit_statistics(history, panel), panel, [P.event_counts()], max(EVENT_WINDOWS))
    out = P.rows_since_event(out, panel)
    out = P.event_rate_so_far(out, panel, name="city_fire_rate")
    use = present(out, HISTORY_VARIABLES)
    out = P.row_features(out, panel, [P.lags(use, LAGS_DAILY), P.rolls(use, ROLLS_DAILY)], max(LAGS_DAILY + ROLLS_DAILY))
    if geography is not None:
        out = J.attach_with_fallback(out, geography, [panel.entity])
    out = add_vegetation_terms(out)
    if carried:
        out = out.join(J.last_known(history, panel, carried), panel.entity, "left")
    return fill_zero(J.keep_times_of(out.select("*", *hour_proxies()), forecast, panel))


def hourly_horizon(
    history: DataFrame,
    forecast: DataFrame,
    geography: DataFrame | None = None,
    panel: Panel = HOURLY,
    span: str = "336 hours",
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Features of the hourly horizon; with ``wanted`` also repaired to the model's columns."""
    columns = [c for c in forecast.columns if c in history.columns]
    recent = J.history_tail(history.select(*columns), forecast, panel, span)
    both = P.overlay(recent, forecast.select(*columns), panel.key)
    use = present(both, HOURLY_LAGGED)
    dated = add_hour_parts(add_date_parts(both, panel.time), panel.time)
    out = P.row_features(dated, panel, [P.lags(use, LAGS_HOURLY, "h"), P.rolls(use, ROLLS_HOURLY, unit="h")], 24)
    if geography is not None:
        out = J.attach_with_fallback(out, geography, [panel.entity])
    out = J.keep_times_of(out, forecast, panel)
    if wanted is None:
        return fill_zero(out)
    from_history = engineer_hourly(history, panel)
    fitted = present(from_history, wanted)
    base = ("Rain_mm", "Wind_Speed_kmh", "Wind_Dir_deg", "Solar_Radiation_Wm2", "Soil_Temp_C", "Soil_Moisture", "NDBI", "NDVI", "EVI")
    base += ("Elevation", "Slope", "Trees_pct", "Urban_pct")
    return repair_features(
        out.select(*panel.key, *present(out, wanted)),
        wanted,
        fit_medians(from_history, fitted, [panel.entity]),
        base,
        DATE_PART_NAMES + HOUR_PART_NAMES,
        panel.entity,
    )


# The reduced lag set of the daily refresh.
REFRESH_LAGS = {
    "Temperature_C_max": (2,),
    "Humidity_percent_mean": (1, 3, 5, 7, 14, 30),
    "Humidity_percent_min": (1, 2, 3, 5, 7, 14, 30),
    "Wind_Speed_kmh_mean": (1, 2, 3, 5, 7, 14, 30),
    "Wind_Speed_kmh_max": (1, 2, 3, 5, 7, 14, 30),
    "Rain_mm_sum": (1, 2, 3, 5, 7, 14, 30),
    "Solar_Radiation_Wm2_mean": (1, 3, 5, 7, 14, 30),
    "Soil_Temp_C_mean": (14, 30),
    "Soil_Moisture_mean": (2, 5, 14, 30),
    "FWI_proxy": (1, 3, 5, 7, 14, 30),
}
REFRESH_ANOMALIES = (T, R, W, "Solar_Radiation_Wm2_mean")


def refresh_features(daily: DataFrame, geography: DataFrame | None = None, panel: Panel = DAILY) -> DataFrame:
    """Daily refresh: thresholds per entity, reduced lags, default event history, zero residuals."""
    fitted = fit_statistics(daily, panel, per_entity=True, variables=REFRESH_ANOMALIES)
    out = add_weather_features(add_date_parts(daily, panel.time), fitted, panel)
    use = present(out, HISTORY_VARIABLES)
    builders = [P.lags([v], steps) for v, steps in REFRESH_LAGS.items() if v in out.columns]
    out = P.row_features(out, panel, [*builders, P.rolls(use, ROLLS_DAILY)], 30)
    out = out.select(
        "*",
        *[F.col(v).alias(f"prophet_{v}_pred") for v in (T, H, R, W)],
        *[F.lit(0.0).alias(f"prophet_{v}_resid") for v in (T, H)],
    )
    if geography is not None:
        out = J.attach(out, geography, [panel.entity])
    return default_history(add_vegetation_terms(out))

