"""Public projections of risk tables and the metrics document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import clip, flag, present
from riskgrid.functions.risk import confidence, risk_tier, tier_colour, warning_sentence, weather_sentence
from riskgrid.operators.joins import cap_by_day
from riskgrid.spec import DAILY_WEATHER, TIER_TEXT

# Published column order.
DAILY_PUBLIC = (
    "date", "region", "risk_level", "probability", "confidence", "risk_score", "predicted_fire", "temperature", "wind", "humidity",
    "rain", "Temperature_C_mean", "Humidity_percent_mean", "Rain_mm_sum", "Wind_Speed_kmh_mean", "Pressure_hPa_mean",
    "Solar_Radiation_Wm2_mean", "Soil_Temp_C_mean", "Soil_Moisture_mean", "Latitude", "Longitude", "climate_summary", "warning", "risk_color",
)
HOURLY_PUBLIC = (
    "timestamp", "region", "probability", "risk_level", "risk_score", "predicted_fire", "confidence", "risk_color",
    "temperature", "humidity", "wind", "solar", "Latitude", "Longitude",
)


def override_coordinates(df: DataFrame, places: DataFrame, entity: str = "City") -> DataFrame:
    """Canonical coordinates replace whatever the frame carries."""
    known = places.select(entity, "Latitude", "Longitude")
    return df.drop("Latitude", "Longitude").join(known, entity, "left")


def risk_columns(p: str, threshold: float) -> dict[str, Column]:
    return {
        "risk_level": risk_tier(p),
        "risk_score": F.round(F.col(p) * 100, 1),
        "predicted_fire": flag(F.col(p) >= threshold),
        "confidence": confidence(p),
        "risk_color": tier_colour(risk_tier(p)),
    }


def publish_daily(scored: DataFrame, places: DataFrame, threshold: float, p: str = "probability", entity: str = "City") -> DataFrame:
    """Twenty-four public columns per region and day."""
    t, h, w, r = "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean", "Rain_mm_sum"
    absent = {c: F.lit(None).cast("double") for c in DAILY_WEATHER if c not in scored.columns}
    out = override_coordinates(scored, places, entity).withColumns(
        {
            **absent,
            "date": F.date_format("Date", "yyyy-MM-dd"),
            "region": F.col(entity),
            "probability": F.col(p),
            **risk_columns(p, threshold),
        }
    )
    out = out.withColumns(
        {
            "temperature": F.round(t, 1),
            "wind": F.round(w, 1),
            "humidity": F.round(h, 1),
            "rain": F.round(r, 2),
            "climate_summary": weather_sentence(t, w, h, r),
            "warning": warning_sentence("risk_level", w, h),
        }
    )
    return out.select(*DAILY_PUBLIC)


def publish_hourly(
    scored: DataFrame, places: DataFrame, threshold: float, daily: DataFrame | None = None, p: str = "probability", entity: str = "City"
) -> DataFrame:
    """Public hourly columns; probabilities clipped and capped by the day when daily risk is given."""
    out = scored.withColumn("probability", clip(p, 0.0, 1.0))
    if daily is not None:
        out = cap_by_day(out, daily)
    out = override_coordinates(out, places, entity).withColumns(
        {
            "timestamp": F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm"),
            "region": F.col(entity),
            **risk_columns("probability", threshold),
        }
    )
    names = {"Temperature_C": "temperature", "Humidity_percent": "humidity", "Wind_Speed_kmh": "wind", "Solar_Radiation_Wm2": "solar"}
    out = out.withColumns({new: F.round(old, 1) for old, new in names.items() if old in out.columns})
    return out.select(*present(out, HOURLY_PUBLIC))


def score_horizon(features: DataFrame, p: Column, threshold: float, keep: Sequence[str], closed: str = "right") -> DataFrame:
    """Keyed risk table of a horizon: probability, flag and tier beside the kept columns."""
    out = features.withColumn("fire_probability", p)
    return out.select(
        *keep,
        "fire_probability",
        flag(F.col("fire_probability") >= threshold).alias("fire_predicted"),
        risk_tier("fire_probability", closed).alias("risk_level"),
    )


def top_risks(risk: DataFrame, n: int = 10, p: str = "fire_probability", ties: Sequence[str] = ("City", "Date")) -> DataFrame:
    return risk.orderBy(F.desc(p), *ties).limit(n)


def metrics_document(board: DataFrame, chosen: DataFrame, split: tuple[str, str], features: int, horizon_days: int, hourly: DataFrame | None = None) -> DataFrame:
    """One nested row describing the model; the leaderboard holds one entry per model."""
    entries = board.agg(F.sort_array(F.collect_list(F.struct("model", "recall", "precision", "f1", "pr_auc"))).alias("leaderboard"))
    head = chosen.select(F.struct(F.col("model").alias("m"), F.col("threshold").alias("t")).alias("c")).scalar()
    out = entries.select(
        head.getField("m").alias("selected_model"),
        head.getField("t").alias("selected_threshold"),
        F.lit(horizon_days).alias("prediction_horizon_days"),
        F.lit(features).alias("feature_count"),
        F.struct(
            F.lit(f"< {split[0]}").alias("train"), F.lit(f"{split[0]} to {split[1]}").alias("validation"), F.lit(f">= {split[1]}").alias("test")
        ).alias("temporal_split"),
        F.struct(*[F.lit(text).alias(tier) for tier, text in TIER_TEXT.items()]).alias("risk_levels"),
        "leaderboard",
    )
    if hourly is not None:
        block = hourly.select(F.struct(*hourly.columns).alias("h")).scalar()
        out = out.withColumn("hourly_model", block)
    return out
