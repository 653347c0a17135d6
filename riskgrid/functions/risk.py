"""Risk tiers, confidence, texts and the daily anchor as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskgrid.functions.nulls import as_column, clip, ratio
from riskgrid.spec import ANCHOR_FACTOR, ANCHOR_FLOOR, TIER_COLOURS, TIER_FLOORS, TIERS


def risk_tier(p: Column | str, closed: str = "left") -> Column:
    """Tier of a probability.

    ``closed="left"`` puts an edge value into the upper tier.  ``closed="right"``
    clips to [0, 1] first and puts an edge value into the lower tier.
    """
    p = as_column(p)
    right = closed == "right"
    value = clip(p, 0.0, 1.0) if right else p
    out = F.when(value.isNull(), F.lit(None).cast("string") if right else F.lit("Low"))
    for tier in reversed(TIERS[1:]):
        edge = TIER_FLOORS[tier]
        out = out.when(value > edge if right else value >= edge, tier)
    return out.otherwise(TIERS[0])


def tier_rank(tier: Column | str) -> Column:
    tier = as_column(tier)
    out = F.when(tier == TIERS[0], 0)
    for rank, name in enumerate(TIERS[1:], start=1):
        out = out.when(tier == name, rank)
    return out


def tier_colour(tier: Column | str) -> Column:
    pairs = [F.lit(x) for item in TIER_COLOURS.items() for x in item]
    return F.create_map(*pairs)[as_column(tier)]


def confidence(p: Column | str) -> Column:
    return clip(F.abs(as_column(p) - 0.5) * 0.8 + 0.55, 0.55, 0.95)


def weather_sentence(temp: Column | str, wind: Column | str, humidity: Column | str, rain: Column | str) -> Column:
    """Short description; an unknown temperature reads as mild."""
    t = as_column(temp)
    parts = F.concat_ws(
        ", ",
        F.when(t >= 28, "hot conditions").when(t <= 12, "cool conditions").otherwise("mild temperatures"),
        F.when(as_column(wind) >= 18, "strong wind"),
        F.when(as_column(humidity) <= 40, "dry air"),
        F.when(as_column(rain) >= 2, "recent rainfall"),
    )
    return F.concat(F.upper(F.substring(parts, 1, 1)), F.substr(parts, F.lit(2)), F.lit("."))


# The four published warning texts.
WARN_TIER = "High temperature, dry air, and wind can accelerate wildfire spread."
WARN_WIND = "Wind is elevated, so small ignitions could spread faster."
WARN_DRY = "Low humidity can dry vegetation and raise ignition sensitivity."
WARN_NONE = "Current conditions suggest limited short-term wildfire pressure."


def warning_sentence(tier: Column | str, wind: Column | str, humidity: Column | str) -> Column:
    return (
        F.when(as_column(tier).isin("High", "Extreme"), WARN_TIER)
        .when(as_column(wind) >= 18, WARN_WIND)
        .when(as_column(humidity) <= 40, WARN_DRY)
        .otherwise(WARN_NONE)
    )


def anchored(hourly_p: Column | str, daily_p: Column | str, factor: float = ANCHOR_FACTOR, floor: float = ANCHOR_FLOOR) -> Column:
    """Hourly probability capped by its day; unchanged where the day has none."""
    h, d = as_column(hourly_p), as_column(daily_p)
    return F.when(d.isNull(), h).otherwise(F.least(h, F.greatest(d * factor, F.lit(floor))))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return ratio(precision * recall * (1 + b2), precision * b2 + recall)


def recall_score_mix(recall: Column, f1: Column) -> Column:
    return recall * 0.6 + f1 * 0.4


def selection_score_mix(pr_auc: Column, f1: Column, recall: Column, precision: Column) -> Column:
    return pr_auc * 0.35 + f1 * 0.30 + recall * 0.20 + precision * 0.15
