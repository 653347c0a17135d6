"""Weather indices and interaction terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskgrid.functions.nulls import as_column, clip, flag

# Magnus constants.
MAGNUS_A, MAGNUS_B, SATURATION = 17.27, 237.3, 0.6108


def vapour_pressure_deficit(temp: Column | str, humidity: Column | str) -> Column:
    t, h = as_column(temp), as_column(humidity)
    saturation = F.lit(SATURATION) * F.exp(F.lit(MAGNUS_A) * t / (t + MAGNUS_B))
    return clip(saturation * (1 - h / 100), low=0.0)


def dew_point(temp: Column | str, humidity: Column | str) -> Column:
    t = as_column(temp)
    gamma = F.lit(MAGNUS_A) * t / (t + MAGNUS_B) + F.ln(clip(humidity, low=1.0) / 100)
    return F.lit(MAGNUS_B) * gamma / (F.lit(MAGNUS_A) - gamma)


def heat_index(temp: Column | str, humidity: Column | str) -> Column:
    """Felt temperature; only above 27 degrees, the plain temperature below."""
    celsius, h = as_column(temp), as_column(humidity)
    f = celsius * 1.8 + 32
    # fixed values: the public regression of the heat index in degrees Fahrenheit
    felt = (
        F.lit(-42.379)
        + F.lit(2.04901523) * f
        + F.lit(10.14333127) * h
        + F.lit(-0.22475541) * f * h
        + F.lit(-6.83783e-3) * (f * f)
        + F.lit(-5.481717e-2) * (h * h)
        + F.lit(1.22874e-3) * (f * f) * h
        + F.lit(8.5282e-4) * f * (h * h)
        + F.lit(-1.99e-6) * (f * f) * (h * h)
    )
    return F.when(celsius > 27, (felt - 32) / 1.8).otherwise(celsius)


# The factors and limits of the fire-weather proxies below are fixed values.


def fine_fuel_code(temp: Column | str, humidity: Column | str, rain: Column | str) -> Column:
    drying = clip(temp, 0.0, 40.0) * 0.5
    wetting = as_column(humidity) * 0.5 + clip(rain, 0.0, 10.0) * 3
    return clip(F.lit(100.0) - wetting + drying, 0.0, 100.0)


def duff_load(temp: Column | str, humidity: Column | str, rain: Column | str) -> Column:
    """Daily addend whose 14-row mean is the duff moisture code."""
    return clip(temp, low=0.0) * 0.3 - as_column(rain) * 0.8 + (F.lit(100.0) - as_column(humidity)) * 0.1


def drought_load(temp: Column | str, rain: Column | str) -> Column:
    """Daily addend whose 30-row sum is the drought code."""
    return clip(temp, low=0.0) * 0.2 - as_column(rain) * 0.5


def spread_index(fine_fuel: Column | str, wind: Column | str) -> Column:
    return as_column(fine_fuel) / 100 * (as_column(wind) * 0.3)


def build_up_index(duff: Column | str, drought: Column | str) -> Column:
    return (as_column(duff) + as_column(drought)) / 2


def fire_weather_index(spread: Column | str, build_up: Column | str) -> Column:
    return clip(as_column(spread) * as_column(build_up) / 50, low=0.0)


def interactions(temp: str, humidity: str, wind: str, streak: str) -> list[Column]:
    t, h, w, s = map(F.col, (temp, humidity, wind, streak))
    return [
        (t * (100 - h) / 100).alias("temp_x_low_hum"),
        (t * w / 100).alias("temp_x_wind"),
        (s * w / 100).alias("dry_days_x_wind"),
    ]


def vegetation_interactions(ndvi: str, drought: str, trees: str, streak: str, vpd: str) -> list[Column]:
    n, d, tr, s, v = map(F.col, (ndvi, drought, trees, streak, vpd))
    return [
        (n * d / 100).alias("NDVI_x_drought"),
        (tr * s / 100).alias("forest_x_dry_days"),
        (n * v).alias("NDVI_x_VPD"),
    ]


def extreme_flags(temp: str, humidity: str, wind: str, streak: str, hot: Column, dry: Column, windy: Column) -> list[Column]:
    """Flags against fitted thresholds, the dry-spell flag and their product."""
    heat, arid, gale = (
        flag(F.col(temp) > hot),
        flag(F.col(humidity) < dry),
        flag(F.col(wind) > windy),
    )
    return [
        heat.alias("heatwave_flag"),
        arid.alias("low_humidity_flag"),
        gale.alias("high_wind_flag"),
        flag(F.col(streak) >= 7).alias("dry_spell_flag"),
        (heat * arid * gale).alias("hot_dry_windy"),
    ]
