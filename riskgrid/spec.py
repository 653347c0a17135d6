"""Column roles and fixed values shared by the whole library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec


@dataclass(frozen=True)
class Panel:
    """Roles of an entity-time table with a unique ``(entity, time)`` key.

    The key bounds every entity to one row per time step, so a daily entity
    holds at most a few ten thousand rows however large the raw input is.  For
    finer grains set ``chunk`` to a calendar unit ("year", "month", "day"): the
    window operators then split each entity into calendar chunks and stitch the
    chunks together, so that no task ever sorts a whole entity.
    """

    entity: str = "City"
    time: str = "Date"
    chunk: str | None = None

    @property
    def key(self) -> list[str]:
        return [self.entity, self.time]

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.time)


DAILY = Panel("City", "Date")
HOURLY = Panel("City", "Timestamp", chunk="month")

# Column names and numbers that results are defined by.

LABEL = "Fire_Occurred"

TIERS = ("Low", "Moderate", "High", "Extreme")
TIER_FLOORS = {"Moderate": 0.15, "High": 0.35, "Extreme": 0.60}
TIER_COLOURS = {
    "Low": "#3FA773",
    "Moderate": "#D8A31D",
    "High": "#D96C3B",
    "Extreme": "#B73333",
}
TIER_TEXT = {
    "Low": "< 15%",
    "Moderate": "15% to 35%",
    "High": "35% to 60%",
    "Extreme": ">= 60%",
}

ANCHOR_FACTOR = 2.5
ANCHOR_FLOOR = 0.15

HOURLY_VARIABLES = (
    "Temperature_C",
    "Humidity_percent",
    "Rain_mm",
    "Wind_Speed_kmh",
    "Wind_Dir_deg",
    "Pressure_hPa",
    "Solar_Radiation_Wm2",
    "Soil_Temp_C",
    "Soil_Moisture",
)

API_NAMES = {
    "temperature_2m": "Temperature_C",
    "relative_humidity_2m": "Humidity_percent",
    "precipitation": "Rain_mm",
    "wind_speed_10m": "Wind_Speed_kmh",
    "wind_direction_10m": "Wind_Dir_deg",
    "surface_pressure": "Pressure_hPa",
    "shortwave_radiation": "Solar_Radiation_Wm2",
    "soil_temperature_0_to_7cm": "Soil_Temp_C",
    "soil_moisture_0_to_7cm": "Soil_Moisture",
}

DAILY_WEATHER = (
    "Temperature_C_mean",
    "Humidity_percent_mean",
    "Rain_mm_sum",
    "Wind_Speed_kmh_mean",
    "Pressure_hPa_mean",
    "Solar_Radiation_Wm2_mean",
    "Soil_Temp_C_mean",
    "Soil_Moisture_mean",
)
HOURLY_TARGETS = (
    "Temperature_C",
    "Humidity_percent",
    "Wind_Speed_kmh",
    "Solar_Radiation_Wm2",
)

# Columns that would leak the outcome into a model.
LEAK_COLUMNS = ("fire_count", "mean_brightness", "max_frp", "Burned_Area_hectares")
# Columns that are never model inputs.
NON_FEATURES = ("City", "Date", "Timestamp", LABEL) + LEAK_COLUMNS

STATIC_COLUMNS = (
    "Latitude",
    "Longitude",
    "Elevation",
    "Slope",
    "Trees_pct",
    "Urban_pct",
    "Pop_Total",
    "NDBI",
    "NDVI",
    "EVI",
)

LAGS_DAILY = (1, 2, 3, 5, 7, 14, 30)
ROLLS_DAILY = (3, 7, 14, 30)
LAGS_HOURLY = (1, 3, 6, 12, 24)
ROLLS_HOURLY = (6, 12, 24)
EVENT_WINDOWS = (7, 14, 30, 90)

# Physical ranges used when a forecast is clipped.
FORECAST_BOUNDS = {
    "Temperature_C_mean": (-60.0, 60.0),
    "Humidity_percent_mean": (0.0, 100.0),
    "Rain_mm_sum": (0.0, 500.0),
    "Wind_Speed_kmh_mean": (0.0, 200.0),
    "Pressure_hPa_mean": (800.0, 1100.0),
    "Solar_Radiation_Wm2_mean": (0.0, 1400.0),
    "Soil_Temp_C_mean": (-20.0, 60.0),
    "Soil_Moisture_mean": (0.0, 1.0),
    "Temperature_C": (-60.0, 60.0),
    "Humidity_percent": (0.0, 100.0),
    "Rain_mm": (0.0, 100.0),
    "Wind_Speed_kmh": (0.0, 200.0),
    "Pressure_hPa": (800.0, 1100.0),
    "Solar_Radiation_Wm2": (0.0, 1400.0),
}
# Physical ranges used by the quality checks.
CHECK_BOUNDS = {
    "Temperature_C_mean": (-60.0, 60.0),
    "Humidity_percent_mean": (0.0, 100.0),
    "Rain_mm_sum": (0.0, 500.0),
    "Wind_Speed_kmh_mean": (0.0, 200.0),
    "Pressure_hPa_mean": (800.0, 1100.0),
    "Solar_Radiation_Wm2_mean": (0.0, 1400.0),
    "Soil_Moisture_mean": (0.0, 1.0),
    "Temperature_C": (-60.0, 60.0),
    "Humidity_percent": (0.0, 100.0),
    "Rain_mm": (0.0, 100.0),
    "Wind_Speed_kmh": (0.0, 200.0),
    "Pressure_hPa": (800.0, 1100.0),
    "Solar_Radiation_Wm2": (0.0, 1400.0),
    "Soil_Moisture": (0.0, 1.0),
}
