"""Composite jobs: master tables, feature tables, horizons, refresh, incremental save."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.operators import resample as R
from riskgrid.plans import features as X
from riskgrid.plans import forecast as G
from riskgrid.plans import incremental as N
from riskgrid.plans.master import build_master_daily, build_master_hourly
from riskgrid.spec import DAILY, DAILY_WEATHER
from riskgrid.workload import binding as B
from riskgrid.workload.columns import DEW_SQL, HEAT_SQL, VPD_SQL, date_parts_sql
from riskgrid.workload.panels import HISTORY_SQL, r6
from riskgrid.workload.registry import query

T, H, W, RN, SOLAR = '"Temperature_C_mean"', '"Humidity_percent_mean"', '"Wind_Speed_kmh_mean"', '"Rain_mm_sum"', '"Solar_Radiation_Wm2_mean"'
ANOMALIES = {"Temperature_C_mean": "mt", "Humidity_percent_mean": "mh", "Rain_mm_sum": "mr", "Wind_Speed_kmh_mean": "mw", "Solar_Radiation_Wm2_mean": "ms"}


def feature_ctes(source: str, history: str, per_place: bool = False) -> str:
    """CTE chain ending in ``feat``: weather features of ``source`` with statistics of ``history``."""
    group = ' GROUP BY "City"' if per_place else ""
    key = '"City", ' if per_place else ""
    on = 'LEFT JOIN th USING ("City")' if per_place else "CROSS JOIN th"
    vpd, dew, heat = (s.format(t=T, h=H) for s in (VPD_SQL, DEW_SQL, HEAT_SQL))
    return f"""mm AS (SELECT "City", month("Date") AS mo, {', '.join(f'avg("{v}") AS {a}' for v, a in ANOMALIES.items())} FROM {history} GROUP BY 1, 2),
    th AS (SELECT {key}quantile_cont({T}, 0.95) AS hot, quantile_cont({H}, 0.10) AS dry, quantile_cont({W}, 0.90) AS windy FROM {history}{group}),
    fa AS (SELECT s.*, m.* EXCLUDE ("City", mo), hot, dry, windy, month("Date") AS mth,
      least(greatest(100 - ({H} * 0.5 + least(greatest({RN}, 0), 10) * 3 - least(greatest({T}, 0), 40) * 0.5), 0), 100) AS "FFMC_proxy",
      greatest({T}, 0) * 0.3 - {RN} * 0.8 + (100 - {H}) * 0.1 AS duff, greatest({T}, 0) * 0.2 - {RN} * 0.5 AS drought,
      CAST({RN} < 0.1 AS INTEGER) AS is_dry FROM {source} s LEFT JOIN mm m ON m."City" = s."City" AND mo = month(s."Date") {on.replace('USING ("City")', 'ON th."City" = s."City"')}),
    fb AS (SELECT *, row_number() OVER w AS rn, sum(1 - is_dry) OVER w AS island,
      greatest(avg(duff) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS "DMC_proxy",
      greatest(sum(drought) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0) AS "DC_proxy",
      sum({RN}) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS "Rain_roll30_sum" FROM fa WINDOW w AS (PARTITION BY "City" ORDER BY "Date")),
    fc1 AS (SELECT *, CAST(sum(is_dry) OVER (PARTITION BY "City", island ORDER BY "Date") AS INTEGER) AS dry_days_streak,
      "FFMC_proxy" / 100 * ({W} * 0.3) AS "ISI_proxy", ("DMC_proxy" + "DC_proxy") / 2 AS "BUI_proxy" FROM fb),
    fd AS (SELECT *, greatest("ISI_proxy" * "BUI_proxy" / 50, 0) AS "FWI_proxy", {vpd} AS "VPD_kPa", {dew} AS "Dew_Point_C", {heat} AS "Heat_Index",
      mr * 30 - coalesce("Rain_roll30_sum", 0) AS "Rainfall_Deficit", CAST({T} > hot AS INTEGER) AS heatwave_flag, CAST({H} < dry AS INTEGER) AS low_humidity_flag,
      CAST({W} > windy AS INTEGER) AS high_wind_flag, CAST(dry_days_streak >= 7 AS INTEGER) AS dry_spell_flag, {T} * (100 - {H}) / 100 AS temp_x_low_hum,
      {T} * {W} / 100 AS temp_x_wind, dry_days_streak * {W} / 100 AS dry_days_x_wind, {', '.join(f'"{v}" - {a} AS "{v}_anomaly"' for v, a in ANOMALIES.items())} FROM fc1),
    feat AS (SELECT *, heatwave_flag * low_humidity_flag * high_wind_flag AS hot_dry_windy FROM fd)"""


FLOATS = ["FFMC_proxy", "DMC_proxy", "DC_proxy", "ISI_proxy", "BUI_proxy", "FWI_proxy"]
WEATHER_FLOATS = FLOATS + ["VPD_kPa", "Dew_Point_C", "Heat_Index", "Rain_roll30_sum", "Rainfall_Deficit", "temp_x_low_hum", "temp_x_wind", "dry_days_x_wind"]
FLAGS = ["dry_days_streak", "heatwave_flag", "low_humidity_flag", "high_wind_flag", "dry_spell_flag", "hot_dry_windy"]
ANOMALY_COLUMNS = [f"{v}_anomaly" for v in ANOMALIES]


def rounded(*names: str, zero: bool = False) -> str:
    return ", ".join(r6(f'coalesce("{n}", 0)' if zero else f'"{n}"', n) for n in names)


def quoted(*names: str) -> str:
    return ", ".join(f'"{n}"' for n in names)


@query(f"""WITH {B.WEATHER}, {feature_ctes('weather', 'weather')} SELECT "City", "Date", {rounded(*FLOATS)} FROM feat""")
def fire_weather_index(t):
    base = B.weather_daily(t).select("City", "Date", X.T, X.H, X.W, X.R)
    return B.round_all(X.add_fire_weather(base).drop(X.T, X.H, X.W, X.R))


@query(
    f"""WITH {B.WEATHER}, {feature_ctes('weather', 'weather')} SELECT "City", "Date", {rounded(*WEATHER_FLOATS, *ANOMALY_COLUMNS)}, {quoted(*FLAGS)} FROM feat"""
)
def weather_feature_set(t):
    base = B.weather_daily(t).withColumn("Month", F.month("Date"))
    out = X.add_weather_features(base, X.fit_statistics(base))
    return B.round_all(out.select("City", "Date", *WEATHER_FLOATS, *ANOMALY_COLUMNS, *FLAGS))


@query(
    f"""WITH {B.WEATHER}, train AS (SELECT * FROM weather WHERE "Date" < DATE '2000-01-01'), {feature_ctes('weather', 'train', per_place=True)}
    SELECT "City", "Date", {rounded("Rainfall_Deficit", *ANOMALY_COLUMNS)}, {quoted(*FLAGS)} FROM feat"""
)
def weather_features_train_fit(t):
    """Thresholds per place and monthly means from training rows only, applied to all rows."""
    base = B.weather_daily(t).withColumn("Month", F.month("Date"))
    train = base.filter(F.col("Date") < F.lit("2000-01-01").cast("date"))
    out = X.add_weather_features(base, X.fit_statistics(train, per_entity=True))
    return B.round_all(out.select("City", "Date", "Rainfall_Deficit", *ANOMALY_COLUMNS, *FLAGS))


# ---------------------------------------------------------------- master tables

FILL_VEG = ", ".join(
    f"""coalesce(last_value(v."{c}" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(v."{c}" IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS "{c}\""""
    for c in ("NDBI", "NDVI", "EVI")
)
MASTER = f"""{B.WEATHER}, {B.FIRES}, {B.BURNED}, {B.VEGETATION}, {B.GEOGRAPHY}, master AS (
  SELECT w.*, coalesce(fire_count, 0) AS fire_count, coalesce(mean_brightness, 0) AS mean_brightness, coalesce(max_frp, 0) AS max_frp, coalesce("Fire_Occurred", 0) AS "Fire_Occurred",
    coalesce("Burned_Area_hectares", 0) AS "Burned_Area_hectares", {FILL_VEG}, "Elevation", "Slope", "Trees_pct", "Urban_pct", coalesce("Pop_Total", 0) AS "Pop_Total",
    coalesce("Road_Length_m", 0) AS "Road_Length_m", coalesce("Intersections", 0) AS "Intersections", "Latitude", "Longitude"
  FROM weather w LEFT JOIN fires f ON f."City" = w."City" AND f."Date" = w."Date" LEFT JOIN burned b ON b."City" = w."City" AND b."Date" = w."Date"
  LEFT JOIN vegetation v ON v."City" = w."City" AND v."Date" = w."Date" LEFT JOIN geography g ON g."City" = w."City"
  WINDOW w AS (PARTITION BY w."City" ORDER BY w."Date"))"""


def master_daily(t):
    return build_master_daily(B.readings(t), B.fires(t), B.burned(t), B.vegetation(t), B.geography(t))


@query(
    f"""WITH {MASTER} SELECT "City", "Date", {rounded("Temperature_C_mean", "Temperature_C_min", "Temperature_C_max", "Humidity_percent_mean", "Rain_mm_sum", "Wind_Dir_deg_mean",
      "Solar_Radiation_Wm2_mean", "mean_brightness", "max_frp", "Burned_Area_hectares", "NDBI", "NDVI", "EVI", "Elevation", "Trees_pct", "Pop_Total", "Road_Length_m", "Latitude", "Longitude")},
      fire_count, CAST("Fire_Occurred" AS INTEGER) AS "Fire_Occurred", "Intersections", CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month",
      CAST(dayofyear("Date") AS INTEGER) AS "DayOfYear", CAST(isodow("Date") - 1 AS INTEGER) AS "DayOfWeek" FROM master"""
)
def master_daily_table(t):
    wanted = [
        "City", "Date", "Temperature_C_mean", "Temperature_C_min", "Temperature_C_max", "Humidity_percent_mean", "Rain_mm_sum", "Wind_Dir_deg_mean",
        "Solar_Radiation_Wm2_mean", "mean_brightness", "max_frp", "Burned_Area_hectares", "NDBI", "NDVI", "EVI", "Elevation", "Trees_pct", "Pop_Total",
        "Road_Length_m", "Latitude", "Longitude", "fire_count", "Fire_Occurred", "Intersections", "Year", "Month", "DayOfYear", "DayOfWeek",
    ]
    return B.round_all(master_daily(t).select(*wanted))


HSIDES = """hfires AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", count(*) AS fire_count, 1 AS "Fire_Occurred" FROM hreadings WHERE "Rain_mm" > 11 GROUP BY 1, 2),
    hveg AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", avg("Soil_Moisture") FILTER (day("Timestamp") % 4 = 3) AS "NDVI" FROM hreadings GROUP BY 1, 2),
    hgeo AS (SELECT "City", max("Wind_Speed_kmh") AS "Elevation" FROM hreadings GROUP BY 1)"""


def hourly_sides(t):
    rows = B.hourly_readings(t)
    fires = rows.filter("Rain_mm > 11").groupBy("City", F.to_date("Timestamp").alias("Date")).agg(
        F.count(F.lit(1)).alias("fire_count"), F.first(F.lit(1)).alias("Fire_Occurred")
    )
    # the side series is known on every fourth day
    known = F.when(F.dayofmonth("Timestamp") % 4 == 3, F.col("Soil_Moisture"))
    veg = rows.select("City", F.col("Timestamp").alias("Date"), known.alias("NDVI"))
    return fires, veg, rows.groupBy("City").agg(F.max("Wind_Speed_kmh").alias("Elevation"))


MASTER_HOURLY = f"""{B.HOURLY}, {HSIDES}, hdays AS (SELECT DISTINCT "City", CAST("Timestamp" AS DATE) AS "Date" FROM hourly),
    hfill AS (SELECT d."City", d."Date", coalesce(last_value("NDVI" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value("NDVI" IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS "NDVI" FROM hdays d LEFT JOIN hveg v USING ("City", "Date")
      WINDOW w AS (PARTITION BY d."City" ORDER BY d."Date")),
    mhourly AS (SELECT h.*, CAST("Timestamp" AS DATE) AS "Date", coalesce(fire_count, 0) AS fire_count, coalesce("Fire_Occurred", 0) AS "Fire_Occurred", "NDVI", "Elevation"
      FROM hourly h LEFT JOIN hfires f ON f."City" = h."City" AND f."Date" = CAST("Timestamp" AS DATE) LEFT JOIN hfill v ON v."City" = h."City" AND v."Date" = CAST("Timestamp" AS DATE)
      LEFT JOIN hgeo g ON g."City" = h."City")"""


@query(
    f"""WITH {MASTER_HOURLY} SELECT "City", "Timestamp", "Date", {rounded("Temperature_C", "Rain_mm", "NDVI", "Elevation")}, fire_count, CAST("Fire_Occurred" AS INTEGER) AS "Fire_Occurred",
      CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month", CAST(isodow("Date") - 1 AS INTEGER) AS "DayOfWeek", CAST(hour("Timestamp") AS INTEGER) AS "Hour" FROM mhourly"""
)
def master_hourly_table(t):
    fires, veg, geo = hourly_sides(t)
    out = build_master_hourly(B.weather_hourly(t), fires, vegetation=veg, geography=geo)
    wanted = ["City", "Timestamp", "Date", "Temperature_C", "Rain_mm", "NDVI", "Elevation", "fire_count", "Fire_Occurred", "Year", "Month", "DayOfWeek", "Hour"]
    return B.round_all(out.select(*wanted))


# --------------------------------------------------------------- feature tables

ENGINEERED_ROLLS = ", ".join(
    r6(e, n)
    for e, n in (
        ('coalesce(lag("Temperature_C_max", 1) OVER w, 0)', "Temperature_C_max_lag1"),
        ('coalesce(lag("Rain_mm_sum", 30) OVER w, 0)', "Rain_mm_sum_lag30"),
        ('coalesce(lag("FWI_proxy", 7) OVER w, 0)', "FWI_proxy_lag7"),
        ('coalesce(avg("FWI_proxy") OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)', "FWI_proxy_roll7_mean"),
        ('coalesce(stddev_samp("Soil_Moisture_mean") OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)', "Soil_Moisture_mean_roll30_std"),
    )
)
ROLL_NAMES = ["Temperature_C_max_lag1", "Rain_mm_sum_lag30", "FWI_proxy_lag7", "FWI_proxy_roll7_mean", "Soil_Moisture_mean_roll30_std"]
HISTORY_NAMES = ["days_since_last_fire", "city_month_fire_rate", "city_fire_rate"]
HOUR_EXTRAS = ["hours_temp_above_30", "temp_night_min"]


def day_extras(t):
    rows = B.readings(t)
    return rows.groupBy("City", F.to_date("Timestamp").alias("Date")).agg(*R.day_features()).select("City", "Date", *HOUR_EXTRAS)


@query(
    f"""WITH {MASTER}, {feature_ctes('master', 'master')}, ex AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", CAST(count(*) FILTER ("Temperature_C" > 30) AS INTEGER) AS hours_temp_above_30,
      min("Temperature_C") AS temp_night_min FROM readings GROUP BY 1, 2)
    SELECT "City", "Date", {rounded(*WEATHER_FLOATS, *ANOMALY_COLUMNS, zero=True)}, {quoted(*FLAGS)}, {ENGINEERED_ROLLS}, {HISTORY_SQL},
      CAST(coalesce(sum("Fire_Occurred") OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS fire_count_90d, hours_temp_above_30, round(temp_night_min, 6) AS temp_night_min,
      round("NDVI" * "Rainfall_Deficit" / 100, 6) AS "NDVI_x_drought", round("Trees_pct" * dry_days_streak / 100, 6) AS "forest_x_dry_days", round("NDVI" * "VPD_kPa", 6) AS "NDVI_x_VPD",
      {date_parts_sql('"Date"')} FROM feat LEFT JOIN ex USING ("City", "Date") WINDOW w AS (PARTITION BY "City" ORDER BY "Date")"""
)
def engineered_daily_table(t):
    out = X.engineer_daily(master_daily(t), day_extras=day_extras(t))
    dates = ["Year", "Month", "DayOfYear", "DayOfWeek", "WeekOfYear", "Month_sin", "Month_cos", "DoY_sin", "DoY_cos", "DoW_sin", "DoW_cos", "Season", "is_summer", "is_winter", "is_fire_season"]
    extra = ["fire_count_90d", "NDVI_x_drought", "forest_x_dry_days", "NDVI_x_VPD"]
    wanted = ["City", "Date", *WEATHER_FLOATS, *ANOMALY_COLUMNS, *FLAGS, *ROLL_NAMES, *HISTORY_NAMES, *HOUR_EXTRAS, *extra, *dates]
    return B.round_all(out.select(*wanted))


@query()
def engineered_daily_full(t):
    """The whole daily feature table: winsorised inputs, hour-based extras, seasonal predictions and residuals of all variables."""
    weather = B.weather_daily(t)
    residuals = G.seasonal_residuals(weather, DAILY, DAILY_WEATHER)
    return X.engineer_daily(master_daily(t), day_extras=day_extras(t), residuals=residuals, winsor=[c for c in weather.columns if c not in DAILY.key])


def hourly_windows(zero: bool = True) -> str:
    parts = []
    for v in X.HOURLY_LAGGED:
        parts += [(f'lag("{v}", {k}) OVER w', f"{v}_lag{k}h") for k in (1, 24)]
        parts += [(f'avg("{v}") OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)', f"{v}_roll6h_mean")]
        parts += [(f'stddev_samp("{v}") OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)', f"{v}_roll24h_std")]
    return ", ".join(r6(f"coalesce({e}, 0)" if zero else e, n) for e, n in parts)


HOURLY_NAMES = [f"{v}_{s}" for v in X.HOURLY_LAGGED for s in ("lag1h", "lag24h", "roll6h_mean", "roll24h_std")]


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", {hourly_windows()}, CAST(hour("Timestamp") AS INTEGER) AS "Hour", round(sin(2 * pi() * hour("Timestamp") / 24), 6) AS "Hour_sin",
      CAST(hour("Timestamp") BETWEEN 6 AND 20 AS INTEGER) AS is_daytime, CAST(month("Timestamp") BETWEEN 5 AND 9 AS INTEGER) AS is_fire_season
    FROM hourly WINDOW w AS (PARTITION BY "City" ORDER BY "Timestamp")"""
)
def engineered_hourly_table(t):
    out = X.engineer_hourly(B.weather_hourly(t))
    return B.round_all(out.select("City", "Timestamp", *HOURLY_NAMES, "Hour", "Hour_sin", "is_daytime", "is_fire_season"))


SURFACE_ROLLS = ", ".join(
    r6(e, n)
    for e, n in (
        ('lag("VPD_kPa", 2) OVER w', "VPD_kPa_lag2"),
        ('avg(dry_days_streak) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)', "dry_days_streak_roll14_mean"),
        ('stddev_samp("FWI_proxy") OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)', "FWI_proxy_roll3_std"),
    )
)
SURFACE_NAMES = ["VPD_kPa_lag2", "dry_days_streak_roll14_mean", "FWI_proxy_roll3_std"]


@query(
    f"""WITH {B.LABELLED}, {feature_ctes('panel', 'panel')} SELECT "City", "Date", CAST("Fire_Occurred" AS INTEGER) AS "Fire_Occurred", {rounded(*FLOATS, "VPD_kPa", "Rainfall_Deficit")}, {quoted(*FLAGS)},
      {SURFACE_ROLLS}, CAST("City" = 'NATION_3' AS INTEGER) AS "city_NATION_3", CAST(0 AS DOUBLE) AS "EVI" FROM feat WINDOW w AS (PARTITION BY "City" ORDER BY "Date")"""
)
def training_features(t):
    out = X.training_frame(B.labelled_daily(t), cities=["NATION_3"])
    return B.round_all(out.select("City", "Date", "Fire_Occurred", *FLOATS, "VPD_kPa", "Rainfall_Deficit", *FLAGS, *SURFACE_NAMES, "city_NATION_3", "EVI"))


# --------------------------------------------------------------------- horizons

CUT = "2001-10-05"


def split_horizon(t):
    """The newest days stand for the forecast: weather only."""
    daily = B.labelled_daily(t)
    cut = F.lit(CUT).cast("date")
    forecast = daily.filter(F.col("Date") >= cut).select("City", "Date", *X.DAILY_WEATHER)
    return daily.filter(F.col("Date") < cut), forecast


HORIZON = f"""{B.LABELLED}, hist AS (SELECT * FROM panel WHERE "Date" < DATE '{CUT}'), fut AS (SELECT * FROM panel WHERE "Date" >= DATE '{CUT}'),
    begins AS (SELECT "City", min("Date") AS b0 FROM fut GROUP BY 1)"""


@query(
    f"""WITH {HORIZON}, src AS (SELECT hist.* FROM hist JOIN begins USING ("City") WHERE "Date" >= b0 - INTERVAL 45 DAY UNION ALL SELECT * FROM fut), {feature_ctes('src', 'hist')},
    o AS (SELECT "City", "Date", {rounded(*FLOATS, "Rainfall_Deficit")}, {quoted(*FLAGS)}, {SURFACE_ROLLS} FROM feat WINDOW w AS (PARTITION BY "City" ORDER BY "Date"))
    SELECT * FROM o WHERE "Date" >= DATE '{CUT}'"""
)
def forecast_features(t):
    history, forecast = split_horizon(t)
    out = X.forecast_frame(history, forecast)
    return B.round_all(out.select("City", "Date", *FLOATS, "Rainfall_Deficit", *FLAGS, *SURFACE_NAMES))


@query(
    f"""WITH {HORIZON}, sp AS (SELECT avg(greatest("Temperature_C_max" - {T}, 0)) AS up, avg(greatest({T} - "Temperature_C_min", 0)) AS dn FROM hist),
    wd AS (SELECT "City", month("Date") AS mo, quantile_cont("Wind_Dir_deg_mean", 0.5) AS wdir FROM hist GROUP BY 1, 2),
    lastk AS (SELECT "City", arg_max("Soil_Temp_C_mean", "Date") AS carried FROM hist GROUP BY 1),
    src AS (SELECT hist.* FROM hist JOIN begins USING ("City") WHERE "Date" >= b0 - INTERVAL 90 DAY
      UNION ALL SELECT fut.* REPLACE ({T} + up AS "Temperature_C_max", {T} - dn AS "Temperature_C_min", wdir AS "Wind_Dir_deg_mean", 0 AS "Fire_Occurred") FROM fut CROSS JOIN sp
        LEFT JOIN wd ON wd."City" = fut."City" AND mo = month(fut."Date")), {feature_ctes('src', 'hist')},
    nn AS (SELECT f.* EXCLUDE (rn), row_number() OVER (PARTITION BY "City" ORDER BY "Date") AS rn, "Elevation" FROM feat f LEFT JOIN geo USING ("City")),
    o AS (SELECT "City", "Date", {rounded("FWI_proxy", "Rainfall_Deficit", "Temperature_C_max", "Temperature_C_min", "Wind_Dir_deg_mean", *ANOMALY_COLUMNS, zero=True)}, {quoted(*FLAGS)},
      {ENGINEERED_ROLLS}, {HISTORY_SQL}, "Elevation" FROM nn WINDOW w AS (PARTITION BY "City" ORDER BY "Date"))
    SELECT * FROM o WHERE "Date" >= DATE '{CUT}'"""
    .replace("nn AS (", """geo AS (SELECT n_name AS "City", CAST((n_nationkey * 137) % 1800 AS DOUBLE) AS "Elevation" FROM nation), nn AS (""", 1)
)
def daily_horizon_features(t):
    history, forecast = split_horizon(t)
    geography = B.geography(t).select("City", "Elevation")
    out = X.daily_horizon(history, forecast, geography)
    wanted = ["FWI_proxy", "Rainfall_Deficit", "Temperature_C_max", "Temperature_C_min", "Wind_Dir_deg_mean", *ANOMALY_COLUMNS, *FLAGS, *ROLL_NAMES, *HISTORY_NAMES, "Elevation"]
    return B.round_all(out.select("City", "Date", *wanted))


HCUT = "2024-01-24 00:00:00"


def split_hourly(t):
    hourly = B.weather_hourly(t)
    cut = F.lit(HCUT).cast("timestamp_ntz")
    return hourly.filter(F.col("Timestamp") < cut), hourly.filter(F.col("Timestamp") >= cut)


@query(
    f"""WITH {B.HOURLY}, o AS (SELECT "City", "Timestamp", {hourly_windows()}, CAST(hour("Timestamp") AS INTEGER) AS "Hour" FROM hourly WHERE "Timestamp" >= TIMESTAMP '{HCUT}' - INTERVAL 336 HOUR
      WINDOW w AS (PARTITION BY "City" ORDER BY "Timestamp")) SELECT * FROM o WHERE "Timestamp" >= TIMESTAMP '{HCUT}'"""
)
def hourly_horizon_features(t):
    history, forecast = split_hourly(t)
    out = X.hourly_horizon(history, forecast)
    return B.round_all(out.select("City", "Timestamp", *HOURLY_NAMES, "Hour"))


@query(
    f"""WITH {B.HOURLY}, fl AS (SELECT *, lag("Temperature_C", 24) OVER (PARTITION BY "City" ORDER BY "Timestamp") AS l24 FROM hourly),
    med AS (SELECT "City", quantile_cont(coalesce(l24, 0), 0.5) AS m24, quantile_cont("Rain_mm", 0.5) AS mr, quantile_cont("Pressure_hPa", 0.5) AS mp FROM fl WHERE "Timestamp" < TIMESTAMP '{HCUT}' GROUP BY 1),
    o AS (SELECT *, lag("Temperature_C", 24) OVER (PARTITION BY "City" ORDER BY "Timestamp") AS f24 FROM hourly WHERE "Timestamp" >= TIMESTAMP '{HCUT}' - INTERVAL 336 HOUR)
    SELECT "City", "Timestamp", round(coalesce(f24, m24, 0), 6) AS "Temperature_C_lag24h", round(coalesce(nullif("Rain_mm", 0), mr, 0), 6) AS "Rain_mm", round(coalesce(mp, 0), 6) AS "Pressure_hPa",
      CAST(hour("Timestamp") AS DOUBLE) AS "Hour", CAST(0 AS DOUBLE) AS "EVI" FROM o LEFT JOIN med USING ("City") WHERE "Timestamp" >= TIMESTAMP '{HCUT}'"""
)
def hourly_horizon_repaired(t):
    history, forecast = split_hourly(t)
    wanted = ["Temperature_C_lag24h", "Rain_mm", "Pressure_hPa", "Hour", "EVI"]
    out = X.hourly_horizon(history, forecast.drop("Pressure_hPa"), wanted=wanted)
    return B.round_all(out)


@query(
    f"""WITH {B.HOURLY_READINGS}, daily AS ({B._daily_sql('hreadings')}), {feature_ctes('daily', 'daily', per_place=True)}
    SELECT "City", "Date", {rounded(*WEATHER_FLOATS)}, {quoted(*FLAGS)}, round("Rain_mm_sum_anomaly", 6) AS "Rain_mm_sum_anomaly", round(lag("Temperature_C_max", 2) OVER w, 6) AS "Temperature_C_max_lag2",
      round(lag("FWI_proxy", 14) OVER w, 6) AS "FWI_proxy_lag14", round({T}, 6) AS "prophet_Temperature_C_mean_pred", CAST(0 AS DOUBLE) AS "prophet_Temperature_C_mean_resid",
      CAST(365 AS DOUBLE) AS days_since_last_fire, CAST(0.02 AS DOUBLE) AS city_fire_rate FROM feat WINDOW w AS (PARTITION BY "City" ORDER BY "Date")"""
)
def refresh_feature_table(t):
    out = X.refresh_features(R.refresh_daily(B.hourly_readings(t)))
    wanted = [*WEATHER_FLOATS, *FLAGS, "Rain_mm_sum_anomaly", "Temperature_C_max_lag2", "FWI_proxy_lag14", "prophet_Temperature_C_mean_pred", "prophet_Temperature_C_mean_resid"]
    return B.round_all(out.select("City", "Date", *wanted, "days_since_last_fire", "city_fire_rate"))


# ------------------------------------------------------------- incremental save

STORED = """old AS (SELECT "City", "Date", fire_count, 'stored' AS origin FROM fires WHERE "Date" <= DATE '2000-06-30'),
    new AS (SELECT "City", "Date", fire_count + 100 AS fire_count, 'new' AS origin FROM fires WHERE "Date" >= DATE '2000-06-01')"""


def stored_and_new(t):
    base = B.fires(t).select("City", "Date", "fire_count")
    day = lambda s: F.lit(s).cast("date")
    old = base.filter(F.col("Date") <= day("2000-06-30")).withColumn("origin", F.lit("stored"))
    new = base.filter(F.col("Date") >= day("2000-06-01")).select("City", "Date", (F.col("fire_count") + 100).alias("fire_count"), F.lit("new").alias("origin"))
    return old, new


@query(f"""WITH {B.FIRES}, {STORED} SELECT * FROM old UNION ALL SELECT * FROM new WHERE "Date" > (SELECT max("Date") FROM old)""")
def incremental_append(t):
    return N.append_after(*stored_and_new(t), "Date", DAILY.key)


@query(f"""WITH {B.FIRES}, {STORED} SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new."City" = old."City" AND new."Date" = old."Date")""")
def incremental_upsert(t):
    return N.upsert(*stored_and_new(t), DAILY.key)

