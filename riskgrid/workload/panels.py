"""Roll-ups and window features over daily and hourly panels."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from riskgrid.functions.calendar import hour_index
from riskgrid.functions.risk import risk_tier
from riskgrid.operators import panel as P
from riskgrid.operators import resample as R
from riskgrid.spec import DAILY, HOURLY
from riskgrid.workload import binding as B
from riskgrid.workload.registry import query

W = 'WINDOW w AS (PARTITION BY "City" ORDER BY "Date")'
WH = 'WINDOW w AS (PARTITION BY "City" ORDER BY "Timestamp")'


def r6(expr: str, name: str) -> str:
    return f'round({expr}, 6) AS "{name}"'


# ------------------------------------------------------------------- roll-ups


@query(
    f"""WITH {B.HOURLY_READINGS}, d AS ({B._daily_sql('hreadings')})
    SELECT "City", "Date", {', '.join(r6(f'"{c}"', c) for c in (
        "Temperature_C_mean", "Temperature_C_min", "Temperature_C_max", "Humidity_percent_mean", "Humidity_percent_min",
        "Humidity_percent_max", "Rain_mm_sum", "Wind_Speed_kmh_mean", "Wind_Speed_kmh_min", "Wind_Speed_kmh_max", "Wind_Dir_deg_mean",
        "Pressure_hPa_mean", "Pressure_hPa_min", "Pressure_hPa_max", "Solar_Radiation_Wm2_mean", "Soil_Temp_C_mean", "Soil_Temp_C_min",
        "Soil_Temp_C_max", "Soil_Moisture_mean", "Soil_Moisture_min", "Soil_Moisture_max"))} FROM d"""
)
def resample_daily_by_name(t):
    return B.round_all(R.roll_up_daily(B.hourly_readings(t)))


@query(
    f"""WITH {B.HOURLY_READINGS}
    SELECT "City", CAST("Timestamp" AS DATE) AS "Date",
      {', '.join(r6(f'{f}("{v}")', f'{v}_{n}') for v in ("Temperature_C", "Humidity_percent", "Wind_Speed_kmh") for f, n in (("avg", "mean"), ("max", "max"), ("min", "min")))},
      {', '.join(r6(f'avg("{v}")', f'{v}_mean') for v in ("Wind_Dir_deg", "Pressure_hPa", "Solar_Radiation_Wm2", "Soil_Temp_C", "Soil_Moisture"))},
      {', '.join(r6(f'max("{v}")', f'{v}_max') for v in ("Soil_Temp_C", "Soil_Moisture"))},
      {r6('coalesce(sum("Rain_mm"), 0)', 'Rain_mm_sum')},
      CAST(count(*) FILTER ("Temperature_C" > 30) AS INTEGER) AS hours_temp_above_30,
      CAST(count(*) FILTER ("Humidity_percent" < 30) AS INTEGER) AS hours_humidity_below_30,
      CAST(count(*) FILTER ("Wind_Speed_kmh" > 20) AS INTEGER) AS hours_wind_above_20,
      {r6('max("Humidity_percent") - min("Humidity_percent")', 'Humidity_percent_diurnal_range')},
      {r6('max("Temperature_C") - min("Temperature_C")', 'temp_range')},
      {r6('coalesce(min("Temperature_C") FILTER (hour("Timestamp") <= 5), min("Temperature_C"))', 'temp_night_min')},
      {r6('coalesce(max("Temperature_C") FILTER (hour("Timestamp") BETWEEN 12 AND 17), min("Temperature_C"))', 'temp_afternoon_max')},
      CAST(CASE WHEN max("Solar_Radiation_Wm2") > 0
        THEN 24 - max("Solar_Radiation_Wm2" * 100 + 24 - hour("Timestamp")) % 100 ELSE 12 END AS INTEGER) AS solar_peak_hour
    FROM hreadings GROUP BY 1, 2"""
)
def resample_daily_refresh(t):
    return B.round_all(R.refresh_daily(B.hourly_readings(t)))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", {', '.join(r6(f'"{c}"', c) for c in (
        "Temperature_C", "Humidity_percent", "Rain_mm", "Wind_Speed_kmh", "Wind_Dir_deg", "Pressure_hPa", "Solar_Radiation_Wm2", "Soil_Temp_C", "Soil_Moisture"))}
    FROM hourly"""
)
def resample_hourly(t):
    return B.round_all(B.weather_hourly(t))


@query(
    f"""WITH {B.FIRES} SELECT "City", "Date", fire_count, round(mean_brightness, 6) AS mean_brightness, round(max_frp, 6) AS max_frp,
      CAST("Fire_Occurred" AS INTEGER) AS "Fire_Occurred" FROM fires"""
)
def events_per_place_day(t):
    return B.round_all(B.fires(t))


@query(
    f"""WITH {B.BURNED}, {B.VEGETATION}
    SELECT "City", "Date", round("Burned_Area_hectares", 6) AS "Burned_Area_hectares", round("NDVI", 6) AS "NDVI",
      round("NDBI", 6) AS "NDBI", round("EVI", 6) AS "EVI" FROM burned FULL JOIN vegetation USING ("City", "Date")"""
)
def side_series_per_day(t):
    return B.round_all(B.burned(t).join(B.vegetation(t), ["City", "Date"], "full"))


@query(
    f"""WITH {B.HOURLY}, b AS (SELECT min("Timestamp") lo, max("Timestamp") hi FROM hourly),
    axis AS (SELECT e."City", g.ts AS "Timestamp" FROM (SELECT DISTINCT "City" FROM hourly) e,
      (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b) g)
    SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C", ("Temperature_C" IS NULL) AS gap
    FROM axis LEFT JOIN hourly USING ("City", "Timestamp")"""
)
def spine_hourly(t):
    hourly = B.weather_hourly(t).select("City", "Timestamp", "Temperature_C")
    bounds = hourly.agg(F.min("Timestamp").alias("lo"), F.max("Timestamp").alias("hi"))
    axis = R.date_spine(hourly, HOURLY, bounds, "1 hour")
    return B.round_all(axis.join(hourly, HOURLY.key, "left").withColumn("gap", F.col("Temperature_C").isNull()))


@query(
    f"""WITH {B.WEATHER}, e AS (SELECT "City", min("Date") lo, max("Date") hi FROM weather GROUP BY 1),
    axis AS (SELECT "City", CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS "Date" FROM e)
    SELECT "City", "Date", round("Rain_mm_sum", 6) AS "Rain_mm_sum", round("Temperature_C_mean", 6) AS "Temperature_C_mean"
    FROM axis LEFT JOIN weather USING ("City", "Date")"""
)
def densify_daily(t):
    daily = B.weather_daily(t).select("City", "Date", "Rain_mm_sum", "Temperature_C_mean")
    return B.round_all(R.densify(daily, DAILY))


# -------------------------------------------------------------- lags and frames

LAGGED = ("Temperature_C_mean", "Rain_mm_sum", "Humidity_percent_min")


def _sql_lags(variables, steps):
    return ", ".join(r6(f'lag("{v}", {k}) OVER w', f"{v}_lag{k}") for v in variables for k in steps)


def _sql_rolls(variables, widths, full=False):
    out = []
    for v in variables:
        for n in widths:
            f = f'OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'
            for fn, name in (("avg", "mean"), ("stddev_samp", "std")):
                e = f'{fn}("{v}") {f}'
                if full:
                    e = f'CASE WHEN count("{v}") {f} = {n} THEN {e} END'
                out.append(r6(e, f"{v}_roll{n}_{name}"))
    return ", ".join(out)


@query(f"""WITH {B.WEATHER} SELECT "City", "Date", {_sql_lags(LAGGED, (1, 2, 3, 5, 7, 14, 30))} FROM weather {W}""")
def window_lags_daily(t):
    base = B.weather_daily(t).select("City", "Date", *LAGGED)
    return B.round_all(P.add_lags(base, DAILY, LAGGED, (1, 2, 3, 5, 7, 14, 30)).drop(*LAGGED))


@query(f"""WITH {B.WEATHER} SELECT "City", "Date", {_sql_rolls(LAGGED, (3, 7, 14, 30))} FROM weather {W}""")
def window_rolls_daily(t):
    base = B.weather_daily(t).select("City", "Date", *LAGGED)
    return B.round_all(P.add_rolls(base, DAILY, LAGGED, (3, 7, 14, 30)).drop(*LAGGED))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", {_sql_lags(("Temperature_C", "Wind_Speed_kmh"), (1, 3, 6, 12, 24, 48, 168))},
      {_sql_rolls(("Temperature_C", "Wind_Speed_kmh"), (6, 12, 24))} FROM hourly {WH}"""
)
def window_features_hourly(t):
    use = ("Temperature_C", "Wind_Speed_kmh")
    base = B.weather_hourly(t).select("City", "Timestamp", *use)
    out = P.row_features(base, HOURLY, [P.lags(use, (1, 3, 6, 12, 24, 48, 168)), P.rolls(use, (6, 12, 24))], 168, block_rows=256)
    return B.round_all(out.drop(*use))


@query(f"""WITH {B.WEATHER} SELECT "City", "Date", {_sql_rolls(("Temperature_C_mean",), (7, 14, 30), full=True)} FROM weather {W}""")
def window_rolls_full_only(t):
    base = B.weather_daily(t).select("City", "Date", "Temperature_C_mean")
    return B.round_all(P.add_rolls(base, DAILY, ["Temperature_C_mean"], (7, 14, 30), full_only=True).drop("Temperature_C_mean"))


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date",
      {r6('avg("Temperature_C_mean") OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)', 'mean14')},
      {r6('sum("Rain_mm_sum") OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 'sum30')},
      {r6('sum("Rain_mm_sum") OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 'Rain_roll30_sum')} FROM weather {W}"""
)
def window_trailing_sums(t):
    base = B.weather_daily(t).select("City", "Date", "Temperature_C_mean", "Rain_mm_sum")
    out = P.row_features(
        base,
        DAILY,
        [
            P.trailing_mean("Temperature_C_mean", 14, "mean14", include_current=True),
            P.trailing_sum("Rain_mm_sum", 30, "sum30", include_current=True),
            P.trailing_sum("Rain_mm_sum", 30, "Rain_roll30_sum"),
        ],
        30,
    )
    return B.round_all(out.drop("Temperature_C_mean", "Rain_mm_sum"))


STREAK = """isl AS (SELECT *, CAST("Rain_mm_sum" < 0.1 AS INTEGER) AS dry,
    sum(CAST("Rain_mm_sum" >= 0.1 AS INTEGER)) OVER (PARTITION BY "City" ORDER BY "Date") AS island FROM weather),
  streak AS (SELECT *, CAST(sum(dry) OVER (PARTITION BY "City", island ORDER BY "Date") AS INTEGER) AS dry_days_streak FROM isl)"""


@query(f"""WITH {B.WEATHER}, {STREAK} SELECT "City", "Date", dry_days_streak FROM streak""")
def window_dry_streak(t):
    return P.dry_streak(B.weather_daily(t).select("City", "Date", "Rain_mm_sum"), DAILY).drop("Rain_mm_sum")


@query(
    f"""WITH {B.HOURLY}, isl AS (SELECT *, CAST("Rain_mm" < 0.1 AS INTEGER) AS dry,
      sum(CAST("Rain_mm" >= 0.1 AS INTEGER)) OVER (PARTITION BY "City" ORDER BY "Timestamp") AS island FROM hourly)
    SELECT "City", "Timestamp", CAST(sum(dry) OVER (PARTITION BY "City", island ORDER BY "Timestamp") AS INTEGER) AS dry_hours FROM isl"""
)
def window_dry_streak_hourly(t):
    base = B.weather_hourly(t).select("City", "Timestamp", "Rain_mm")
    return P.dry_streak(base, HOURLY, "Rain_mm", name="dry_hours").drop("Rain_mm")


HISTORY_SQL = """
      CAST(least(coalesce(rn - max(CASE WHEN "Fire_Occurred" = 1 THEN rn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 365), 365) AS INTEGER)
        AS days_since_last_fire,
      round(coalesce(avg("Fire_Occurred") OVER (PARTITION BY "City", month("Date") ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)
        AS city_month_fire_rate,
      round(coalesce(avg("Fire_Occurred") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS city_fire_rate"""


@query(
    f"""WITH {B.LABELLED}, n AS (SELECT *, row_number() OVER (PARTITION BY "City" ORDER BY "Date") AS rn FROM panel)
    SELECT "City", "Date", {', '.join(f'CAST(sum("Fire_Occurred") OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS DOUBLE) AS fire_count_{k}d' for k in (7, 14, 30, 90))},
      {HISTORY_SQL} FROM n {W}"""
)
def window_event_history(t):
    base = B.labelled_daily(t).select("City", "Date", "Fire_Occurred", F.month("Date").alias("Month"))
    return B.round_all(P.event_history(base, DAILY).drop("Fire_Occurred", "Month"))


@query(
    f"""WITH {B.WEATHER}, {B.VEGETATION}, j AS (SELECT w."City", w."Date", "NDVI", "EVI" FROM weather w LEFT JOIN vegetation v USING ("City", "Date"))
    SELECT "City", "Date",
      {', '.join(f'''round(coalesce(last_value("{c}" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value("{c}" IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS "{c}"''' for c in ("NDVI", "EVI"))}
    FROM j {W}"""
)
def window_fill_gaps(t):
    veg = B.vegetation(t).select("City", "Date", "NDVI", "EVI")
    joined = B.weather_daily(t).select("City", "Date").join(veg, ["City", "Date"], "left")
    return B.round_all(P.fill_gaps(joined, DAILY, ["NDVI", "EVI"]))


@query(
    f"""WITH {B.HOURLY}, h AS (SELECT "City", "Timestamp", CASE WHEN "Rain_mm" > 8 THEN "Rain_mm" END AS peak_rain FROM hourly)
    SELECT "City", "Timestamp", round(coalesce(last_value(peak_rain IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(peak_rain IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS peak_rain FROM h {WH}"""
)
def window_fill_gaps_hourly(t):
    base = B.weather_hourly(t).select("City", "Timestamp", F.when(F.col("Rain_mm") > 8, F.col("Rain_mm")).alias("peak_rain"))
    return B.round_all(P.fill_gaps(base, HOURLY, ["peak_rain"]))


@query(
    f"""WITH {B.WEATHER}, m AS (SELECT "City", "Date", "Temperature_C_mean" AS v, avg("Temperature_C_mean") OVER (PARTITION BY "City", month("Date")) AS mean FROM weather)
    SELECT "City", "Date", round(mean, 6) AS month_mean, round(v - mean, 6) AS anomaly FROM m"""
)
def window_month_mean(t):
    base = B.weather_daily(t).select("City", "Date", "Temperature_C_mean")
    mean = F.avg("Temperature_C_mean").over(Window.partitionBy("City", F.month("Date")))
    out = base.select("City", "Date", mean.alias("month_mean"), (F.col("Temperature_C_mean") - mean).alias("anomaly"))
    return B.round_all(out)


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", round("Temperature_C_mean", 6) AS "Temperature_C_mean", round("Rain_mm_sum", 6) AS "Rain_mm_sum"
    FROM weather QUALIFY row_number() OVER (PARTITION BY "City" ORDER BY "Date" DESC) = 1"""
)
def latest_row_per_place(t):
    return B.round_all(P.latest_per_entity(B.weather_daily(t).select("City", "Date", "Temperature_C_mean", "Rain_mm_sum"), DAILY))


@query(
    """SELECT user_id, CAST(ts AS DATE) AS "Date", event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""
)
def keep_last_per_key(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("Date"), "ts", "event_id", "value")
    return P.keep_one(rows, ["user_id", "Date"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT user_id, CAST(ts AS DATE) AS "Date", event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1"""
)
def keep_first_per_key(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("Date"), "ts", "event_id", "value")
    return P.keep_one(rows, ["user_id", "Date"], ["ts", "event_id"], last=False).drop("ts")


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C" FROM hourly
    QUALIFY (row_number() OVER (PARTITION BY "City" ORDER BY "Timestamp") - 1) % 3 = 0"""
)
def every_third_row(t):
    return B.round_all(P.every_nth(B.weather_hourly(t).select("City", "Timestamp", "Temperature_C"), HOURLY, 3))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C" FROM hourly
    QUALIFY row_number() OVER (PARTITION BY "City" ORDER BY "Timestamp") = 1"""
)
def first_row_per_station(t):
    return B.round_all(P.first_per_entity(B.weather_hourly(t).select("City", "Timestamp", "Temperature_C"), HOURLY))


@query(
    f"""WITH {B.WEATHER}, b AS (SELECT "City", "Date", "Temperature_C_mean" AS v, row_number() OVER w AS rn,
      CASE WHEN count(*) OVER f = 365 THEN avg("Temperature_C_mean") OVER f END AS trend FROM weather
      WINDOW w AS (PARTITION BY "City" ORDER BY "Date"), f AS (PARTITION BY "City" ORDER BY "Date" ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
    s AS (SELECT "City", (rn - 1) % 365 AS phase, avg(v - trend) AS raw FROM b GROUP BY 1, 2),
    c AS (SELECT "City", phase, raw - avg(raw) OVER (PARTITION BY "City") AS seasonal FROM s)
    SELECT b."City", "Date", round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(v - trend - seasonal, 6) AS resid
    FROM b LEFT JOIN c ON c."City" = b."City" AND c.phase = (rn - 1) % 365"""
)
def seasonal_decomposition(t):
    base = B.weather_daily(t).select("City", "Date", "Temperature_C_mean")
    return B.round_all(P.seasonal_parts(base, DAILY, "Temperature_C_mean").drop("Temperature_C_mean"))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", CAST(date_diff('hour', TIMESTAMP '1970-01-01', "Timestamp") AS BIGINT) AS hour_no FROM hourly"""
)
def hour_numbers(t):
    return B.weather_hourly(t).select("City", "Timestamp", hour_index("Timestamp").alias("hour_no"))


# ------------------------------------------------------------- end-to-end slice


@query(
    f"""WITH {B.HOURLY_READINGS}, weather AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", avg("Temperature_C") AS temp,
      sum("Rain_mm") AS "Rain_mm_sum", CAST(count(*) FILTER ("Wind_Speed_kmh" > 20) AS INTEGER) AS hours_wind_above_20,
      least(avg("Wind_Speed_kmh"), 32) / 64 AS probability FROM hreadings GROUP BY 1, 2), {STREAK}
    SELECT "City", "Date", round(probability, 6) AS probability, {B.tier_sql('probability')} AS risk_level, dry_days_streak,
      hours_wind_above_20, round(lag(temp, 1) OVER w, 6) AS temp_lag1, round(lag(temp, 7) OVER w, 6) AS temp_lag7,
      round(avg(temp) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS temp_roll3_mean,
      round(stddev_samp(temp) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS temp_roll7_std
    FROM streak {W} ORDER BY probability DESC, "City", "Date" LIMIT 10"""
)
def daily_risk_top10(t):
    daily = (
        B.hourly_readings(t)
        .groupBy("City", F.to_date("Timestamp").alias("Date"))
        .agg(
            F.avg("Temperature_C").alias("temp"),
            F.sum("Rain_mm").alias("Rain_mm_sum"),
            R.hours_where("Wind_Speed_kmh", "hours_wind_above_20", above=20),
            (F.least(F.avg("Wind_Speed_kmh"), F.lit(32.0)) / 64).alias("probability"),
        )
    )
    out = P.row_features(P.dry_streak(daily, DAILY), DAILY, [P.lags(["temp"], (1, 7)), P.rolls(["temp"], (3, 7))], 7)
    top = out.withColumn("risk_level", risk_tier("probability")).orderBy(F.desc("probability"), "City", "Date").limit(10)
    return B.round_all(top.drop("temp", "Rain_mm_sum", "temp_roll3_std", "temp_roll7_mean"))
