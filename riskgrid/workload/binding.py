"""Domain roles bound to the driver tables, as Spark frames and as SQL for the oracle.

Numbers are chosen to be exact in binary (quarters, halves, whole numbers), so
sums do not depend on the order of evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgrid.functions.calendar import floor_hour
from riskgrid.functions.risk import risk_tier
from riskgrid.operators.resample import events_per_day, roll_up_daily, roll_up_hourly, side_series_daily
from riskgrid.operators.spatial import match_points

PLACES = 25


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def place(key: str):
    return F.concat(F.lit("NATION_"), F.pmod(F.col(key), F.lit(PLACES)).cast("string"))


# ------------------------------------------------------ weather readings by day


def readings(t: Tables, city: Column | None = None, time: Column | None = None) -> DataFrame:
    """One weather reading per line item: place from the supplier key, day from the ship date."""
    percent = lambda c: F.round(F.col(c) * 100)
    return t.lineitem.select(
        (place("l_suppkey") if city is None else city).alias("City"),
        (F.col("l_shipdate") if time is None else time).alias("Timestamp"),
        (F.col("l_quantity") * 0.75 - 2.5).alias("Temperature_C"),
        (percent("l_discount") * 7 + 20).alias("Humidity_percent"),
        F.when(F.col("l_returnflag") == "A", F.col("l_linenumber") * 1.5).otherwise(F.lit(0.0)).alias("Rain_mm"),
        (percent("l_tax") * 4).alias("Wind_Speed_kmh"),
        (F.col("l_partkey") % 360).cast("double").alias("Wind_Dir_deg"),
        (F.col("l_partkey") % 61 + 980).cast("double").alias("Pressure_hPa"),
        (F.col("l_orderkey") % 800).cast("double").alias("Solar_Radiation_Wm2"),
        (F.col("l_quantity") * 0.5).alias("Soil_Temp_C"),
        (percent("l_discount") / 32).alias("Soil_Moisture"),
    )


READINGS = """readings AS (
  SELECT 'NATION_' || CAST(l_suppkey % 25 AS VARCHAR) AS "City", l_shipdate AS "Timestamp",
    l_quantity * 0.75 - 2.5 AS "Temperature_C", round(l_discount * 100) * 7 + 20 AS "Humidity_percent",
    CASE WHEN l_returnflag = 'A' THEN l_linenumber * CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "Rain_mm",
    round(l_tax * 100) * 4 AS "Wind_Speed_kmh", CAST(l_partkey % 360 AS DOUBLE) AS "Wind_Dir_deg",
    CAST(l_partkey % 61 + 980 AS DOUBLE) AS "Pressure_hPa", CAST(l_orderkey % 800 AS DOUBLE) AS "Solar_Radiation_Wm2",
    l_quantity * 0.5 AS "Soil_Temp_C", round(l_discount * 100) / 32 AS "Soil_Moisture"
  FROM lineitem)"""

_SQL_RULES = {"Rain_mm": ["sum"], "Wind_Dir_deg": ["avg"], "Solar_Radiation_Wm2": ["avg"]}


def _daily_sql(source: str) -> str:
    out = []
    for v in (
        "Temperature_C", "Humidity_percent", "Rain_mm", "Wind_Speed_kmh", "Wind_Dir_deg", "Pressure_hPa",
        "Solar_Radiation_Wm2", "Soil_Temp_C", "Soil_Moisture",
    ):
        for f in _SQL_RULES.get(v, ["avg", "min", "max"]):
            out.append(f'{f}("{v}") AS "{v}_{"mean" if f == "avg" else f}"')
    return (
        f'SELECT "City", CAST("Timestamp" AS DATE) AS "Date", {", ".join(out)} FROM {source} GROUP BY 1, 2'
    )


def weather_daily(t: Tables) -> DataFrame:
    return roll_up_daily(readings(t))


WEATHER = f"{READINGS}, weather AS ({_daily_sql('readings')})"


# ----------------------------------------------------- weather readings by hour


def hourly_readings(t: Tables) -> DataFrame:
    """Readings inside the day from the event stream; the station is the event type."""
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    day = F.hour("ts").between(6, 18)
    return t.events.select(
        F.col("event_type").alias("City"),
        F.col("ts").alias("Timestamp"),
        (F.floor(F.col("value") * 4) / 4 - 5).alias("Temperature_C"),
        (k % 81 + 20).cast("double").alias("Humidity_percent"),
        F.when(k % 5 == 0, k / 8).otherwise(F.lit(0.0)).alias("Rain_mm"),
        (F.col("user_id") % 40).cast("double").alias("Wind_Speed_kmh"),
        (F.col("event_id") % 360).cast("double").alias("Wind_Dir_deg"),
        (F.col("event_id") % 61 + 980).cast("double").alias("Pressure_hPa"),
        F.when(day, (F.col("user_id") * 7) % 800).otherwise(F.lit(0)).cast("double").alias("Solar_Radiation_Wm2"),
        (k % 30).cast("double").alias("Soil_Temp_C"),
        (k % 16 / 64).alias("Soil_Moisture"),
    )


HOURLY_READINGS = """hreadings AS (
  SELECT event_type AS "City", ts AS "Timestamp", floor(value * 4) / 4 - 5 AS "Temperature_C",
    CAST(k % 81 + 20 AS DOUBLE) AS "Humidity_percent",
    CASE WHEN k % 5 = 0 THEN CAST(k AS DOUBLE) / 8 ELSE CAST(0 AS DOUBLE) END AS "Rain_mm",
    CAST(user_id % 40 AS DOUBLE) AS "Wind_Speed_kmh", CAST(event_id % 360 AS DOUBLE) AS "Wind_Dir_deg",
    CAST(event_id % 61 + 980 AS DOUBLE) AS "Pressure_hPa",
    CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN CAST((user_id * 7) % 800 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "Solar_Radiation_Wm2",
    CAST(k % 30 AS DOUBLE) AS "Soil_Temp_C", CAST(k % 16 AS DOUBLE) / 64 AS "Soil_Moisture"
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def weather_hourly(t: Tables) -> DataFrame:
    return roll_up_hourly(hourly_readings(t))


HOURLY = f"""{HOURLY_READINGS}, hourly AS (
  SELECT "City", date_trunc('hour', "Timestamp") AS "Timestamp",
    avg("Temperature_C") AS "Temperature_C", avg("Humidity_percent") AS "Humidity_percent", sum("Rain_mm") AS "Rain_mm",
    avg("Wind_Speed_kmh") AS "Wind_Speed_kmh", avg("Wind_Dir_deg") AS "Wind_Dir_deg", avg("Pressure_hPa") AS "Pressure_hPa",
    avg("Solar_Radiation_Wm2") AS "Solar_Radiation_Wm2", avg("Soil_Temp_C") AS "Soil_Temp_C", avg("Soil_Moisture") AS "Soil_Moisture"
  FROM hreadings GROUP BY 1, 2)"""


def stations_hourly(t: Tables) -> DataFrame:
    """Hours of years at four stations, from the line items: the hour from the part key."""
    city = F.concat(F.lit("STATION_"), F.pmod("l_suppkey", F.lit(4)).cast("string"))
    return roll_up_hourly(readings(t, city, F.col("l_shipdate") + F.make_dt_interval(hours=F.pmod("l_partkey", F.lit(24)).cast("int"))))


_SREADINGS = READINGS.replace("readings AS", "sreadings AS").replace("'NATION_' || CAST(l_suppkey % 25 AS VARCHAR)", "'STATION_' || CAST(l_suppkey % 4 AS VARCHAR)").replace('l_shipdate AS "Timestamp"', 'l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS "Timestamp"')
STATIONS_HOURLY = f"""{_SREADINGS}, stations AS (
  SELECT "City", date_trunc('hour', "Timestamp") AS "Timestamp",
    avg("Temperature_C") AS "Temperature_C", avg("Humidity_percent") AS "Humidity_percent", sum("Rain_mm") AS "Rain_mm",
    avg("Wind_Speed_kmh") AS "Wind_Speed_kmh", avg("Wind_Dir_deg") AS "Wind_Dir_deg", avg("Pressure_hPa") AS "Pressure_hPa",
    avg("Solar_Radiation_Wm2") AS "Solar_Radiation_Wm2", avg("Soil_Temp_C") AS "Soil_Temp_C", avg("Soil_Moisture") AS "Soil_Moisture"
  FROM sreadings GROUP BY 1, 2)"""


# -------------------------------------------------------- places and detections


def places(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select(
        F.col("n_name").alias("City"),
        (F.lit(38.0) + (k * 37) % 128 / 32).alias("Latitude"),
        (F.lit(44.0) + (k * 53) % 192 / 32).alias("Longitude"),
    )


PLACE_TABLE = """places AS (
  SELECT n_name AS "City", 38.0::DOUBLE + CAST((n_nationkey * 37) % 128 AS DOUBLE) / 32 AS "Latitude",
    44.0::DOUBLE + CAST((n_nationkey * 53) % 192 AS DOUBLE) / 32 AS "Longitude"
  FROM nation)"""


def detections(t: Tables) -> DataFrame:
    """Point events from orders."""
    return t.orders.select(
        F.col("o_orderkey"),
        F.col("o_orderdate").alias("acq_date"),
        (F.lit(38.0) + (F.col("o_custkey") * 37) % 512 / 128).alias("latitude"),
        (F.lit(44.0) + (F.col("o_custkey") * 53) % 768 / 128).alias("longitude"),
        (F.col("o_orderkey") % 100 + 300).cast("double").alias("brightness"),
        (F.col("o_totalprice") / 1000).alias("frp"),
    )


DETECTIONS = """detections AS (
  SELECT o_orderkey, o_orderdate AS acq_date, 38.0::DOUBLE + CAST((o_custkey * 37) % 512 AS DOUBLE) / 128 AS latitude,
    44.0::DOUBLE + CAST((o_custkey * 53) % 768 AS DOUBLE) / 128 AS longitude,
    CAST(o_orderkey % 100 + 300 AS DOUBLE) AS brightness, o_totalprice / 1000 AS frp
  FROM orders)"""


def matched(t: Tables) -> DataFrame:
    return match_points(detections(t), places(t), km=20.0)


MATCHED = f"""{PLACE_TABLE}, {DETECTIONS}, matched AS (
  SELECT d.*, p."City" FROM detections d JOIN places p
    ON d.latitude BETWEEN p."Latitude" - 20 / 111.32::DOUBLE AND p."Latitude" + 20 / 111.32::DOUBLE
   AND d.longitude BETWEEN p."Longitude" - 20 / (111.32::DOUBLE * cos(radians(p."Latitude")))
                       AND p."Longitude" + 20 / (111.32::DOUBLE * cos(radians(p."Latitude"))))"""


def fires(t: Tables) -> DataFrame:
    return events_per_day(matched(t))


FIRES = f"""{MATCHED}, fires AS (
  SELECT "City", CAST(acq_date AS DATE) AS "Date", count(*) AS fire_count, avg(brightness) AS mean_brightness,
    max(frp) AS max_frp, 1 AS "Fire_Occurred" FROM matched GROUP BY 1, 2)"""


# ------------------------------------------------------------------ side tables


def burned(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        place("l_partkey").alias("City"), F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Burned_Area_hectares")
    )
    return side_series_daily(rows, {"Burned_Area_hectares": "max"})


BURNED = """burned AS (
  SELECT 'NATION_' || CAST(l_partkey % 25 AS VARCHAR) AS "City", CAST(l_shipdate AS DATE) AS "Date",
    max(l_extendedprice) AS "Burned_Area_hectares" FROM lineitem GROUP BY 1, 2)"""


def vegetation(t: Tables) -> DataFrame:
    rows = t.orders.select(
        place("o_custkey").alias("City"),
        F.col("o_orderdate").alias("Date"),
        (F.col("o_custkey") % 97 / 128).alias("NDVI"),
        (F.col("o_orderkey") % 61 / 128).alias("NDBI"),
        (F.col("o_orderkey") % 89 / 128).alias("EVI"),
    )
    return side_series_daily(rows, {"NDVI": "mean", "NDBI": "mean", "EVI": "mean"})


VEGETATION = """vegetation AS (
  SELECT 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS "City", CAST(o_orderdate AS DATE) AS "Date",
    avg(CAST(o_custkey % 97 AS DOUBLE) / 128) AS "NDVI", avg(CAST(o_orderkey % 61 AS DOUBLE) / 128) AS "NDBI",
    avg(CAST(o_orderkey % 89 AS DOUBLE) / 128) AS "EVI"
  FROM orders GROUP BY 1, 2)"""


def geography(t: Tables) -> DataFrame:
    """Static columns per place; population and crossings are counted from customers and suppliers."""
    people = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("Pop_Total"))
    roads = t.supplier.groupBy("s_nationkey").agg(
        F.max("s_acctbal").alias("Road_Length_m"), F.count(F.lit(1)).alias("Intersections")
    )
    k = F.col("n_nationkey")
    return (
        t.nation.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(roads, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(
            F.col("n_name").alias("City"),
            ((k * 137) % 1800).cast("double").alias("Elevation"),
            ((k * 11) % 30).cast("double").alias("Slope"),
            ((k * 29) % 100).cast("double").alias("Trees_pct"),
            ((k * 17) % 100).cast("double").alias("Urban_pct"),
            "Pop_Total",
            "Road_Length_m",
            "Intersections",
        )
        .join(places(t), "City")
    )


GEOGRAPHY = """geography AS (
  SELECT n.n_name AS "City", CAST((n_nationkey * 137) % 1800 AS DOUBLE) AS "Elevation", CAST((n_nationkey * 11) % 30 AS DOUBLE) AS "Slope",
    CAST((n_nationkey * 29) % 100 AS DOUBLE) AS "Trees_pct", CAST((n_nationkey * 17) % 100 AS DOUBLE) AS "Urban_pct",
    c.n AS "Pop_Total", s.road AS "Road_Length_m", s.n AS "Intersections", p."Latitude", p."Longitude"
  FROM nation n JOIN places p ON p."City" = n.n_name
  LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS road, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey)"""


# --------------------------------------------------------------- panel with label


def labelled_daily(t: Tables) -> DataFrame:
    """Daily weather with the 0/1 label."""
    label = fires(t).select("City", "Date", "Fire_Occurred")
    return weather_daily(t).join(label, ["City", "Date"], "left").fillna({"Fire_Occurred": 0})


LABELLED = f"""{WEATHER}, {FIRES}, panel AS (
  SELECT w.*, coalesce(f."Fire_Occurred", 0) AS "Fire_Occurred" FROM weather w LEFT JOIN fires f USING ("City", "Date"))"""


# ------------------------------------------------------------------------ scores

MODEL_NAMES = ("forest", "linear", "boosted")


def scores_wide(t: Tables) -> DataFrame:
    """One prediction row per line item with the scores of three models."""
    y = (F.col("l_returnflag") == "R").cast("int")
    q, k, s, o = F.col("l_quantity").cast("bigint"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    day = F.to_date("l_shipdate")
    split = (
        F.when(day < F.lit("1999-01-01").cast("date"), "train")
        .when(day < F.lit("2000-01-01").cast("date"), "val")
        .otherwise("test")
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("row_order"),
        F.col("l_linenumber").alias("row_line"),
        place("l_suppkey").alias("City"),
        day.alias("Date"),
        split.alias("split"),
        y.alias("y"),
        (((q * 7 + k % 97 * 3 + y * 260) % 1000) / 1000).alias("forest"),
        (((s % 211 * 3 + o % 71 * 2 + y * 150) % 1000) / 1000).alias("linear"),
        (((q * 11 + o % 53 * 5 + k % 13 + y * 90) % 1000) / 1000).alias("boosted"),
    )


SCORES_WIDE = """scores_wide AS (
  SELECT l_orderkey AS row_order, l_linenumber AS row_line, 'NATION_' || CAST(l_suppkey % 25 AS VARCHAR) AS "City",
    CAST(l_shipdate AS DATE) AS "Date",
    CASE WHEN l_shipdate < DATE '1999-01-01' THEN 'train' WHEN l_shipdate < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split, y,
    CAST((q * 7 + l_partkey % 97 * 3 + y * 260) % 1000 AS DOUBLE) / 1000 AS forest,
    CAST((l_suppkey % 211 * 3 + l_orderkey % 71 * 2 + y * 150) % 1000 AS DOUBLE) / 1000 AS linear,
    CAST((q * 11 + l_orderkey % 53 * 5 + l_partkey % 13 + y * 90) % 1000 AS DOUBLE) / 1000 AS boosted
  FROM (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"""


def scores(t: Tables) -> DataFrame:
    keys = ["row_order", "row_line", "City", "Date", "split", "y"]
    return scores_wide(t).unpivot(keys, list(MODEL_NAMES), "model", "p")


SCORES = f"""{SCORES_WIDE}, scores AS (
  {' UNION ALL '.join(f"SELECT '{m}' AS model, row_order, row_line, {chr(34)}City{chr(34)}, {chr(34)}Date{chr(34)}, split, y, {m} AS p FROM scores_wide" for m in MODEL_NAMES)})"""


# -------------------------------------------------------------------- risk tables


def daily_risk(t: Tables) -> DataFrame:
    """Daily probability per place and day: the mean score of the day's rows."""
    wide = scores_wide(t)
    return wide.groupBy("City", "Date").agg((F.sum(F.col("forest") * 1000).cast("bigint") / F.count(F.lit(1)) / 1000).alias("probability"))


DAILY_RISK = f"""{SCORES_WIDE}, daily_risk AS (
  SELECT "City", "Date", CAST(CAST(sum(forest * 1000) AS BIGINT) AS DOUBLE) / count(*) / 1000 AS probability FROM scores_wide GROUP BY 1, 2)"""


def station_risk_hourly(t: Tables) -> DataFrame:
    """Hourly probability per station."""
    return hourly_readings(t).groupBy("City", floor_hour("Timestamp").alias("Timestamp")).agg(
        (F.least(F.sum("Wind_Speed_kmh"), F.lit(255.0)) / 256).alias("probability")
    )


def station_risk_daily(t: Tables) -> DataFrame:
    """Daily probability per station; unknown (null) on every sixth day."""
    day = hourly_readings(t).groupBy("City", F.to_date("Timestamp").alias("Date")).agg(
        (F.least(F.avg("Wind_Speed_kmh"), F.lit(63.0)) / 128).alias("probability")
    )
    return day.withColumn("probability", F.when(F.dayofmonth("Date") % 6 != 0, F.col("probability")))


STATION_RISK = f"""{HOURLY_READINGS}, station_hourly AS (
  SELECT "City", date_trunc('hour', "Timestamp") AS "Timestamp", least(sum("Wind_Speed_kmh"), 255) / 256 AS probability
  FROM hreadings GROUP BY 1, 2), station_daily AS (
  SELECT "City", "Date", CASE WHEN day("Date") % 6 <> 0 THEN p END AS probability FROM (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", least(avg("Wind_Speed_kmh"), 63) / 128 AS p
  FROM hreadings GROUP BY 1, 2))"""


TIER_SQL = "CASE WHEN {p} >= 0.60 THEN 'Extreme' WHEN {p} >= 0.35 THEN 'High' WHEN {p} >= 0.15 THEN 'Moderate' ELSE 'Low' END"
TIER_RIGHT_SQL = "CASE WHEN {p} > 0.60 THEN 'Extreme' WHEN {p} > 0.35 THEN 'High' WHEN {p} > 0.15 THEN 'Moderate' ELSE 'Low' END"


def tier_sql(p: str, right: bool = False) -> str:
    return (TIER_RIGHT_SQL if right else TIER_SQL).format(p=p)


def round_all(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column for comparison with the oracle.

    Values are nudged below exact ties first, so that a last-bit difference
    between two engines cannot send a tie up in one and down in the other.
    """
    rounded = lambda c: (F.round(F.col(c) - 1e-9, digits) + 0.0).alias(c)
    return df.select(*[rounded(c) if k in ("double", "float") and c not in keep else F.col(c) for c, k in df.dtypes])


__all__ = [n for n in dir() if not n.startswith("_")] + ["risk_tier"]
