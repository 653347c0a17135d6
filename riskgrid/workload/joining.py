"""Joins, unions, set operations and completion."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from riskgrid.operators import joins as J
from riskgrid.operators import panel as P
from riskgrid.operators import resample as R
from riskgrid.operators.blend import apply_mix
from riskgrid.operators.spatial import match_points
from riskgrid.spec import DAILY, HOURLY
from riskgrid.workload import binding as B
from riskgrid.workload.registry import query


@query(f"""WITH {B.MATCHED} SELECT o_orderkey, "City" FROM matched""")
def spatial_box_join(t):
    return B.matched(t).select("o_orderkey", "City")


HAVERSINE = """2 * 6371.0088 * asin(sqrt(least(power(sin(radians(p."Latitude" - d.latitude) / 2), 2)
  + cos(radians(d.latitude)) * cos(radians(p."Latitude")) * power(sin(radians(p."Longitude" - d.longitude) / 2), 2), 1)))"""


@query(f"""WITH {B.MATCHED} SELECT o_orderkey, d."City" FROM matched d JOIN places p USING ("City") WHERE {HAVERSINE} <= 20""")
def spatial_circle_join(t):
    return match_points(B.detections(t), B.places(t), km=20.0, within_circle=True).select("o_orderkey", "City")


@query(
    f"""WITH {B.HOURLY_READINGS}, lbl AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", 1 AS "Fire_Occurred" FROM hreadings GROUP BY 1, 2 HAVING sum("Rain_mm") > 100)
    SELECT "City", "Timestamp", CAST("Timestamp" AS DATE) AS "Date", CAST(coalesce("Fire_Occurred", 0) AS INTEGER) AS "Fire_Occurred"
    FROM hreadings h LEFT JOIN lbl USING ("City") WHERE lbl."Date" = CAST("Timestamp" AS DATE)
    UNION ALL SELECT "City", "Timestamp", CAST("Timestamp" AS DATE), 0 FROM hreadings h
    WHERE NOT EXISTS (SELECT 1 FROM lbl WHERE lbl."City" = h."City" AND lbl."Date" = CAST(h."Timestamp" AS DATE))"""
)
def label_every_hour(t):
    rows = B.hourly_readings(t).select("City", "Timestamp", "Rain_mm")
    daily = rows.groupBy("City", F.to_date("Timestamp").alias("Date")).agg(F.sum("Rain_mm").alias("s"))
    labels = daily.filter("s > 100").select("City", "Date", F.lit(1).alias("Fire_Occurred"))
    out = J.attach_daily(rows, labels, fill={"Fire_Occurred": 0})
    return out.select("City", "Timestamp", "Date", "Fire_Occurred")


@query(
    f"""WITH {B.WEATHER}, {B.VEGETATION}, j AS (SELECT w."City", w."Date", v."NDVI" FROM weather w LEFT JOIN vegetation v USING ("City", "Date"))
    SELECT "City", "Date", round(coalesce(last_value("NDVI" IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value("NDVI" IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS "NDVI"
    FROM j WINDOW w AS (PARTITION BY "City" ORDER BY "Date")"""
)
def sparse_asof_on_grid(t):
    return B.round_all(J.attach_sparse(B.weather_daily(t).select("City", "Date"), B.vegetation(t), DAILY, ["NDVI"]))


@query(
    f"""WITH {B.WEATHER}, {B.VEGETATION}, f AS (SELECT "City", "Date", "NDVI" FROM vegetation), g AS (
      SELECT w."City", w."Date", p."NDVI" FROM weather w ASOF LEFT JOIN f p ON w."City" = p."City" AND w."Date" >= p."Date"),
    first_known AS (SELECT "City", arg_min("NDVI", "Date") AS v FROM f GROUP BY 1)
    SELECT g."City", "Date", round(coalesce("NDVI", v), 6) AS "NDVI" FROM g LEFT JOIN first_known USING ("City")"""
)
def sparse_asof_off_grid(t):
    return B.round_all(J.attach_sparse(B.weather_daily(t).select("City", "Date"), B.vegetation(t), DAILY, ["NDVI"], off_grid=True))


@query(
    f"""WITH {B.WEATHER}, {B.PLACE_TABLE}, {B.GEOGRAPHY} SELECT w."City", w."Date", coalesce("Elevation", 0) AS "Elevation", coalesce("Pop_Total", 0) AS "Pop_Total",
      coalesce("Intersections", 0) AS "Intersections", coalesce("Road_Length_m", 0) AS "Road_Length_m" FROM weather w LEFT JOIN geography g USING ("City")"""
)
def static_dimension_join(t):
    side = B.geography(t).select("City", "Elevation", "Pop_Total", "Intersections", "Road_Length_m")
    return J.attach(B.weather_daily(t).select("City", "Date"), side, ["City"], fill={c: 0 for c in side.columns if c != "City"})


@query(
    f"""WITH {B.WEATHER}, m AS (SELECT "City", max("Rain_mm_sum") AS mx FROM weather GROUP BY 1)
    SELECT w."City", "Date", round(coalesce(CASE WHEN "Rain_mm_sum" > 5 THEN "Rain_mm_sum" END, mx), 6) AS "Rain_mm_sum", round(mx, 6) AS top_rain FROM weather w LEFT JOIN m USING ("City")"""
)
def join_with_fallback(t):
    base = B.weather_daily(t)
    side = base.groupBy("City").agg(F.max("Rain_mm_sum").alias("Rain_mm_sum"), F.max("Rain_mm_sum").alias("top_rain"))
    own = base.select("City", "Date", F.when(F.col("Rain_mm_sum") > 5, F.col("Rain_mm_sum")).alias("Rain_mm_sum"))
    return B.round_all(J.attach_with_fallback(own, side, ["City"]))


@query(
    f"""WITH {B.WEATHER}, l AS (SELECT "City", arg_max("Soil_Temp_C_mean", "Date") AS v FROM weather GROUP BY 1)
    SELECT f."City", f.acq AS "Date", round(v, 6) AS "Soil_Temp_C_mean" FROM (SELECT DISTINCT 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS "City", CAST(o_orderdate AS DATE) AS acq FROM orders) f LEFT JOIN l USING ("City")"""
)
def latest_row_dimension(t):
    horizon = t.orders.select(B.place("o_custkey").alias("City"), F.to_date("o_orderdate").alias("Date")).distinct()
    return B.round_all(J.attach_latest(horizon, B.weather_daily(t), DAILY, ["Soil_Temp_C_mean"]))


@query(
    f"""WITH {B.STATION_RISK} SELECT h."City", h."Timestamp", round(CASE WHEN d.probability IS NULL THEN h.probability
      ELSE least(h.probability, greatest(d.probability * 2.5, 0.15)) END, 6) AS probability
    FROM station_hourly h LEFT JOIN station_daily d ON d."City" = h."City" AND d."Date" = CAST(h."Timestamp" AS DATE)"""
)
def daily_anchor_cap(t):
    return B.round_all(J.cap_by_day(B.station_risk_hourly(t), B.station_risk_daily(t)))


@query(
    f"""WITH {B.WEATHER}, m AS (SELECT "City", month("Date") AS mo, avg("Rain_mm_sum") AS v FROM weather WHERE "Date" < DATE '2000-01-01' GROUP BY 1, 2)
    SELECT w."City", "Date", round("Rain_mm_sum" - v, 6) AS anomaly FROM weather w LEFT JOIN m ON m."City" = w."City" AND mo = month("Date") WHERE "Date" >= DATE '2000-01-01'"""
)
def month_lookup_join(t):
    base = B.weather_daily(t).withColumn("Month", F.month("Date"))
    train = base.filter(F.col("Date") < F.lit("2000-01-01").cast("date"))
    means = train.groupBy("City", "Month").agg(F.avg("Rain_mm_sum").alias("v"))
    rest = base.filter(F.col("Date") >= F.lit("2000-01-01").cast("date"))
    out = J.attach(rest, means, ["City", "Month"])
    return B.round_all(out.select("City", "Date", (F.col("Rain_mm_sum") - F.col("v")).alias("anomaly")))


@query(
    f"""WITH {B.PLACE_TABLE}, d AS (SELECT CAST(o_orderdate AS DATE) AS "Date", count(*) AS n FROM orders GROUP BY 1) SELECT "City", "Date", n FROM d, places"""
)
def replicate_forecast(t):
    forecast = t.orders.groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.count(F.lit(1)).alias("n"))
    return J.replicate_to_entities(forecast, B.places(t)).select("City", "Date", "n")


#: Places that report: those with at least the mean total of rain.
WET = """wet AS (SELECT "City" FROM (SELECT "City", sum("Rain_mm_sum") AS s FROM weather GROUP BY 1) WHERE s >= (SELECT avg(s) FROM (SELECT sum("Rain_mm_sum") AS s FROM weather GROUP BY "City")))"""
PARTIAL = f"""{WET}, part AS (SELECT "City", "Date", "Rain_mm_sum" FROM weather SEMI JOIN wet USING ("City"))"""


def wet_places(weather):
    totals = weather.groupBy("City").agg(F.sum("Rain_mm_sum").alias("s"))
    return totals.filter(F.col("s") >= totals.agg(F.avg("s").alias("m")).scalar()).select("City")


@query(
    f"""WITH {B.WEATHER}, {B.PLACE_TABLE}, {PARTIAL}, miss AS (SELECT "City" FROM places WHERE "City" NOT IN (SELECT "City" FROM part))
    SELECT "City", "Date", round("Rain_mm_sum", 6) AS "Rain_mm_sum" FROM part
    UNION ALL SELECT miss."City", "Date", round("Rain_mm_sum", 6) FROM part, miss WHERE part."City" = (SELECT min("City") FROM part)"""
)
def complete_missing_places(t):
    weather = B.weather_daily(t).select("City", "Date", "Rain_mm_sum")
    some = weather.join(wet_places(weather), "City", "left_semi")
    return B.round_all(J.complete_entities(some, B.places(t)))


@query(
    f"""WITH {B.WEATHER}, {B.PLACE_TABLE}, {PARTIAL} SELECT "City" FROM places WHERE "City" NOT IN (SELECT "City" FROM part)"""
)
def missing_places(t):
    some = wet_places(B.weather_daily(t))
    return J.missing_entities(B.places(t), some)


@query(
    f"""WITH {B.PLACE_TABLE}, {B.GEOGRAPHY}, g AS (SELECT "City", "Elevation", "Intersections" FROM geography WHERE "Elevation" > 400)
    SELECT * FROM g UNION ALL SELECT "City", 0, 0 FROM places WHERE "City" NOT IN (SELECT "City" FROM g)"""
)
def placeholder_places(t):
    known = B.geography(t).select("City", "Elevation", "Intersections").filter("Elevation > 400")
    return J.placeholder_rows(known, B.places(t))


@query(
    f"""WITH {B.WEATHER}, {B.FIRES} SELECT "City", "Date", round("Rain_mm_sum", 6) AS "Rain_mm_sum" FROM weather w
    WHERE EXISTS (SELECT 1 FROM fires f WHERE f."City" = w."City" AND f."Date" = w."Date")"""
)
def keep_horizon_times(t):
    return B.round_all(J.keep_times_of(B.weather_daily(t).select("City", "Date", "Rain_mm_sum"), B.fires(t), DAILY))


@query(
    f"""WITH {B.WEATHER}, {B.FIRES}, s AS (SELECT "City", max("Date") - INTERVAL 45 DAY AS lo FROM fires GROUP BY 1)
    SELECT w."City", "Date", round("Rain_mm_sum", 6) AS "Rain_mm_sum" FROM weather w JOIN s USING ("City") WHERE "Date" >= lo"""
)
def context_tail(t):
    horizon = B.fires(t).groupBy("City").agg(F.max("Date").alias("Date"))
    return B.round_all(J.history_tail(B.weather_daily(t).select("City", "Date", "Rain_mm_sum"), horizon, DAILY, "45 days"))


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", round("Rain_mm_sum", 6) AS "Rain_mm_sum" FROM weather WHERE "Date" > (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"""
)
def future_slice(t):
    actual = t.orders.select(F.to_date("o_orderdate").alias("Date"))
    return B.round_all(J.after_last_actual(B.weather_daily(t).select("City", "Date", "Rain_mm_sum"), actual, "Date"))


FORECASTS = """fc AS (SELECT "City", "Date", "Temperature_C_mean" AS actual,
    lag("Temperature_C_mean", 1) OVER (PARTITION BY "City" ORDER BY "Date") AS a,
    avg("Temperature_C_mean") OVER (PARTITION BY "City" ORDER BY "Date" ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM weather)"""


def naive_forecasts(t):
    base = B.weather_daily(t).select("City", "Date", "Temperature_C_mean")
    out = P.row_features(base, DAILY, [P.lags(["Temperature_C_mean"], (1,)), P.trailing_mean("Temperature_C_mean", 7, "b")], 7)
    return out.select("City", "Date", F.col("Temperature_C_mean").alias("actual"), F.col("Temperature_C_mean_lag1").alias("a"), "b")


@query(
    f"""WITH {B.WEATHER}, {FORECASTS}, h AS (SELECT * FROM fc WHERE "Date" > (SELECT max("Date") FROM weather) - INTERVAL 30 DAY AND a IS NOT NULL)
    SELECT "City", "Date", round(actual, 6) AS actual, round(a, 6) AS a, round(b, 6) AS b FROM h
    WHERE "City" IN (SELECT "City" FROM h GROUP BY 1 HAVING count(*) >= 5)"""
)
def holdout_three_way_join(t):
    """Actual and two forecasts joined on the hold-out, places with at least five rows only."""
    fc = naive_forecasts(t).filter(F.col("a").isNotNull())
    hold = J.split_holdout(fc, "Date", "30 days").filter("part = 'holdout'")
    joined = (
        hold.select("City", "Date", "actual")
        .join(hold.select("City", "Date", "a"), DAILY.key)
        .join(hold.select("City", "Date", "b"), DAILY.key)
    )
    enough = joined.groupBy("City").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return B.round_all(joined.join(enough, "City", "left_semi"))


@query(
    f"""WITH {B.READINGS}, {B.FIRES}, old AS (SELECT "City", "Date", CAST(fire_count AS DOUBLE) AS v FROM fires),
    new AS (SELECT "City", "Date" + 1 AS "Date", max_frp AS v FROM fires)
    SELECT "City", "Date", round(coalesce(new.v, old.v), 6) AS v, CASE WHEN new.v IS NULL THEN 'history' ELSE 'forecast' END AS origin
    FROM old FULL JOIN new USING ("City", "Date")"""
)
def overlay_forecast(t):
    base = B.fires(t)
    old = base.select("City", "Date", F.col("fire_count").cast("double").alias("v"), F.lit("history").alias("origin"))
    new = base.select("City", F.date_add("Date", 1).alias("Date"), F.col("max_frp").alias("v"), F.lit("forecast").alias("origin"))
    return B.round_all(P.overlay(old, new, ["City", "Date"]))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS amount, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer"""
)
def union_by_name(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    b = t.customer.select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", variable, round(value, 6) AS value FROM
      (SELECT "City", "Timestamp", "Temperature_C", "Rain_mm", "Wind_Speed_kmh" FROM hourly)
      UNPIVOT INCLUDE NULLS (value FOR variable IN ("Temperature_C", "Rain_mm", "Wind_Speed_kmh"))"""
)
def lengthen_hourly(t):
    return B.round_all(R.lengthen(B.weather_hourly(t), HOURLY.key, ["Temperature_C", "Rain_mm", "Wind_Speed_kmh"]))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C", round("Rain_mm", 6) AS "Rain_mm" FROM hourly"""
)
def widen_forecast(t):
    long = R.lengthen(B.weather_hourly(t), HOURLY.key, ["Temperature_C", "Rain_mm"])
    return B.round_all(R.widen(long, HOURLY, "variable", "value", ["Temperature_C", "Rain_mm"]))


@query(
    """SELECT d AS "Date" FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))
    WHERE (rn - 1) % 5 = 0 OR rn = n"""
)
def every_fifth_date(t):
    dates = t.orders.select(F.to_date("o_orderdate").alias("Date")).distinct()
    # one row per calendar day, so the single ordered window is bounded by the calendar
    w = Window.orderBy("Date")
    numbered = dates.select("Date", F.row_number().over(w).alias("rn"), F.lead("Date").over(w).alias("nxt"))
    return numbered.filter((F.pmod(F.col("rn") - 1, F.lit(5)) == 0) | F.col("nxt").isNull()).select("Date")


@query(
    f"""WITH {B.WEATHER}, {FORECASTS}, {WET}, w8 AS (SELECT DISTINCT "City", CASE WHEN wet."City" IS NULL THEN 0 ELSE 0.25 END AS weight FROM weather LEFT JOIN wet USING ("City"))
    SELECT "City", "Date", round(a * weight + b * (1 - weight), 6) AS value FROM fc LEFT JOIN w8 USING ("City")"""
)
def weight_lookup_blend(t):
    fc = naive_forecasts(t)
    weights = wet_places(B.weather_daily(t)).withColumn("weight", F.lit(0.25))
    return B.round_all(apply_mix(fc, weights, ["City"]).select("City", "Date", "value"))
