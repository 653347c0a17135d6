"""Scalar families: calendar, indices, tiers, texts, cleaning, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.functions import calendar as C
from riskgrid.functions import indices as I
from riskgrid.functions import nulls as N
from riskgrid.functions import risk as K
from riskgrid.operators import clean as L
from riskgrid.operators import joins as J
from riskgrid.operators import panel as P
from riskgrid.operators import stats as S
from riskgrid.spec import DAILY
from riskgrid.workload import binding as B
from riskgrid.workload.registry import query

VPD_SQL = "greatest(0.6108 * exp(17.27 * {t} / ({t} + 237.3)) * (1 - {h} / 100), 0)"
GAMMA = "(17.27 * {t} / (237.3 + {t}) + ln(greatest({h}, 1) / 100))"
DEW_SQL = f"237.3 * {GAMMA} / (17.27 - {GAMMA})"
HEAT_SQL = """CASE WHEN {t} > 27 THEN (-42.379 + 2.04901523 * ({t} * 1.8 + 32) + 10.14333127 * {h} - 0.22475541 * ({t} * 1.8 + 32) * {h}
  - 0.00683783 * ({t} * 1.8 + 32) ** 2 - 0.05481717 * {h} ** 2 + 0.00122874 * ({t} * 1.8 + 32) ** 2 * {h}
  + 0.00085282 * ({t} * 1.8 + 32) * {h} ** 2 - 0.00000199 * ({t} * 1.8 + 32) ** 2 * {h} ** 2 - 32) / 1.8 ELSE {t} END"""


def date_parts_sql(d: str) -> str:
    return f"""CAST(year({d}) AS INTEGER) AS "Year", CAST(month({d}) AS INTEGER) AS "Month", CAST(dayofyear({d}) AS INTEGER) AS "DayOfYear",
      CAST(isodow({d}) - 1 AS INTEGER) AS "DayOfWeek", CAST(weekofyear({d}) AS INTEGER) AS "WeekOfYear",
      round(sin(2 * pi() * month({d}) / 12), 6) AS "Month_sin", round(cos(2 * pi() * month({d}) / 12), 6) AS "Month_cos",
      round(sin(2 * pi() * dayofyear({d}) / 365), 6) AS "DoY_sin", round(cos(2 * pi() * dayofyear({d}) / 365), 6) AS "DoY_cos",
      round(sin(2 * pi() * (isodow({d}) - 1) / 7), 6) AS "DoW_sin", round(cos(2 * pi() * (isodow({d}) - 1) / 7), 6) AS "DoW_cos",
      CAST(CASE WHEN month({d}) IN (12, 1, 2) THEN 0 WHEN month({d}) <= 5 THEN 1 WHEN month({d}) <= 8 THEN 2 ELSE 3 END AS INTEGER) AS "Season",
      CAST(month({d}) IN (6, 7, 8) AS INTEGER) AS is_summer, CAST(month({d}) IN (12, 1, 2) AS INTEGER) AS is_winter,
      CAST(month({d}) BETWEEN 5 AND 9 AS INTEGER) AS is_fire_season"""


@query(f"""WITH {B.WEATHER} SELECT "City", "Date", {date_parts_sql('"Date"')} FROM weather""")
def calendar_daily(t):
    return B.round_all(C.add_date_parts(B.weather_daily(t).select("City", "Date")))


@query(
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS "Hour", round(sin(2 * pi() * hour(ts) / 24), 6) AS "Hour_sin",
      round(cos(2 * pi() * hour(ts) / 24), 6) AS "Hour_cos", CAST(hour(ts) BETWEEN 6 AND 20 AS INTEGER) AS is_daytime,
      CAST(hour(ts) BETWEEN 6 AND 18 AS INTEGER) AS is_daytime_training FROM events"""
)
def calendar_hourly(t):
    out = C.add_hour_parts(t.events.select("event_id", F.col("ts").alias("Timestamp")))
    return B.round_all(out.withColumn("is_daytime_training", N.flag(F.col("Hour").between(6, 18))).drop("Timestamp"))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS stamp_text, CAST(CAST(o_orderdate AS DATE) - INTERVAL 45 DAY AS DATE) AS context_from,
      CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS last_year FROM orders"""
)
def date_arithmetic(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        d.alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("stamp_text"),
        F.date_sub(d, 45).alias("context_from"),
        F.add_months(d, -12).alias("last_year"),
    )


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date",
      round({VPD_SQL.format(t='"Temperature_C_mean"', h='"Humidity_percent_mean"')}, 6) AS "VPD_kPa",
      round({DEW_SQL.format(t='"Temperature_C_mean"', h='"Humidity_percent_mean"')}, 6) AS "Dew_Point_C",
      round({HEAT_SQL.format(t='"Temperature_C_mean"', h='"Humidity_percent_mean"')}, 6) AS "Heat_Index"
    FROM weather"""
)
def weather_indices(t):
    a, b = "Temperature_C_mean", "Humidity_percent_mean"
    return B.round_all(
        B.weather_daily(t).select(
            "City",
            "Date",
            I.vapour_pressure_deficit(a, b).alias("VPD_kPa"),
            I.dew_point(a, b).alias("Dew_Point_C"),
            I.heat_index(a, b).alias("Heat_Index"),
        )
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, p, tier AS risk_level, CAST(CASE tier WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS INTEGER) AS risk_rank,
      CASE WHEN p > 0.60 THEN 'Extreme' WHEN p > 0.35 THEN 'High' WHEN p > 0.15 THEN 'Moderate' ELSE 'Low' END AS risk_level_right,
      round(greatest(least(0.55 + 0.8 * abs(p - 0.5), 0.95), 0.55), 6) AS confidence,
      CASE tier WHEN 'Low' THEN '#3FA773' WHEN 'Moderate' THEN '#D8A31D' WHEN 'High' THEN '#D96C3B' ELSE '#B73333' END AS risk_color
    FROM (SELECT *, CASE WHEN p >= 0.60 THEN 'Extreme' WHEN p >= 0.35 THEN 'High' WHEN p >= 0.15 THEN 'Moderate' ELSE 'Low' END AS tier
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 101 AS DOUBLE) / 100 AS p FROM lineitem))"""
)
def risk_tiers(t):
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 101 / 100).alias("p"))
    out = p.select(
        "*",
        K.risk_tier("p").alias("risk_level"),
        K.risk_tier("p", "right").alias("risk_level_right"),
        K.confidence("p").alias("confidence"),
    )
    out = out.select("*", K.tier_rank("risk_level").alias("risk_rank"), K.tier_colour("risk_level").alias("risk_color"))
    return B.round_all(out, keep=("p",))


SENTENCE_SQL = """upper(left(s, 1)) || substr(s, 2) || '.'"""


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", {SENTENCE_SQL} AS climate_summary, risk_level, CASE
        WHEN risk_level IN ('High', 'Extreme') THEN 'High temperature, dry air, and wind can accelerate wildfire spread.'
        WHEN w >= 18 THEN 'Wind is elevated, so small ignitions could spread faster.'
        WHEN h <= 40 THEN 'Low humidity can dry vegetation and raise ignition sensitivity.'
        ELSE 'Current conditions suggest limited short-term wildfire pressure.' END AS warning
    FROM (SELECT "City", "Date", w, h, CASE WHEN t / 64 >= 0.60 THEN 'Extreme' WHEN t / 64 >= 0.35 THEN 'High' WHEN t / 64 >= 0.15 THEN 'Moderate' ELSE 'Low' END AS risk_level,
      concat_ws(', ', CASE WHEN t >= 28 THEN 'hot conditions' WHEN t <= 12 THEN 'cool conditions' ELSE 'mild temperatures' END,
        CASE WHEN w >= 18 THEN 'strong wind' END, CASE WHEN h <= 40 THEN 'dry air' END, CASE WHEN r >= 2 THEN 'recent rainfall' END) AS s
      FROM (SELECT "City", "Date", "Temperature_C_mean" AS t, "Wind_Speed_kmh_mean" AS w, "Humidity_percent_mean" AS h, "Rain_mm_sum" AS r FROM weather))"""
)
def risk_texts(t):
    a = ("Temperature_C_mean", "Wind_Speed_kmh_mean", "Humidity_percent_mean", "Rain_mm_sum")
    out = B.weather_daily(t).withColumn("risk_level", K.risk_tier(F.col(a[0]) / 64))
    return out.select(
        "City", "Date", "risk_level", K.weather_sentence(*a).alias("climate_summary"), K.warning_sentence("risk_level", a[1], a[2]).alias("warning")
    )


@query(
    """SELECT doc_id, try_cast(CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE text END AS DOUBLE) AS size,
      try_cast(strptime_ok AS DATE) AS parsed_day FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') ELSE lang END AS strptime_ok FROM documents)"""
)
def lenient_coercion(t):
    rows = t.documents.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.col("text")).alias("size"),
        F.when(
            F.col("doc_id") % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"))
        ).otherwise(F.col("lang")).alias("parsed_day"),
    )
    return L.coerce(rows, dates=["parsed_day"], numbers=["size"])


@query(
    """SELECT d.doc_id, lower(trim(source)) AS source_name, CAST(starts_with(lower(source), 'w') AS INTEGER) AS is_web, CAST(contains(text, ' ') AS INTEGER) AS has_space,
      replace(lang, 'e', 'E') AS lang_text, concat_ws('-', lang, CAST(quality AS VARCHAR)) AS tag
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def string_helpers(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.lower(F.trim("source")).alias("source_name"),
        N.flag(F.lower("source").startswith("w")).alias("is_web"),
        N.flag(F.contains("text", F.lit(" "))).alias("has_space"),
        F.replace("lang", F.lit("e"), F.lit("E")).alias("lang_text"),
        F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("tag"),
    )


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", round(least(greatest("Temperature_C_mean" * 3 - 20, -60), 60), 6) AS "Temperature_C_mean",
      round(least(greatest("Humidity_percent_mean" * 1.5, 0), 100), 6) AS "Humidity_percent_mean",
      CASE WHEN "Rain_mm_sum" > 0 THEN round(least("Rain_mm_sum" * 40, 500), 6) END AS "Rain_mm_sum" FROM weather"""
)
def clip_physical_bounds(t):
    rows = B.weather_daily(t).select(
        "City",
        "Date",
        (F.col("Temperature_C_mean") * 3 - 20).alias("Temperature_C_mean"),
        (F.col("Humidity_percent_mean") * 1.5).alias("Humidity_percent_mean"),
        F.when(F.col("Rain_mm_sum") > 0, F.col("Rain_mm_sum") * 40).alias("Rain_mm_sum"),
    )
    return B.round_all(L.clip_physical(rows))


@query(
    f"""WITH {B.WEATHER}, q AS (SELECT quantile_cont("Temperature_C_mean", 0.01) a1, quantile_cont("Temperature_C_mean", 0.99) b1,
      quantile_cont("Rain_mm_sum", 0.01) a2, quantile_cont("Rain_mm_sum", 0.99) b2 FROM weather)
    SELECT "City", "Date", round(least(greatest("Temperature_C_mean", a1), b1), 6) AS "Temperature_C_mean",
      round(least(greatest("Rain_mm_sum", a2), b2), 6) AS "Rain_mm_sum" FROM weather, q"""
)
def winsorise_global(t):
    rows = B.weather_daily(t).select("City", "Date", "Temperature_C_mean", "Rain_mm_sum")
    return B.round_all(L.winsorise(rows, ["Temperature_C_mean", "Rain_mm_sum"]))


@query(
    f"""WITH {B.WEATHER}, n AS (SELECT "City", "Date", nullif("Rain_mm_sum", 0) AS r, "Wind_Speed_kmh_mean" AS w FROM weather),
    m AS (SELECT "City", quantile_cont(r, 0.5) AS mr FROM n GROUP BY 1)
    SELECT "City", "Date", round(coalesce(r, mr, 0), 6) AS "Rain_mm_sum", round(w, 6) AS "Wind_Speed_kmh_mean" FROM n JOIN m USING ("City")"""
)
def impute_place_median(t):
    rows = B.weather_daily(t).select("City", "Date", F.nullif("Rain_mm_sum", F.lit(0.0)).alias("Rain_mm_sum"), "Wind_Speed_kmh_mean")
    return B.round_all(L.impute_entity_median(rows, ["Rain_mm_sum", "Wind_Speed_kmh_mean"]))


@query(
    f"""WITH {B.WEATHER}, l AS (SELECT *, lag("Temperature_C_mean", 7) OVER (PARTITION BY "City" ORDER BY "Date") AS lag7 FROM weather),
    m AS (SELECT "City", quantile_cont("Rain_mm_sum", 0.5) mr, quantile_cont("Wind_Dir_deg_mean", 0.5) md, quantile_cont(lag7, 0.5) ml FROM l GROUP BY 1)
    SELECT "City", "Date", CAST(month("Date") AS DOUBLE) AS "Month", round(coalesce(nullif("Rain_mm_sum", 0), mr, 0), 6) AS "Rain_mm_sum",
      round(coalesce(md, 0), 6) AS "Wind_Dir_deg_mean", round(coalesce(lag7, ml, 0), 6) AS "Temperature_C_mean_lag7", CAST(0 AS DOUBLE) AS never_seen
    FROM l JOIN m USING ("City")"""
)
def repair_model_columns(t):
    base = B.weather_daily(t).select("City", "Date", "Rain_mm_sum", "Wind_Dir_deg_mean", "Temperature_C_mean")
    hist = P.add_lags(base, DAILY, ["Temperature_C_mean"], (7,)).withColumn("Month", F.month("Date"))
    wanted = ["Month", "Rain_mm_sum", "Wind_Dir_deg_mean", "Temperature_C_mean_lag7", "never_seen"]
    medians = S.fit_medians(hist, [c for c in wanted if c in hist.columns])
    horizon = hist.drop("Wind_Dir_deg_mean", "Temperature_C_mean")
    return B.round_all(L.repair_features(horizon, wanted, medians, base=["Rain_mm_sum"], calendar=["Month"]))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, 0) AS l_tax, coalesce(CASE WHEN l_discount > 0.02 THEN l_discount END, 0) AS l_discount FROM lineitem"""
)
def fill_missing_zero(t):
    holes = lambda c: F.when(F.col(c) > 0.02, F.col(c)).alias(c)
    return L.fill_zero(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", holes("l_tax"), holes("l_discount")), ["l_tax", "l_discount"])


@query(
    f"""WITH {B.LABELLED} SELECT "City", "Date", CASE WHEN "Date" < DATE '1999-01-01' THEN 'train' WHEN "Date" < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split,
      CAST("Fire_Occurred" AS INTEGER) AS "Fire_Occurred" FROM panel"""
)
def temporal_split(t):
    return B.labelled_daily(t).select("City", "Date", C.temporal_split("Date", "1999-01-01", "2000-01-01").alias("split"), "Fire_Occurred")


@query(
    f"""WITH {B.WEATHER}, m AS (SELECT CAST(max("Date") - INTERVAL 30 DAY AS DATE) AS cut FROM weather)
    SELECT "City", "Date", CASE WHEN "Date" <= cut THEN 'train' ELSE 'holdout' END AS part FROM weather, m"""
)
def holdout_cutoff(t):
    return J.split_holdout(B.weather_daily(t).select("City", "Date"), "Date", "30 days")


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", CAST(0 AS DOUBLE) AS "EVI", round("Rain_mm_sum", 6) AS "Rain_mm_sum", round("Temperature_C_mean", 6) AS "Temperature_C_mean" FROM weather"""
)
def align_to_model(t):
    return B.round_all(L.align_features(B.weather_daily(t), ["Rain_mm_sum", "EVI", "Temperature_C_mean"], keep=["City", "Date"]))


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", CAST(0 AS DOUBLE) AS "Elevation", round("Rain_mm_sum", 6) AS "Rain_mm_sum" FROM weather"""
)
def projection_with_defaults(t):
    return B.round_all(L.with_defaults(B.weather_daily(t), ["City", "Date", "Rain_mm_sum", "Elevation"]))


@query(
    """SELECT event_id, event_type AS station, CAST(event_type = 'click' AS INTEGER) AS city_click, CAST(event_type = 'error' AS INTEGER) AS city_error,
      CASE WHEN event_type IN ('click', 'error') THEN event_type END AS back FROM events"""
)
def one_hot_stations(t):
    names = ("click", "error")
    out = L.one_hot(t.events.select("event_id", F.col("event_type").alias("station")), "station", names)
    return out.withColumn("back", L.one_hot_value([f"city_{n}" for n in names]))


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C_mean", round("Rain_mm", 6) AS "Rain_mm_sum" FROM hourly"""
)
def suffix_repair(t):
    bare = B.weather_hourly(t).select("City", "Timestamp", "Temperature_C", F.col("Rain_mm").alias("Rain_mm_sum"))
    return B.round_all(L.add_mean_suffix(bare, keys=("City", "Timestamp")))


@query(
    """SELECT event_id, CAST(CASE WHEN hour(ts) BETWEEN 6 AND 20 THEN CAST(event_type = 'error' AS INTEGER) ELSE 0 END AS INTEGER) AS "Fire_Occurred" FROM events"""
)
def daytime_label(t):
    rows = C.add_hour_parts(t.events.select("event_id", F.col("ts").alias("Timestamp"), N.flag(F.col("event_type") == "error").alias("y")))
    return rows.select("event_id", L.mask_label("y", "is_daytime").alias("Fire_Occurred"))


@query(
    f"""WITH {B.WEATHER}, s AS (SELECT avg(greatest("Temperature_C_max" - "Temperature_C_mean", 0)) tu, avg(greatest("Temperature_C_mean" - "Temperature_C_min", 0)) td,
      avg(greatest("Humidity_percent_max" - "Humidity_percent_mean", 0)) hu, avg(greatest("Humidity_percent_mean" - "Humidity_percent_min", 0)) hd FROM weather),
    e AS (SELECT "City", "Date", "Temperature_C_mean" AS t, "Humidity_percent_mean" AS h, "Wind_Speed_kmh_mean" AS w,
      "Temperature_C_mean" + tu AS tx, "Temperature_C_mean" - td AS tn, "Humidity_percent_mean" + hu AS hx, "Humidity_percent_mean" - hd AS hn FROM weather, s)
    SELECT "City", "Date", round(tx, 6) AS "Temperature_C_max", round(tn, 6) AS "Temperature_C_min", round(hx, 6) AS "Humidity_percent_max", round(hn, 6) AS "Humidity_percent_min",
      round(tx - tn, 6) AS temp_range, round(hx - hn, 6) AS "Humidity_percent_diurnal_range",
      round(CASE WHEN t >= 28 THEN least(greatest((t - 28) * 2, 1), 12) ELSE 0 END, 6) AS hours_temp_above_30,
      round(CASE WHEN h <= 40 THEN least(greatest((40 - h) * 0.5, 1), 10) ELSE 0 END, 6) AS hours_humidity_below_30,
      round(CASE WHEN w >= 18 THEN least(greatest((w - 18) * 0.8, 1), 8) ELSE 0 END, 6) AS hours_wind_above_20,
      round(13, 6) AS solar_peak_hour, round(tn, 6) AS temp_night_min FROM e"""
)
def spread_and_hour_proxies(t):
    daily = B.weather_daily(t)
    use = ["Temperature_C", "Humidity_percent"]
    means = daily.select("City", "Date", "Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean")
    out = L.estimate_extremes(means, S.fit_spread(daily, use), use)
    return B.round_all(out.select("*", *L.hour_proxies()).drop("Temperature_C_mean", "Humidity_percent_mean", "Wind_Speed_kmh_mean"))


@query(
    f"""WITH {B.FIRES} SELECT "City", "Date", CAST(fire_count AS DOUBLE) AS fire_count_7d, CAST(0 AS DOUBLE) AS fire_count_14d, CAST(0 AS DOUBLE) AS fire_count_30d,
      CAST(0 AS DOUBLE) AS fire_count_90d, CAST(365 AS DOUBLE) AS days_since_last_fire, CAST(0.02 AS DOUBLE) AS city_month_fire_rate, CAST(0.02 AS DOUBLE) AS city_fire_rate FROM fires"""
)
def default_event_history(t):
    return L.default_history(B.fires(t).select("City", "Date", F.col("fire_count").alias("fire_count_7d")))


@query(
    f"""WITH {B.WEATHER}, n AS (SELECT "City", "Date", nullif("Wind_Speed_kmh_mean", 0) AS w, CASE WHEN "Rain_mm_sum" > 3 THEN "Rain_mm_sum" END AS r FROM weather)
    SELECT "City", round(arg_max(w, "Date") FILTER (w IS NOT NULL), 6) AS w, round(arg_max(r, "Date") FILTER (r IS NOT NULL), 6) AS r FROM n GROUP BY 1"""
)
def trailing_value_proxy(t):
    rows = B.weather_daily(t).select(
        "City",
        "Date",
        F.nullif("Wind_Speed_kmh_mean", F.lit(0.0)).alias("w"),
        F.when(F.col("Rain_mm_sum") > 3, F.col("Rain_mm_sum")).alias("r"),
    )
    return B.round_all(J.last_known(rows, DAILY, ["w", "r"]))


@query(
    f"""WITH {B.WEATHER} SELECT "City", "Date", CASE WHEN "Rain_mm_sum" > 1 THEN round("Rain_mm_sum", 6) END AS rain,
      CASE WHEN "Rain_mm_sum" > 1 THEN 'ok' ELSE 'check' END AS mark FROM weather"""
)
def nan_to_null_scan(t):
    rows = B.weather_daily(t).select(
        "City", "Date", F.when(F.col("Rain_mm_sum") > 1, F.col("Rain_mm_sum")).otherwise(F.lit(float("nan"))).alias("rain")
    )
    out = N.nan_to_null(rows)
    return B.round_all(out.withColumn("mark", F.when(F.col("rain").isNotNull(), "ok").otherwise("check")))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0), 6) AS f1,
      round(coalesce(CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) END, 0), 6) AS f2,
      round(0.6 * r + 0.4 * coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0), 6) AS composite
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS p, l_tax * 10 AS r FROM lineitem)"""
)
def f_beta_scores(t):
    p, r = F.col("l_discount") * 10, F.col("l_tax") * 10
    f1 = K.f_beta(p, r)
    return B.round_all(
        t.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", f1.alias("f1"), K.f_beta(p, r, 2.0).alias("f2"), K.recall_score_mix(r, f1).alias("composite")
        )
    )
