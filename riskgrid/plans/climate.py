"""Forecast against last year, against a decade, and long-term trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.operators.stats import linear_trend
from riskgrid.spec import LABEL


def horizon_bounds(risk: DataFrame) -> Column:
    return risk.agg(F.struct(F.min("Date").alias("lo"), F.max("Date").alias("hi")).alias("b")).scalar()


def same_dates_last_year(history: DataFrame, risk: DataFrame) -> DataFrame:
    b = horizon_bounds(risk)
    return history.filter(F.col("Date").between(F.add_months(b.getField("lo"), -12), F.add_months(b.getField("hi"), -12)))


def same_months(history: DataFrame, risk: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Rows of the given years in the months the forecast covers (also across New Year)."""
    months = risk.select(F.month("Date").alias("__m")).distinct()
    dated = history.filter(F.year("Date").between(*years)).withColumn("__m", F.month("Date"))
    return dated.join(months, "__m", "left_semi").drop("__m")


def compare_means(risk: DataFrame, other: DataFrame, value: str, name: str, diff: str, entity: str = "City") -> DataFrame:
    ahead = risk.groupBy(entity).agg(F.avg(value).alias("Forecast"))
    past = other.groupBy(entity).agg(F.avg(value).alias(name))
    both = ahead.join(past, entity).dropna()
    return both.withColumn(diff, F.col("Forecast") - F.col(name))


def hotter_share(comparison: DataFrame, diff: str = "Diff") -> DataFrame:
    return comparison.agg(F.count_if(F.col(diff) > 0).alias("hotter"), F.count(F.lit(1)).alias("places"), F.avg(diff).alias("mean_diff"))


def complete_years(history: DataFrame, date: str = "Date") -> DataFrame:
    """Without a first or last calendar year that is only partly covered."""
    b = history.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("b")).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    first = F.when(F.dayofyear(lo) == 1, F.year(lo)).otherwise(F.year(lo) + 1)
    last = F.when(F.month(F.date_add(hi, 1)) == 1, F.when(F.dayofmonth(F.date_add(hi, 1)) == 1, F.year(hi)).otherwise(F.year(hi) - 1)).otherwise(
        F.year(hi) - 1
    )
    return history.filter(F.year(date).between(first, last))


def yearly_signals(history: DataFrame, hot_above: float = 35.0, entity: str = "City") -> DataFrame:
    """Yearly mean temperature, hot days, rain per place and events, in one aggregate."""
    return history.groupBy(F.year("Date").alias("Year")).agg(
        F.avg("Temperature_C_mean").alias("temperature"),
        F.count_if(F.col("Temperature_C_max") > hot_above).alias("hot_days"),
        (F.sum("Rain_mm_sum") / F.countDistinct(entity)).alias("rain"),
        F.sum(LABEL).alias("events"),
    )


def climate_trends(history: DataFrame, hot_above: float = 35.0, complete_years_only: bool = False) -> DataFrame:
    """Slope per year of the four yearly signals."""
    signals = yearly_signals(complete_years(history) if complete_years_only else history, hot_above)
    names = ["temperature", "hot_days", "rain", "events"]
    long = signals.select("Year", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("Year", names, "signal", "value")
    return linear_trend(long, "Year", "value", ["signal"])


def risk_comparison(risk: DataFrame, history: DataFrame, years: tuple[int, int], p: str = "fire_probability", entity: str = "City") -> DataFrame:
    """Forecast risk beside last year's and the decade's event rate."""
    rate = lambda df, name: df.groupBy(entity).agg(F.avg(LABEL).alias(name))
    ahead = risk.groupBy(entity).agg(F.avg(p).alias("Forecast_Risk"))
    out = (
        ahead.join(rate(same_dates_last_year(history, risk), "LastYear"), entity)
        .join(rate(same_months(history, risk, years), "Decade"), entity)
        .dropna()
    )
    return out.withColumns({"vs_LY": F.col("Forecast_Risk") - F.col("LastYear"), "vs_Dec": F.col("Forecast_Risk") - F.col("Decade")})


def summary_table(comparison: DataFrame, entity: str = "City") -> DataFrame:
    """Percentages with one digit."""
    pct = lambda c, n: (F.round(F.col(c) * 100, 1) + 0.0).alias(n)
    return comparison.select(entity, pct("Forecast_Risk", "Risk_%"), pct("vs_LY", "vs_LY_%"), pct("vs_Dec", "vs_Dec_%"))


def largest(df: DataFrame, by: str, n: int = 5, entity: str = "City") -> DataFrame:
    return df.orderBy(F.desc(by), entity).limit(n)
