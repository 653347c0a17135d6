"""Seasonal regression and autoregressive forecasts for many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from riskgrid.functions.calendar import hour_index
from riskgrid.functions.nulls import clip
from riskgrid.operators.blend import apply_mix
from riskgrid.operators.panel import row_features
from riskgrid.operators.resample import lengthen
from riskgrid.session import cut_lineage, sized_side
from riskgrid.spec import FORECAST_BOUNDS, Panel

SERIES = ("City", "variable")


# ------------------------------------------------------------ seasonal regression


def season_terms(position: Column, period: float, order: int) -> list[Column]:
    out = []
    for k in range(1, order + 1):
        turn = F.lit(2 * math.pi * k / period) * position
        out += [F.sin(turn), F.cos(turn)]
    return out


def day_trend(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("2000-01-01").cast("date")).cast("double") / 3652.5


def day_seasons(date: str, yearly: int = 3, weekly: int = 2) -> list[Column]:
    """Fourier terms of a day's place in the year and the week."""
    day = F.datediff(F.col(date), F.lit("2000-01-01").cast("date")).cast("double")
    return [*season_terms(day, 365.25, yearly), *season_terms(day, 7.0, weekly)]


def design(date: str, yearly: int = 3, weekly: int = 2, times: bool = False) -> list[Column]:
    """Intercept, trend and Fourier terms of a day; ``times`` adds the products of trend and season."""
    trend, seasons = day_trend(date), day_seasons(date, yearly, weekly)
    return [F.lit(1.0), trend, *seasons, *([trend * s for s in seasons] if times else [])]


def hourly_design(ts_hour: Column, daily: int = 3, weekly: int = 2, yearly: int = 0) -> list[Column]:
    """Intercept, trend and Fourier terms of an hour number."""
    h = ts_hour.cast("double")
    return [F.lit(1.0), h / 8766.0, *season_terms(h, 24.0, daily), *season_terms(h, 168.0, weekly), *season_terms(h, 8766.0, yearly)]


def hours_since(time: str, origin: str = "2024-01-01 00:00:00") -> Column:
    return hour_index(time) - hour_index(F.lit(origin).cast("timestamp_ntz"))


def _solve_rows(gram: pd.Series, moment: pd.Series) -> pd.Series:
    """Least-squares coefficients of each series from its normal equations."""
    out = []
    for g, m in zip(gram, moment):
        b = np.asarray(m, dtype=float)
        k = len(b)
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = np.asarray(g, dtype=float)
        a = a + np.triu(a, 1).T
        a[np.diag_indices(k)] += 1e-9 * max(np.trace(a) / k, 1.0)
        out.append(np.linalg.solve(a, b).tolist())
    return pd.Series(out)


solve_normal = F.pandas_udf(_solve_rows, ArrayType(DoubleType()))


def seasonal_sums(long: DataFrame, columns: Sequence[Column], series: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Normal equations of each series: rows n, products g<i>_<j> of the terms and m<i> of terms and value."""
    x = [c.alias(f"x{i}") for i, c in enumerate(columns)]
    k = len(columns)
    rows = long.filter(F.col(value).isNotNull()).select(*series, F.col(value).alias("__y"), *x)
    cross = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    against = [F.sum(F.col(f"x{i}") * F.col("__y")).alias(f"m{i}") for i in range(k)]
    return rows.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), *cross, *against)


def fit_seasonal(long: DataFrame, columns: Sequence[Column], series: Sequence[str] = SERIES, value: str = "value", min_rows: int = 60) -> DataFrame:
    """Coefficients per series.

    The sums of products combine before the shuffle, so a series of any length
    reaches the solver as one small row.
    """
    k = len(columns)
    sums = seasonal_sums(long, columns, series, value).filter(F.col("n") >= min_rows)
    gram = F.array(*[F.col(f"g{i}_{j}") for i in range(k) for j in range(i, k)])
    moment = F.array(*[F.col(f"m{i}") for i in range(k)])
    return sums.select(*series, solve_normal(gram, moment).alias("beta"))


#: Most turns of a fit of trend and season.
TURNS = 200


def _solve_product(first: pd.Series, second: pd.Series, third: pd.Series, level: pd.Series, slope: pd.Series) -> pd.Series:
    """Trend and season of value = (a + b t) (1 + season), by turns: each is a linear fit while the other stays.

    With z = (1, seasons), all that either fit needs are sums of t^p z z' (p = 0, 1, 2) and t^p y z (p = 0, 1). Returned as
    coefficients of 1, t, the seasons and t times the seasons.
    """
    out = []
    for sums in zip(first, second, third, level, slope):
        m = [np.asarray(v, dtype=float) for v in sums[3:]]
        k = len(m[0])
        g = []
        for flat in sums[:3]:
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = np.asarray(flat, dtype=float)
            g.append(a + np.triu(a, 1).T)
        ridge = lambda a: a + np.eye(len(a)) * (1e-9 * max(np.trace(a) / len(a), 1e-12))
        shape, trend = np.eye(k)[0], np.zeros(2)
        for _ in range(TURNS):
            a = np.array([[shape @ g[p + q] @ shape for q in range(2)] for p in range(2)])
            trend = np.linalg.solve(ridge(a), np.array([shape @ v for v in m]))
            b = trend[0] ** 2 * g[0] + 2 * trend[0] * trend[1] * g[1] + trend[1] ** 2 * g[2]
            found = np.linalg.solve(ridge(b), trend[0] * m[0] + trend[1] * m[1])
            if abs(found[0]) < 1e-9:
                break
            trend, found = trend * found[0], found / found[0]
            settled = np.abs(found - shape).max() < 1e-12
            shape = found
            if settled:
                break
        out.append([*trend, *(trend[0] * shape[1:]), *(trend[1] * shape[1:])])
    return pd.Series(out)


solve_product = F.pandas_udf(_solve_product, ArrayType(DoubleType()))


def fit_product(long: DataFrame, trend: Column, seasons: Sequence[Column], series: Sequence[str] = SERIES, value: str = "value", min_rows: int = 60) -> DataFrame:
    """Coefficients per series of a season that multiplies the trend, see ``design(times=True)``.

    The sums that the turns of the fit need are taken once, combined before the shuffle; the turns work on them alone.
    """
    z = [F.lit(1.0), *seasons]
    k = range(len(z))
    rows = long.filter(F.col(value).isNotNull()).select(*series, F.col(value).alias("__y"), trend.alias("__t"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    power = lambda p, c: c if p == 0 else c * F.col("__t") if p == 1 else c * F.col("__t") * F.col("__t")
    cross = [F.sum(power(p, F.col(f"z{i}") * F.col(f"z{j}"))).alias(f"g{p}_{i}_{j}") for p in range(3) for i in k for j in k if i <= j]
    against = [F.sum(power(p, F.col(f"z{i}") * F.col("__y"))).alias(f"m{p}_{i}") for p in range(2) for i in k]
    sums = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), *cross, *against).filter(F.col("n") >= min_rows)
    parts = [F.array(*[F.col(f"g{p}_{i}_{j}") for i in k for j in k if i <= j]) for p in range(3)]
    parts += [F.array(*[F.col(f"m{p}_{i}") for i in k]) for p in range(2)]
    return sums.select(*series, solve_product(*parts).alias("beta"))


def apply_seasonal(long: DataFrame, fitted: DataFrame, columns: Sequence[Column], series: Sequence[str] = SERIES, name: str = "pred") -> DataFrame:
    """Add the fitted value to rows of fitted series; the fit has one row per series and is measured before the join."""
    joined = long.join(sized_side(fitted), list(series))
    total = None
    for i, c in enumerate(columns):
        term = F.col("beta")[i] * c
        total = term if total is None else total + term
    return joined.withColumn(name, total).drop("beta")


def seasonal_residuals(df: DataFrame, panel: Panel, variables: Sequence[str], yearly: int = 3, weekly: int = 2) -> DataFrame:
    """Fitted value and residual of every variable, wide; the season of rain multiplies its trend."""
    df = cut_lineage(df.select(*panel.key, *[v for v in variables if v in df.columns]))
    long = lengthen(df, panel.key, variables)
    series = (panel.entity, "variable")
    rain = F.col("variable").contains("Rain")
    fits = [fit_seasonal(long.filter(~rain), design(panel.time, yearly, weekly), series)]
    if any("Rain" in v for v in variables):
        seasons = day_seasons(panel.time, yearly, weekly)
        fits.append(fit_product(long.filter(rain), day_trend(panel.time), seasons, series))
    # one row per entity: a map from variable to coefficients
    fitted = reduce(DataFrame.unionByName, fits).groupBy(panel.entity).agg(F.map_from_entries(F.collect_list(F.struct("variable", "beta"))).alias("__fit"))
    terms = design(panel.time, yearly, weekly, times=True)
    keys, values = list(panel.key), [v for v in variables if v in df.columns]
    joined = df.select(*keys, *values, F.array(*terms).alias("__x")).join(sized_side(fitted), panel.entity)
    out = []
    for v in values:
        beta = F.col("__fit")[v]
        pred = F.aggregate(F.zip_with(beta, F.slice("__x", F.lit(1), F.size(beta)), lambda b, x: b * x), F.lit(0.0), lambda a, x: a + x)
        out += [pred.alias(f"prophet_{v}_pred"), (F.col(v) - pred).alias(f"prophet_{v}_resid")]
    return joined.select(*keys, *out)


def seasonal_forecast(df: DataFrame, panel: Panel, variables: Sequence[str], days: int = 60, yearly: int = 3, weekly: int = 2, min_rows: int = 90) -> DataFrame:
    """Fitted values for the ``days`` after each entity's last row, long."""
    long = lengthen(df, panel.key, variables)
    terms = design(panel.time, yearly, weekly)
    fitted = fit_seasonal(long, terms, (panel.entity, "variable"), min_rows=min_rows)
    last = df.groupBy(panel.entity).agg(F.max(panel.time).alias("__last"))
    steps = F.explode(F.sequence(F.date_add("__last", 1), F.date_add("__last", days), F.expr("interval 1 day"))).alias(panel.time)
    axis = last.select(panel.entity, steps)
    out = apply_seasonal(axis, fitted, terms, (panel.entity,), "value")
    return out.select(*panel.key, "variable", "value")


def seasonal_forecast_hourly(df: DataFrame, panel: Panel, variables: Sequence[str], hours: int = 336, daily: int = 3, weekly: int = 2, yearly: int = 3, min_rows: int = 720) -> DataFrame:
    """Fitted values for the ``hours`` after each entity's last row, long."""
    terms = hourly_design(hours_since(panel.time), daily, weekly, yearly)
    fitted = fit_seasonal(lengthen(df, panel.key, variables), terms, (panel.entity, "variable"), min_rows=min_rows)
    last = df.groupBy(panel.entity).agg(F.max(panel.time).alias("__last"))
    step = F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("__h")
    axis = last.select(panel.entity, "__last", step).select(panel.entity, (F.col("__last") + F.make_dt_interval(hours=F.col("__h"))).alias(panel.time))
    return apply_seasonal(axis, fitted, terms, (panel.entity,), "value").select(*panel.key, "variable", "value")


# ---------------------------------------------------------------- autoregression

AR_LAGS = (1, 2, 3, 5, 7, 14, 30)
AR_WIDTHS = (7, 14, 30)


@dataclass(frozen=True)
class Cadence:
    """What an autoregression knows of a series: lags and trailing windows in steps, and the calendar of its target."""

    lags: tuple[int, ...]
    widths: tuple[int, ...]
    calendar: tuple[str, ...]
    hourly: bool = False

    @property
    def depth(self) -> int:
        return max(*self.lags, *self.widths)

    def ahead(self, time: Column, steps: Column | int) -> Column:
        steps = F.lit(steps) if isinstance(steps, int) else steps
        return time + F.make_dt_interval(hours=steps) if self.hourly else F.date_add(time, steps)

    def target(self, time: Column) -> list[Column]:
        parts = {"doy": F.dayofyear, "month": F.month, "hour": F.hour, "weekday": F.weekday}
        return [parts[name](time).cast("double").alias(f"target_{name}") for name in self.calendar]

    def inputs(self, direct: bool = True) -> list[str]:
        rolls = [f"roll_{n}_{s}" for n in self.widths for s in ("mean", "std")]
        return [*[f"lag_{k}" for k in self.lags], *rolls, *(["horizon"] if direct else []), *[f"target_{c}" for c in self.calendar]]


BY_DAY = Cadence(AR_LAGS, AR_WIDTHS, ("doy", "month"))
BY_HOUR = Cadence((1, 3, 6, 12, 24, 48, 168), (24, 168), ("hour", "weekday", "month"), hourly=True)


def origin_features(values: DataFrame, panel: Panel, value: str, lags: Sequence[int] = AR_LAGS, widths: Sequence[int] = AR_WIDTHS) -> DataFrame:
    """What is known at the end of a row: its own and earlier values, trailing means and deviations."""

    def known(w):
        out = [F.lag(value, k - 1).over(w).alias(f"lag_{k}") for k in lags]
        for n in widths:
            frame = w.rowsBetween(1 - n, 0)
            full = F.count(value).over(frame) == n
            out.append(F.when(full, F.avg(value).over(frame)).alias(f"roll_{n}_mean"))
            out.append(F.when(full, F.stddev_samp(value).over(frame)).alias(f"roll_{n}_std"))
        return out

    return row_features(values, panel, [known], max(*lags, *widths))


def _observed(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Rows with a value: lags and windows run over what was measured, a gap costs a row and not the entity."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*panel.key, value)


def fit_direct(df: DataFrame, panel: Panel, value: str, horizons: Sequence[int] = (1, 2, 3, 5, 7, 14, 21, 30), trees: int = 20, cadence: Cadence = BY_DAY) -> PipelineModel:
    """One pooled model for all entities with the horizon as an input; no feedback loop."""
    known = origin_features(_observed(df, panel, value), panel, value, cadence.lags, cadence.widths).dropna()
    pairs = known.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    pairs = pairs.withColumn("__at", cadence.ahead(F.col(panel.time), F.col("horizon")))
    target = df.select(panel.entity, F.col(panel.time).alias("__at"), F.col(value).alias("__y"))
    rows = pairs.join(target, [panel.entity, "__at"]).filter(F.col("__y").isNotNull()).select("*", *cadence.target(F.col("__at")))
    return _fit_boosted(rows.withColumn("horizon", F.col("horizon").cast("double")), cadence.inputs(), trees)


def _fit_boosted(rows: DataFrame, inputs: Sequence[str], trees: int) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip"),
        GBTRegressor(labelCol="__y", maxIter=trees, maxDepth=5, stepSize=0.1, seed=42),
    ]
    return Pipeline(stages=stages).fit(rows)


def forecast_direct(df: DataFrame, panel: Panel, value: str, model: PipelineModel, days: int = 30, cadence: Cadence = BY_DAY) -> DataFrame:
    """All steps (days, or hours by cadence) of all entities in one transform, from each entity's last row."""
    known = origin_features(_observed(df, panel, value), panel, value, cadence.lags, cadence.widths)
    last = known.groupBy(panel.entity).agg(F.max_by(F.struct(*known.columns), panel.time).alias("r")).select("r.*").dropna()
    steps = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(days))))
    steps = steps.withColumn("__at", cadence.ahead(F.col(panel.time), F.col("horizon"))).select("*", *cadence.target(F.col("__at")))
    out = model.transform(steps.withColumn("horizon", F.col("horizon").cast("double")))
    return out.select(panel.entity, F.col("__at").alias(panel.time), F.col("prediction").alias(value))


def fit_one_step(df: DataFrame, panel: Panel, value: str, trees: int = 20, min_rows: int = 100, cadence: Cadence = BY_DAY) -> PipelineModel:
    """Pooled model of the next value; the input of ``forecast_recursive``."""
    long_enough = df.groupBy(panel.entity).agg(F.count(value).alias("__c")).filter(F.col("__c") >= min_rows).select(panel.entity)
    rows = df.join(long_enough, panel.entity, "left_semi")
    known = origin_features(_observed(rows, panel, value), panel, value, cadence.lags, cadence.widths)
    # the step's own value is the next row's newest lag, so the target is joined by time and no entity is sorted whole
    after = _observed(rows, panel, value).select(panel.entity, F.col(panel.time).alias("__at"), F.col(value).alias("__y"))
    target = known.withColumn("__at", cadence.ahead(F.col(panel.time), 1)).join(after, [panel.entity, "__at"]).dropna()
    return _fit_boosted(target.select("*", *cadence.target(F.col("__at"))), cadence.inputs(direct=False), trees)


def forecast_recursive(df: DataFrame, panel: Panel, value: str, model: PipelineModel, days: int = 30, every: int = 5, cadence: Cadence = BY_DAY) -> DataFrame:
    """Predictions fed back step by step, all entities together.

    Each entity carries its last values (30 days, 168 hours) in one short array, so a step is a
    projection and a model transform: no join, no window, no shuffle.  Lineage
    is cut every few steps through the checkpoint folder.
    """
    depth = cadence.depth
    collected = row_features(
        _observed(df, panel, value), panel, [lambda w: [F.collect_list(value).over(w.rowsBetween(1 - depth, 0)).alias("recent")]], depth
    )
    state = collected.groupBy(panel.entity).agg(F.max_by("recent", panel.time).alias("recent"), F.max(panel.time).alias("at"))
    state = state.filter(F.size("recent") == depth).withColumn("path", F.array().cast(f"array<struct<t:{df.schema[panel.time].dataType.simpleString()},v:double>>"))
    state = cut_lineage(state)
    for step in range(1, days + 1):
        state = _advance(state, panel, model, cadence)
        if step % every == 0:
            state = cut_lineage(state)
    return state.select(panel.entity, F.inline("path")).select(panel.entity, F.col("t").alias(panel.time), F.col("v").alias(value))


def _advance(state: DataFrame, panel: Panel, model: PipelineModel, cadence: Cadence) -> DataFrame:
    depth = cadence.depth
    tail = lambda n: F.slice("recent", depth - n + 1, n)
    mean = lambda n: F.aggregate(tail(n), F.lit(0.0), lambda a, x: a + x) / n
    spread = lambda n: F.sqrt(F.aggregate(tail(n), F.lit(0.0), lambda a, x: a + (x - mean(n)) * (x - mean(n))) / (n - 1))
    following = cadence.ahead(F.col("at"), 1)
    inputs = state.select(
        "*",
        *[F.element_at("recent", -k).alias(f"lag_{k}") for k in cadence.lags],
        *[e for n in cadence.widths for e in (mean(n).alias(f"roll_{n}_mean"), spread(n).alias(f"roll_{n}_std"))],
        *cadence.target(following),
    )
    out = model.transform(inputs)
    return out.select(
        panel.entity,
        F.concat(F.slice("recent", 2, depth - 1), F.array("prediction")).alias("recent"),
        following.alias("at"),
        F.concat("path", F.array(F.struct(following.alias("t"), F.col("prediction").alias("v")))).alias("path"),
    )


# ------------------------------------------------------------------- final product


def blended_forecast(pairs: DataFrame, weights: DataFrame, actual: DataFrame, panel: Panel, variable: str) -> DataFrame:
    """Blend two long forecasts of one variable, clip to physical bounds, keep steps after the last actual."""
    out = apply_mix(pairs, weights, [panel.entity], name=variable)
    low, high = FORECAST_BOUNDS.get(variable, (None, None))
    out = out.withColumn(variable, clip(variable, low, high))
    last = actual.agg(F.max(panel.time).alias("m")).scalar()
    return out.filter(F.col(panel.time) > last).select(*panel.key, variable)

