"""Keyed joins: labels, sparse series, lookups, anchors, completion.

A side is broadcast only after its size was checked (by adaptive execution or
``sized_side``); beyond it the join falls back to a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskgrid.functions.nulls import present
from riskgrid.functions.risk import anchored
from riskgrid.operators.panel import fill_gaps, latest_per_entity
from riskgrid.session import sized_side
from riskgrid.spec import Panel


def attach(df: DataFrame, side: DataFrame, on: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Left equi join; ``fill`` gives values for unmatched side columns."""
    out = df.join(side, list(on), "left")
    return out.fillna(fill) if fill else out


def attach_daily(df: DataFrame, daily: DataFrame, entity: str = "City", ts: str = "Timestamp", fill: dict | None = None) -> DataFrame:
    """Give every hour the values of its day.

    The daily side has one row per place and day; it is measured, and while it is small the hours are not shuffled.
    """
    out = df.withColumn("Date", F.to_date(ts)).join(sized_side(daily), [entity, "Date"], "left")
    return out.fillna(fill) if fill else out


def attach_sparse(df: DataFrame, side: DataFrame, panel: Panel, columns: Sequence[str], off_grid: bool = False) -> DataFrame:
    """Last known value of a sparse series, or the first known one before it starts.

    By default only observations on a panel row count.  ``off_grid`` also merges
    those that fall between panel rows into the time axis before filling.
    """
    columns = present(side, columns)
    series = side.select(*panel.key, *columns)
    on_grid = df.join(series, panel.key, "left")
    if not off_grid:
        return fill_gaps(on_grid, panel, columns)
    extra = series.join(df.select(*panel.key), panel.key, "left_anti")
    merged = on_grid.withColumn("__own", F.lit(1)).unionByName(extra.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    return fill_gaps(merged, panel, columns).filter(F.col("__own") == 1).drop("__own")


def attach_with_fallback(df: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where a column both sides have keeps its own value and falls back to the side's."""
    shared = [c for c in side.columns if c in df.columns and c not in on]
    renamed = side.select(*[F.col(c).alias(f"__s_{c}") if c in shared else F.col(c) for c in side.columns])
    out = df.join(renamed, list(on), "left")
    new = [c for c in side.columns if c not in df.columns]
    return out.select(*[F.coalesce(c, f"__s_{c}").alias(c) if c in shared else F.col(c) for c in df.columns], *new)


def attach_latest(df: DataFrame, history: DataFrame, panel: Panel, columns: Sequence[str]) -> DataFrame:
    """Add the values of each entity's last history row."""
    use = present(history, columns)
    last = latest_per_entity(history.select(*panel.key, *use), panel).drop(panel.time)
    return df.join(last, panel.entity, "left")


def last_known(history: DataFrame, panel: Panel, columns: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per entity."""
    at = F.col(panel.time)
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in present(history, columns)]
    return history.groupBy(panel.entity).agg(*picks)


def cap_by_day(
    hourly: DataFrame, daily: DataFrame, p: str = "probability", daily_p: str = "probability", entity: str = "City", ts: str = "Timestamp"
) -> DataFrame:
    """Cap hourly probabilities by the daily one of the same entity and day, matched by key."""
    caps = daily.select(entity, F.col("Date").alias("__day"), F.col(daily_p).alias("__daily"))
    return (
        hourly.withColumn("__day", F.to_date(ts))
        .join(caps, [entity, "__day"], "left")
        .withColumn(p, anchored(p, "__daily"))
        .select(*hourly.columns)
    )


def missing_entities(required: DataFrame, present_rows: DataFrame, entity: str = "City") -> DataFrame:
    return required.select(entity).distinct().join(present_rows.select(entity).distinct(), entity, "left_anti")


def _copies(rows: DataFrame, names: DataFrame, entity: str, salts: int = 32) -> DataFrame:
    """Every row once per name; the names are dealt over ``salts`` keys so the work spreads."""
    dealt = names.select(entity).distinct().withColumn("__salt", F.pmod(F.xxhash64(entity), F.lit(salts)))
    spread = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return spread.join(dealt, "__salt").drop("__salt")


def complete_entities(df: DataFrame, required: DataFrame, entity: str = "City") -> DataFrame:
    """Give entities without rows a copy of the rows of the alphabetically first present entity."""
    template = df.filter(F.col(entity) == df.agg(F.min(entity).alias("m")).scalar()).drop(entity)
    copies = _copies(template, missing_entities(required, df, entity), entity)
    return df.unionByName(copies.select(*df.columns))


def replicate_to_entities(df: DataFrame, entities: DataFrame, entity: str = "City") -> DataFrame:
    """One copy of an entity-less forecast per entity."""
    return _copies(df, entities, entity)


def placeholder_rows(df: DataFrame, required: DataFrame, entity: str = "City", value: float = 0.0) -> DataFrame:
    """Add a constant row for every required entity the table lacks."""
    types = dict(df.dtypes)
    constants = [F.lit(value).cast(types[c]).alias(c) for c in df.columns if c != entity]
    return df.unionByName(missing_entities(required, df, entity).select(entity, *constants))


def keep_times_of(df: DataFrame, horizon: DataFrame, panel: Panel) -> DataFrame:
    """Rows whose key occurs in the horizon."""
    return df.join(horizon.select(*panel.key), panel.key, "left_semi")


def history_tail(history: DataFrame, horizon: DataFrame, panel: Panel, span: str = "45 days") -> DataFrame:
    """History rows from ``span`` before each entity's first horizon step on."""
    start = horizon.groupBy(panel.entity).agg(F.min(panel.time).alias("__start"))
    return (
        history.join(start, panel.entity)
        .filter(F.col(panel.time) >= F.col("__start") - F.expr(f"interval {span}"))
        .drop("__start")
    )


def split_holdout(df: DataFrame, time: str, span: str) -> DataFrame:
    """Mark rows later than ``max(time) - span`` as hold-out."""
    last = df.agg(F.max(time).alias("m")).scalar()
    part = F.when(F.col(time) <= last - F.expr(f"interval {span}"), "train").otherwise("holdout")
    return df.withColumn("part", part)


def after_last_actual(forecast: DataFrame, actual: DataFrame, time: str) -> DataFrame:
    """Forecast rows later than the newest actual row."""
    return forecast.filter(F.col(time) > actual.agg(F.max(time).alias("m")).scalar())
