"""Window operators over entity-time panels.

Two physical forms share one definition of every feature:

* plain: one window per entity.  Right for calendar-bounded panels.
* chunked (``Panel.chunk`` set): each entity is cut into blocks.  Frames of
  bounded length see a halo of the preceding rows (``row_features``); frames
  that reach back to the first row use a two-level prefix (``running``), where
  only one summary row per chunk is ordered across the whole entity.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from riskgrid.functions.nulls import present
from riskgrid.spec import EVENT_WINDOWS, LABEL, Panel

Builder = Callable[[WindowSpec], list[Column]]
BLOCK_ROWS = 4096

_CHUNK, _N, _BLOCK, _OWN = "__chunk", "__n", "__block", "__own"


# ---------------------------------------------------------------- prefix form

_PREFIX = {
    "sum": F.sum,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull() & local.isNull(), F.lit(None)).otherwise(
            F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "max":
        return F.greatest(before, local)
    return F.coalesce(local, before)


def _time_order(panel: Panel, backwards: bool) -> Column:
    return F.col(panel.time).desc() if backwards else F.col(panel.time).asc()


def running(
    df: DataFrame,
    panel: Panel,
    items: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backwards: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add running aggregates over all earlier rows of the entity.

    ``items`` maps a new column to ``(kind, expression)`` with kind "sum",
    "max" or "last" (last non-null).  ``backwards`` runs from the last row to
    the first, ``by`` adds partition columns below the entity.
    """
    keys = [panel.entity, *by]
    end = 0 if inclusive else -1
    if panel.chunk is None:
        w = Window.partitionBy(*keys).orderBy(_time_order(panel, backwards)).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_PREFIX[k](c).over(w).alias(n) for n, (k, c) in items.items()])

    df = df.withColumn(_CHUNK, F.to_date(F.date_trunc(panel.chunk, F.col(panel.time))))
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(_time_order(panel, backwards))
    inner = inner.rowsBetween(Window.unboundedPreceding, end)
    local = df.select("*", *[_PREFIX[k](c).over(inner).alias(f"__l_{n}") for n, (k, c) in items.items()])

    # "last" over an unordered group would be arbitrary, so summaries take the value at the extreme time
    at = F.col(panel.time)
    summaries = []
    for n, (k, c) in items.items():
        if k == "last":
            pick = F.min_by if backwards else F.max_by
            summaries.append(pick(c, F.when(c.isNotNull(), at)).alias(n))
        else:
            summaries.append(_PREFIX[k](c).alias(n))
    chunk_order = F.col(_CHUNK).desc() if backwards else F.col(_CHUNK).asc()
    outer = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys, _CHUNK)
        .agg(*summaries)
        .select(*keys, _CHUNK, *[_PREFIX[k](F.col(n)).over(outer).alias(f"__b_{n}") for n, (k, _) in items.items()])
    )
    joined = local.join(totals, [*keys, _CHUNK], "left")
    keep = [c for c in df.columns if c != _CHUNK]
    return joined.select(
        *keep, *[_combine(k, F.col(f"__b_{n}"), F.col(f"__l_{n}")).alias(n) for n, (k, _) in items.items()]
    )


def row_index(df: DataFrame, panel: Panel, name: str = _N) -> DataFrame:
    """Number the rows of each entity 1, 2, 3, ... in time order."""
    return running(df, panel, {name: ("sum", F.lit(1).cast("bigint"))})


# ------------------------------------------------------------------ halo form


def row_features(df: DataFrame, panel: Panel, builders: Sequence[Builder], lookback: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add columns computed over row frames that reach back at most ``lookback`` rows.

    All builders are evaluated over the same window, hence share one exchange
    and one sort.  In chunked form a row near the end of its block is also sent
    to the next block, where it only serves as history.
    """
    if panel.chunk is None:
        return _built(df, builders, panel.window(), df.columns)
    block_rows = max(block_rows, lookback)
    position = F.pmod(F.col(_N) - 1, F.lit(block_rows))
    home = F.floor((F.col(_N) - 1) / block_rows)
    spread = (
        row_index(df, panel)
        .withColumn("__home", home)
        .withColumn(
            _BLOCK,
            F.explode(
                F.when(position >= block_rows - lookback, F.array(F.col("__home"), F.col("__home") + 1)).otherwise(
                    F.array(F.col("__home"))
                )
            ),
        )
        .withColumn(_OWN, F.col(_BLOCK) == F.col("__home"))
    )
    w = Window.partitionBy(panel.entity, _BLOCK).orderBy(_N)
    return _built(spread, builders, w, [*df.columns, _OWN]).filter(F.col(_OWN)).drop(_OWN)


def _built(df: DataFrame, builders: Sequence[Builder], w: WindowSpec, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[c for b in builders for c in b(w)])


def lags(variables: Sequence[str], steps: Sequence[int], unit: str = "") -> Builder:
    return lambda w: [F.lag(v, k).over(w).alias(f"{v}_lag{k}{unit}") for v in variables for k in steps]


def rolls(variables: Sequence[str], widths: Sequence[int], full_only: bool = False, unit: str = "") -> Builder:
    """Mean and sample standard deviation of the rows before the current one.

    ``full_only`` yields null until the frame holds ``width`` values.
    """

    def build(w: WindowSpec) -> list[Column]:
        out = []
        for n in widths:
            frame = w.rowsBetween(-n, -1)
            for v in variables:
                mean, sd = F.avg(v).over(frame), F.stddev_samp(v).over(frame)
                if full_only:
                    complete = F.count(v).over(frame) == n
                    mean, sd = F.when(complete, mean), F.when(complete, sd)
                out += [mean.alias(f"{v}_roll{n}{unit}_mean"), sd.alias(f"{v}_roll{n}{unit}_std")]
        return out

    return build


def trailing_sum(value: str, width: int, name: str, include_current: bool = False) -> Builder:
    ends = (1 - width, 0) if include_current else (-width, -1)
    return lambda w: [F.sum(value).over(w.rowsBetween(*ends)).alias(name)]


def trailing_mean(value: str, width: int, name: str, include_current: bool = False) -> Builder:
    ends = (1 - width, 0) if include_current else (-width, -1)
    return lambda w: [F.avg(value).over(w.rowsBetween(*ends)).alias(name)]


def event_counts(label: str = LABEL, widths: Sequence[int] = EVENT_WINDOWS) -> Builder:
    return lambda w: [F.sum(label).over(w.rowsBetween(-n, -1)).cast("double").alias(f"fire_count_{n}d") for n in widths]


def add_lags(df: DataFrame, panel: Panel, variables: Sequence[str], steps: Sequence[int]) -> DataFrame:
    return row_features(df, panel, [lags(present(df, variables), steps)], max(steps))


def add_rolls(df: DataFrame, panel: Panel, variables: Sequence[str], widths: Sequence[int], full_only: bool = False) -> DataFrame:
    return row_features(df, panel, [rolls(present(df, variables), widths, full_only)], max(widths))


def every_nth(df: DataFrame, panel: Panel, n: int) -> DataFrame:
    """First row of each entity and every n-th row after it."""
    return row_index(df, panel).filter(F.pmod(F.col(_N) - 1, F.lit(n)) == 0).drop(_N)


# ------------------------------------------------------- unbounded-frame features


def dry_streak(df: DataFrame, panel: Panel, rain: str = "Rain_mm_sum", below: float = 0.1, name: str = "dry_days_streak") -> DataFrame:
    """Length of the run of dry rows ending at each row; 0 on a wet row."""
    numbered = row_index(df, panel)
    wet_at = F.when(F.coalesce(F.col(rain) < below, F.lit(False)), F.lit(None)).otherwise(F.col(_N))
    out = running(numbered, panel, {"__wet": ("max", wet_at)})
    streak = (F.col(_N) - F.coalesce(F.col("__wet"), F.lit(0))).cast("int")
    return out.select(*df.columns, streak.alias(name))


def rows_since_event(
    df: DataFrame, panel: Panel, label: str = LABEL, cap: int = 365, name: str = "days_since_last_fire"
) -> DataFrame:
    """Rows since the previous event, at most ``cap``; ``cap`` when there was none."""
    numbered = row_index(df, panel)
    hit = F.when(F.col(label) == 1, F.col(_N))
    out = running(numbered, panel, {"__hit": ("max", hit)}, inclusive=False)
    since = F.least(F.coalesce(F.col(_N) - F.col("__hit"), F.lit(cap)), F.lit(cap)).cast("int")
    return out.select(*df.columns, since.alias(name))


def event_rate_so_far(
    df: DataFrame, panel: Panel, label: str = LABEL, name: str = "city_fire_rate", by: Sequence[str] = ()
) -> DataFrame:
    """Share of event rows among all earlier rows of the entity (and ``by``); 0 at the start."""
    y = F.col(label).cast("double")
    out = running(
        df,
        panel,
        {"__s": ("sum", y), "__c": ("sum", F.when(y.isNotNull(), F.lit(1)).otherwise(F.lit(0)))},
        inclusive=False,
        by=by,
    )
    return out.select(*df.columns, F.coalesce(F.try_divide(F.col("__s"), F.col("__c")), F.lit(0.0)).alias(name))


def fill_gaps(df: DataFrame, panel: Panel, columns: Sequence[str], backward: bool = True) -> DataFrame:
    """Carry the last known value forward, then the first known value back, inside each entity."""
    columns = present(df, columns)
    if not columns:
        return df
    out = running(df, panel, {f"__f_{c}": ("last", F.col(c)) for c in columns})
    if backward:
        out = running(out, panel, {f"__k_{c}": ("last", F.col(c)) for c in columns}, backwards=True)
    filled = {c: F.coalesce(f"__f_{c}", f"__k_{c}") if backward else F.col(f"__f_{c}") for c in columns}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def event_history(df: DataFrame, panel: Panel, label: str = LABEL, month: str = "Month") -> DataFrame:
    """Counts of recent events, rows since the last one, and the two rates so far."""
    out = row_features(df, panel, [event_counts(label)], max(EVENT_WINDOWS))
    out = rows_since_event(out, panel, label)
    out = event_rate_so_far(out, panel, label, "city_month_fire_rate", by=[month])
    return event_rate_so_far(out, panel, label, "city_fire_rate")


# ------------------------------------------------------------- rows per entity


def latest_per_entity(df: DataFrame, panel: Panel) -> DataFrame:
    """The last row of each entity, as one aggregate (no sort, combines before the shuffle)."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(panel.entity).alias("__e")).agg(F.max_by(row, F.col(panel.time)).alias("r")).select("r.*")


def first_per_entity(df: DataFrame, panel: Panel) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(F.col(panel.entity).alias("__e")).agg(F.min_by(row, F.col(panel.time)).alias("r")).select("r.*")


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``.

    ``order`` must be total within a key for a repeatable choice.  As an
    aggregate it combines before the shuffle, so many copies of one key do not
    meet in one task.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    pick = F.max_by if last else F.min_by
    names = [f"__k{i}" for i in range(len(key))]
    grouped = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)])
    return grouped.agg(pick(F.struct(*df.columns), rank).alias("r")).select("r.*")


def comparable(df: DataFrame) -> list[str]:
    """Columns that have an order (all but maps and variants, also nested ones)."""
    return [c for c, kind in df.dtypes if not re.search(r"\b(map<|variant\b|interval\b)", kind)]


def overlay(base: DataFrame, newer: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union by name where rows of ``newer`` replace rows of ``base`` with the same key.

    Of several rows of the same side and key the last by ``order`` stays, then the last by all columns: which one
    never depends on the order in which rows arrive.
    """
    both = base.withColumn("__src", F.lit(0)).unionByName(newer.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, key, ["__src", *order, *comparable(both)]).drop("__src")


# -------------------------------------------------------------- decomposition


def seasonal_parts(df: DataFrame, panel: Panel, value: str, period: int = 365) -> DataFrame:
    """Additive trend, season and residual for an odd ``period``.

    Trend is the centred mean over a full period (null at both ends), season
    the mean detrended value per phase shifted to average zero.
    """
    half = period // 2
    w = panel.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # a centred frame as the difference of two running sums: constant work per row, whatever the period
    sums = df.select(
        "*",
        F.row_number().over(w).alias("__rn"),
        F.sum(F.col(value)).over(so_far).alias("__sum"),
        F.count(F.col(value)).over(so_far).alias("__cnt"),
    )
    within = lambda c: F.lead(c, half).over(w) - F.coalesce(F.lag(c, half + 1).over(w), F.lit(0))
    full = (F.col("__rn") > half) & (within("__cnt") == period)
    base = sums.select(
        "*", F.when(full, within("__sum") / period).alias("trend"), F.pmod(F.col("__rn") - 1, F.lit(period)).alias("__phase")
    )
    per_phase = base.groupBy(panel.entity, "__phase").agg(F.avg(F.col(value) - F.col("trend")).alias("__raw"))
    centred = per_phase.select(
        panel.entity,
        "__phase",
        (F.col("__raw") - F.avg("__raw").over(Window.partitionBy(panel.entity))).alias("seasonal"),
    )
    return (
        base.join(centred, [panel.entity, "__phase"], "left")
        .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
        .select(*df.columns, "trend", "seasonal", "resid")
    )
