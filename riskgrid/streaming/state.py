"""Streaks and days since the last event as keyed state of a stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What ``transformWithState`` keeps its state in; the session must name it in ``spark.sql.streaming.stateStore.providerClass``.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)


class Streaks(StatefulProcessor):
    """One entity's days: they wait until the watermark has passed them, then are counted in order.

    State is what the order needs: the number of days so far, the last wet one and the last with an event, and the days that
    wait. A timer for each waiting day wakes the entity.
    """

    def __init__(self, entity: str, below: float, cap: int):
        self.entity, self.below, self.cap = entity, below, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "rain double, event int")
        self.seen = handle.getValueState("seen", "days long, wet long, event long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, rain, event in zip(frame["Date"], frame["rain"], frame["event"]):
                number = (pd.Timestamp(day).date() - EPOCH).days
                value = (None if pd.isna(rain) else float(rain), 0 if pd.isna(event) else int(event))
                self.waiting.updateValue((number,), value)
                self.handle.registerTimer(number * 86_400_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if k[0] <= last)
        days, wet, hit = self.seen.get() if self.seen.exists() else (0, 0, -1)
        out = []
        for day, (rain, event) in due:
            days += 1
            if rain is None or rain >= self.below:
                wet = days
            since = self.cap if hit < 0 else min(days - hit, self.cap)
            out.append((key[0], EPOCH + dt.timedelta(days=day), days - wet, since))
            if event == 1:
                hit = days
            self.waiting.removeKey((day,))
        self.seen.update((days, wet, hit))
        if out:
            yield pd.DataFrame(out, columns=[self.entity, "Date", "dry_days_streak", "days_since_last_fire"])

    def close(self) -> None:
        pass


def streaks(stream: DataFrame, delay: str = "3 days", entity: str = "City", date: str = "Date", rain: str = "Rain_mm_sum", label: str = "Fire_Occurred", below: float = 0.1, cap: int = 365) -> DataFrame:
    """``dry_days_streak`` and ``days_since_last_fire`` of a stream of daily rows, as ``panel.dry_streak`` and ``rows_since_event``.

    A day is counted when the watermark (the latest day less ``delay``) has passed it, so days of an entity may come in any
    order within the delay; later ones are dropped. A day that comes twice before that counts once, the later row. An
    entity's state is three numbers and the days within the delay. Needs the state store of ``PROVIDER``.
    """
    rows = stream.select(entity, F.col(date).cast("date").alias("Date"), F.col(rain).cast("double").alias("rain"), F.col(label).cast("int").alias("event"), F.col(date).cast("timestamp").alias("at"))
    kind = stream.schema[entity].dataType.simpleString()
    return rows.withWatermark("at", delay).groupBy(entity).transformWithStateInPandas(
        statefulProcessor=Streaks(entity, below, cap),
        outputStructType=f"{entity} {kind}, Date date, dry_days_streak int, days_since_last_fire int",
        outputMode="Append",
        timeMode="EventTime",
    )
