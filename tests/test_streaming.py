"""Streaming forms give what their batch forms give on a bounded input."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgrid.operators.joins import cap_by_day
from riskgrid.plans.incremental import save_by_month
from riskgrid.streaming import jobs as J
from riskgrid.workload import binding as B


@pytest.fixture(scope="module")
def tables(spark, data):
    return B.Tables(spark, data)


def as_stream(spark, df, path):
    df.repartition(4).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drain(stream, tmp_path, mode="append"):
    name = f"s{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_daily_rollup(spark, tables, tmp_path):
    readings = B.hourly_readings(tables)
    stream = J.daily_rollup(as_stream(spark, readings, str(tmp_path / "in")), delay="60 days")
    batch = J.daily_rollup(readings)
    # a long delay keeps every day open, so complete mode shows all of them
    got, want = rows(drain(stream, tmp_path, "complete"), "City", "Date"), rows(batch, "City", "Date")
    assert got == want and len(got) > 100


def test_event_labels_ignore_repeats(spark, tables, tmp_path):
    points = B.matched(tables).select("o_orderkey", "City", "acq_date", "brightness", "frp")
    twice = points.union(points)
    stream = J.event_labels(as_stream(spark, twice, str(tmp_path / "in")), ["o_orderkey", "City"], delay="4000 days")
    batch = J.event_labels(points, ["o_orderkey", "City"])
    cols = ["City", "Date", "fire_count", "max_frp"]
    assert rows(drain(stream, tmp_path, "complete").select(*cols), "City", "Date") == rows(batch.select(*cols), "City", "Date")
    known = B.fires(tables).select(*cols)
    assert rows(batch.select(*cols), "City", "Date") == rows(known, "City", "Date")


def test_anchor_stream(spark, tables, tmp_path):
    hourly, daily = B.station_risk_hourly(tables), B.station_risk_daily(tables)
    stream = J.anchored_hours(as_stream(spark, hourly, str(tmp_path / "in")), daily)
    assert rows(drain(stream, tmp_path), "City", "Timestamp") == rows(cap_by_day(hourly, daily), "City", "Timestamp")


def test_upsert_sink(spark, tmp_path):
    frame = lambda *d: spark.createDataFrame([("A", dt.date(2020, m, 1), v) for m, v in d], "City string, Date date, v double")
    save_by_month(frame((1, 1.0), (2, 2.0)), str(tmp_path / "t"))
    stream = as_stream(spark, frame((2, 20.0), (3, 3.0)), str(tmp_path / "in"))
    J.upsert_sink(stream, str(tmp_path / "t"), ["City", "Date"], str(tmp_path / "cp")).start().awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "t")).select("Date", "v"), "Date")
    assert [v for _, v in got] == [1.0, 20.0, 3.0]
    assert spark.read.parquet(str(tmp_path / "t")).filter(F.col("month") == 2).count() == 1
