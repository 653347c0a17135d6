"""Keyed state of a stream gives what the batch operators give."""

import datetime as dt
import random

from conftest import rows

from riskgrid.operators import panel as P
from riskgrid.spec import DAILY
from riskgrid.streaming.state import PROVIDER, streaks


def test_streaks_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    start = dt.date(2024, 1, 1)
    days = [(c, start + dt.timedelta(days=d), rng.choice([None, 0.0, 0.0, 0.0, 0.05, 3.0]), int(rng.random() < 0.1)) for c in ("A", "B") for d in range(60) if (c, d) != ("B", 7)]
    columns = "City string, Date date, Rain_mm_sum double, Fire_Occurred int"
    # in three deliveries, the days out of order within each; a far day lets the watermark pass all others
    for k in range(3):
        part = [r for r in days if k * 20 <= (r[1] - start).days < (k + 1) * 20]
        rng.shuffle(part)
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for far in (False, True):
            if far:
                spark.createDataFrame([("Z", dt.date(2030, 1, 1), 0.0, 0)], columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = streaks(stream, delay="30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = rows(spark.read.parquet(str(tmp_path / "out")), "City", "Date")
    batch = spark.createDataFrame(days, columns)
    want = P.rows_since_event(P.dry_streak(batch, DAILY), DAILY).select("City", "Date", "dry_days_streak", "days_since_last_fire")
    assert got == rows(want, "City", "Date") and len(got) == 119
