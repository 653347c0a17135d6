"""Readers and sinks on written files."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskgrid.plans import incremental as N
from riskgrid.sources import readers as S
from riskgrid.sources import sinks as W


def test_detection_archives_of_mixed_families(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "viirs.csv").write_text(
        "Latitude, Longitude,bright_ti4,bright_t31,acq_date,frp\n40.1,49.1,330.5,290,2020-05-01,3.5\nnorth,49,1,1,2020-05-01,1\n40.2,49.2,,291,2020-05-02,\n1,2,3,4,5,6,7,8\n"
    )
    (tmp_path / "modis.csv").write_text('acq_date,latitude,longitude,brightness,confidence\n"2020-06-01","41.0","48.0","310","80"\nbad date,41,48,300,10\n')
    (tmp_path / "readme.csv").write_text("latitude,acq_date\n9,2020-01-01\n")
    got = rows(S.normalise_detections(S.read_detections(spark, str(tmp_path))), "acq_date")
    assert got == [
        (dt.date(2020, 5, 1), 40.1, 49.1, 330.5, 3.5, None),
        (dt.date(2020, 5, 2), 40.2, 49.2, 291.0, None, None),
        (dt.date(2020, 6, 1), 41.0, 48.0, 310.0, None, "80"),
    ]
    strict = S.read_detections(spark, str(tmp_path), F.col("confidence").try_cast("int") >= 30)
    assert strict.count() == 1


def test_table_fallback_and_nan(spark, tmp_path):
    spark.createDataFrame([("2020-01-01", float("nan")), ("2020-01-02", 2.0)], "Date string, v double").write.parquet(str(tmp_path / "b"))
    got = rows(S.load_table(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["Date"]), "Date")
    assert got == [(dt.date(2020, 1, 1), None), (dt.date(2020, 1, 2), 2.0)]
    with pytest.raises(AnalysisException):
        S.load_table(spark, str(tmp_path / "a"))


def test_side_table_missing_or_malformed(spark, tmp_path):
    schema = "City string, Date string, NDVI double"
    empty = S.load_side_table(spark, str(tmp_path / "none.csv"), schema, ["Date"])
    assert empty.count() == 0 and dict(empty.dtypes)["Date"] == "date"
    (tmp_path / "v.csv").write_text("City,Date,NDVI\nA,2020-01-05,0.5\nA,oops,0.6\n")
    assert rows(S.load_side_table(spark, str(tmp_path / "v.csv"), schema, ["Date"]), "NDVI") == [("A", dt.date(2020, 1, 5), 0.5), ("A", None, 0.6)]


def test_detections_with_quoted_commas_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text('acq_date,latitude,longitude,brightness,frp,confidence\n2020-06-01,41,48,310,1,"high, nominal"\n2020-06-02,41,48,310,1,low,extra\n')
    got = rows(S.normalise_detections(S.read_detections(spark, str(tmp_path))), "acq_date")
    assert [r[-1] for r in got] == ["high, nominal", "low"]


def test_side_table_goes_by_header_names(spark, tmp_path):
    schema = "City string, Date string, NDVI double"
    (tmp_path / "v.csv").write_text("Date,NDVI,City\n2020-01-05,0.5,A\n2020-01-06,none,B\n")
    table = S.load_side_table(spark, str(tmp_path / "v.csv"), schema, ["Date"])
    assert rows(table, "City") == [("A", dt.date(2020, 1, 5), 0.5), ("B", dt.date(2020, 1, 6), None)]
    assert table.select("City").count() == table.select("NDVI").count() == 2


def test_a_broken_stored_table_is_no_missing_table(spark, tmp_path):
    (tmp_path / "t.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        S.table_exists(spark, str(tmp_path / "t.parquet"))
    with pytest.raises(Exception):
        S.load_table(spark, str(tmp_path / "t.parquet"), str(tmp_path / "t.parquet"))
    assert not S.table_exists(spark, str(tmp_path / "none"))


def test_repeated_key_in_a_batch_gives_the_last_row(spark):
    stored = spark.createDataFrame([("A", 1, 0.0, 9)], "k string, day int, v double, seq int")
    new = [("A", 1, 5.0, 1), ("A", 1, 3.0, 2), ("B", 1, 1.0, 1), ("B", 1, 2.0, 1)]
    for batch in (new, new[::-1]):
        got = N.upsert(stored, spark.createDataFrame(batch, stored.schema).repartition(3), ["k", "day"], ["seq"])
        assert rows(got, "k") == [("A", 1, 3.0, 2), ("B", 1, 2.0, 1)]


def test_cluster_without_shared_checkpoint_folder():
    from types import SimpleNamespace

    from riskgrid.session import ensure_checkpoint_dir

    seen = []
    context = lambda master: SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=seen.append)
    session = lambda master, named: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda *_: named))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session("spark://host:7077", None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session("local-cluster[2,1,1024]", None))
    ensure_checkpoint_dir(session("spark://host:7077", "hdfs://shared"))
    ensure_checkpoint_dir(session("local[2]", None))
    assert seen[0] == "hdfs://shared" and len(seen) == 2


def test_entity_cache_folder(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.datetime(2020, 1, 1), 1.0), ("B", dt.datetime(2020, 1, 1), 2.0)], "City string, Timestamp timestamp_ntz, v double")
    W.save_table(df, str(tmp_path / "c"), partition_by=["City"], sort_by=["Timestamp"])
    assert rows(S.load_entity_cache(spark, str(tmp_path / "c")).select("City", "v"), "City") == [("A", 1.0), ("B", 2.0)]


def test_records_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", "A", None), ("2020-01-02", "A", 0.5)], "date string, region string, p double")
    W.save_records(df, str(tmp_path / "r"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert '{"date":"2020-01-01","region":"A","p":null}' in lines
    array = W.records_array(df).first()["records"]
    assert array.startswith('[{"date":"2020-01-01"') and array.count("region") == 2
    W.save_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    W.save_dimension(spark, {"A": (40, 49)}, str(tmp_path / "d"))
    assert rows(spark.read.parquet(str(tmp_path / "d")), "City") == [("A", 40.0, 49.0)]


def test_upsert_rewrites_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *data: spark.createDataFrame([("A", dt.date(2020, m, d), v) for m, d, v in data], "City string, Date date, v double")
    N.save_by_month(frame((1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)), path)
    january = sorted(str(f) for f in (tmp_path / "t" / "year=2020" / "month=1").glob("*.parquet"))
    N.upsert_table(frame((2, 1, 30.0), (2, 2, 4.0), (3, 1, 5.0)), path, ["City", "Date"])
    got = rows(spark.read.parquet(path).select("Date", "v"), "Date")
    assert [v for _, v in got] == [1.0, 2.0, 30.0, 4.0, 5.0]
    assert january == sorted(str(f) for f in (tmp_path / "t" / "year=2020" / "month=1").glob("*.parquet"))


def test_append_ignores_corrections(spark):
    frame = lambda *data: spark.createDataFrame([("A", dt.date(2020, 1, d), v) for d, v in data], "City string, Date date, v double")
    stored, new = frame((1, 1.0), (5, 5.0)), frame((4, 40.0), (6, 6.0))
    assert [v for _, _, v in rows(N.append_after(stored, new, "Date", ["City", "Date"]), "Date")] == [1.0, 5.0, 6.0]
    assert [v for _, _, v in rows(N.upsert(stored, new, ["City", "Date"]), "Date")] == [1.0, 40.0, 5.0, 6.0]
