"""A versioned table: readers see a whole version before, during and after a commit."""

import datetime

import pytest

from riskgrid.plans.versions import Conflict, Table

DAY = datetime.date


def frame(spark, rows):
    return spark.createDataFrame(rows, "City string, Date date, v int")


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_makes_a_new_version(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    first = [("A", DAY(2024, 1, 5), 1), ("A", DAY(2024, 2, 5), 2), ("B", DAY(2024, 2, 6), 3), ("C", None, 4)]
    assert table.upsert(frame(spark, first), ["City", "Date"]) == 1
    before = table.months()
    reader = table.read()  # a reader that began before the commit
    assert table.upsert(frame(spark, [("A", DAY(2024, 2, 5), 9), ("D", DAY(2024, 3, 1), 5)]), ["City", "Date"]) == 2
    assert values(reader) == values(table.read(1)) == values(frame(spark, first))
    assert values(table.read()) == values(frame(spark, [first[0], ("A", DAY(2024, 2, 5), 9), *first[2:], ("D", DAY(2024, 3, 1), 5)]))
    after = table.months()
    assert after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"] and set(after) == {"2024-01", "2024-02", "2024-03", "none"}
    assert values(table.read(months=["2024-03"])) == [("D", DAY(2024, 3, 1), 5)]


def test_half_a_commit_is_not_seen(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("A", DAY(2024, 1, 5), 1)]))
    monkeypatch.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(frame(spark, [("A", DAY(2024, 1, 5), 7)]), ["City", "Date"])
    assert table.version() == 1 and values(table.read()) == [("A", DAY(2024, 1, 5), 1)]


def test_two_writers(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("A", DAY(2024, 1, 5), 1)]))
    other = Table(spark, str(tmp_path / "t"))
    written = other._write(frame(spark, [("A", DAY(2024, 1, 5), 2)]))
    table.upsert(frame(spark, [("B", DAY(2024, 1, 6), 3)]), ["City", "Date"])
    with pytest.raises(Conflict):
        other._commit(2, {"schema": None, "months": written})
    assert values(table.read()) == [("A", DAY(2024, 1, 5), 1), ("B", DAY(2024, 1, 6), 3)]
