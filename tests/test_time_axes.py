"""File-name rules, calendars, cadence and gaps."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyloom.functions import timeaxis as ta


def dates(spark, texts):
    return ta.calendar_frame(spark, [date.fromisoformat(t) for t in texts])


def collected(frame):
    return sorted(r[0] for r in frame.collect())


def test_interior_years_are_complete(spark):
    got = collected(ta.annual_calendar(dates(spark, ["2001-01-01", "2002-01-01", "2002-01-02", "2003-01-01"])))
    assert len(got) == 367 and date(2002, 12, 31) in got


def test_step_of_a_schedule(spark):
    rows = {r.year: r for r in ta.annual_steps(dates(spark, ["2001-12-31", "2002-01-01", "2002-01-05"])).collect()}
    assert (rows[2002].step, rows[2001].step) == (4, 4)


def test_gap_is_completed(spark):
    seen = dates(spark, ["2001-01-01", "2001-01-05", "2001-01-13"])
    calendar = ta.annual_calendar(seen)
    assert [d.day for d in collected(calendar)] == [1, 5, 9, 13]
    assert collected(ta.missing_dates(calendar, seen)) == [date(2001, 1, 9)]


def test_most_common_step_when_there_is_no_divisor(spark):
    rows = ta.annual_steps(dates(spark, [f"2001-01-{d:02d}" for d in (1, 4, 7, 9, 12)])).collect()
    assert rows[0].step == 3


def test_automatic_rule():
    names = ["A.2001001.v1.nc", "A.2001005.v1.nc", "A.2001013.v1.nc"]
    assert ta.automatic_rule(names) == ta.NameRule("doy", 2, 7)
    for bad in (["a.2001001.2001001.nc", "a.2001005.2001005.nc"], ["a1.2001001.nc", "a2.2001005.nc"], ["x.nc"], ["a.2001001.nc", "ab.2001005.nc"], ["a.2001366.nc", "a.2001365.nc"]):
        with pytest.raises(ta.TimeAxisError):
            ta.automatic_rule(bad)


def test_fields_and_parts():
    fields = ta.name_fields(["lai_8-day_0.1_2001.nc", "lai_8-day_0.1_2002.nc"])
    assert [(f.sample, f.changes) for f in fields] == [("8", False), ("0", False), ("1", False), ("2001", True)]
    assert ta.field_parts("2000366") == ("full", "year", "doy") and ta.field_parts("2001366") == ()
    assert ta.field_parts("20010230") == () and ta.field_parts("367") == () and ta.field_parts("012") == ("doy",)


def test_hybrid_rule(spark):
    fields = ta.name_fields(["lai_2001.nc", "lai_2002.nc"])
    rule = ta.suggest_rule(fields, "doy")
    rows = spark.createDataFrame([("lai_2001.nc", 1), ("lai_2001.nc", 9), ("lai_2002.nc", 366)], "name string, d int")
    assert [r[0] for r in rows.select(rule.column(F.col("name"), F.col("d"))).collect()] == [date(2001, 1, 1), date(2001, 1, 9), None]
    assert ta.suggest_rule(ta.name_fields(["a20010101b", "a20010109b"]), None).sources == {"full": "name:1:8"}
    for parts in ({"full": "time", "year": "time"}, {"year": "time"}, {"year": "time", "doy": "time", "month": "time"}, {"year": "time", "month": "time"}, {"week": "time"}):
        with pytest.raises(ta.TimeAxisError):
            ta.TimeRule(parts).check()


def test_manual_rule(spark):
    rule = ta.manual_rule("a_20010203_x", "20010203")
    rows = spark.createDataFrame([("a_20010203_x",), ("a_20010230_x",)], "n string")
    assert [r[0] for r in rows.select(ta.named_date(F.col("n"), rule)).collect()] == [date(2001, 2, 3), None]
    with pytest.raises(ta.TimeAxisError):
        ta.manual_rule("a_2001001_2001001", "2001001")


def test_gaps_and_cadence(spark):
    axis = dates(spark, ["2001-01-01", "2001-01-09", "2001-01-17", "2001-02-02"])
    assert [tuple(r) for r in ta.cadence(axis).collect()] == [(8, 1, 1)]
    assert [r.missing for r in ta.gaps(axis).orderBy("before").collect()] == [7, 7, 15]


def test_decoded_and_sub_daily(spark):
    rows = spark.createDataFrame([(0,), (36,)], "v int").select(ta.decoded_time(F.col("v"), "hours since 2000-01-01 00:00:00").alias("t"))
    assert collected(rows) == [date(2000, 1, 1), date(2000, 1, 2)]
    stamps = spark.createDataFrame([("f", datetime(2001, 1, 1, 0)), ("f", datetime(2001, 1, 1, 12)), ("g", datetime(2001, 1, 1))], "path string, ts timestamp")
    assert [r.path for r in ta.sub_daily(stamps).collect()] == ["f"]
