"""The feed on literal rows: times, labels, duplicates, documents, sources that fail."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from cindergrid.functions import feed, times
from cindergrid.functions.exprs import confidence_label
from cindergrid.operators.windows import keep_latest
from cindergrid.streaming.feed import Rejected, exit_code, fetched, poll

RAW = "latitude double, longitude double, acq_date string, acq_time string, confidence string, frp double"


def at(*a):
    return datetime.datetime(*a)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_times_are_padded_and_bad_ones_dropped(spark):
    rows = feed.normalised(raw(spark, (39.8, -121.4, "2024-07-25", "5", "n", 1.0), (39.8, -121.4, "2024-07-25", "905", "n", 1.0), (39.8, -121.4, "2024-07-25", "1824", "n", None),
                               (39.8, -121.4, "not a day", "5", "n", 1.0), (39.8, -121.4, "2024-07-25", None, "n", 1.0), (None, -121.4, "2024-07-25", "5", "n", 1.0), (39.8, -121.4, "2024-07-25", "2561", "n", 1.0)), "a")
    assert sorted(r.t for r in rows.select(times.iso_z(F.col("acq_utc")).alias("t")).collect()) == ["2024-07-25T00:05:00Z", "2024-07-25T09:05:00Z", "2024-07-25T18:24:00Z"]
    assert all(r.is_vegetation_fire and r.source == "a" for r in rows.collect())


@pytest.mark.parametrize("value, want", [("n", "nominal"), ("H", "high"), ("l", "low"), ("30", "low"), ("31", "nominal"), ("80", "nominal"), ("81", "high"), ("abc", "unknown"), ("101", "high"), ("102", "unknown"), (None, "unknown")])
def test_confidence(spark, value, want):
    assert spark.createDataFrame([(value,)], "c string").select(confidence_label(F.col("c"))).first()[0] == want


def test_type_column(spark):
    rows = spark.createDataFrame([(39.8, -121.4, "2024-07-25", "5", "n", k) for k in (0, 2, None)], "latitude double, longitude double, acq_date string, acq_time string, confidence string, type int")
    assert {r.type: r.is_vegetation_fire for r in feed.normalised(rows, "a").collect()} == {0: True, 2: False, None: False}


def test_half_even(spark):
    got = spark.createDataFrame([(39.8125,), (39.8135,), (-39.8125,)], "v double").select(feed.rounded_half_even(F.col("v"), 3)).collect()
    assert [r[0] for r in got] == [39.812, 39.814, -39.812]


def test_keeps_the_latest_of_an_hour_and_place(spark):
    rows = feed.combined([feed.normalised(raw(spark, (39.8001, -121.4, "2024-07-25", "1800", "n", 1.0), (39.8, -121.4, "2024-07-25", "1859", "n", 2.0)), "a"), feed.normalised(raw(spark, (39.8004, -121.4, "2024-07-25", "1824", "h", 9.0), (39.8, -121.4, "2024-07-25", "1900", "n", 3.0)), "b")])
    keys = rows.withColumns({"la": feed.rounded_half_even(F.col("latitude"), 3), "lo": feed.rounded_half_even(F.col("longitude"), 3), "hr": F.date_trunc("hour", "acq_utc")})
    assert sorted(r.frp for r in keep_latest(keys, ["la", "lo", "hr"], [F.desc("acq_utc"), F.desc("source")]).collect()) == [2.0, 3.0]


def test_document(spark):
    rows = feed.normalised(raw(spark, (39.8125123, -121.4, "2024-07-25", "5", "n", float("nan")), (39.9, -121.5, "2024-07-25", "6", "h", 7.5)), "a")
    doc = json.loads(feed.collection(rows, "2024-07-25T01:00:00Z", "not official").first().document)
    assert doc["type"] == "FeatureCollection" and doc["properties"] == {"disclaimer": "not official", "generated_utc": "2024-07-25T01:00:00Z"}
    one = next(f for f in doc["features"] if f["properties"]["frp_mw"] == 0)
    assert one["geometry"] == {"type": "Point", "coordinates": [-121.4, 39.81251]} and "NaN" not in json.dumps(doc)
    with pytest.raises(ValueError, match="over 1 features"):
        feed.collection(rows, "", "", most=1)
    text = spark.createDataFrame([(json.dumps(doc),), ('{"features": []}',), ("{}",)], "document string")
    assert [(r.total, r.vegetation, r.other, r.max_frp) for r in feed.summary(text).collect()] == [(2, 2, 0, 7.5), (0, 0, 0, 0.0), (0, 0, 0, 0.0)]


def test_freshness(spark):
    now = F.lit("2024-07-25 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2024-07-25T10:45:00Z",), ("2024-07-25T10:44:00Z",), ("soon",), (None,)], "t string")
    got = rows.select(times.age_minutes(F.col("t"), now).alias("a")).select("a", times.freshness(F.col("a")).alias("s")).collect()
    assert [(r.a, r.s) for r in got] == [(75, "fresh"), (76, "stale"), (None, "unknown"), (None, "unknown")]


def test_sources_stand_alone(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("timed out")
        return raw(spark, (39.8, -121.4, "2024-07-25", "5", "n", 1.0))

    def closed():
        raise Rejected("HTTP 403 of https://host/KEY-1/area", 403)

    def down():
        raise OSError("no route")
    rows, status = poll(spark, {"flaky": flaky, "closed": closed, "down": down}, sleep=waits.append, secret="KEY-1")
    got = {r.source: (r.ok, r.rows, r.permanent) for r in status.collect()}
    assert got == {"flaky": (True, 1, False), "closed": (False, 0, True), "down": (False, 0, False)} and waits == [4.0, 8.0, 4.0, 8.0] and rows.count() == 1
    assert fetched(closed, sleep=waits.append)[0] is None and len(waits) == 4
    assert not any("KEY-1" in (r.error or "") for r in status.collect()) and status.filter("error like '%***%'").count() == 1


@pytest.mark.parametrize("error, tries, permanent", [(Rejected("HTTP 404", 404), 1, True), (Rejected("HTTP 503", 503), 3, False), (Rejected("invalid request"), 1, False), (OSError("message 401 of the feed"), 3, False), (OSError("\n"), 3, False)])
def test_errors_are_told_by_status(error, tries, permanent):
    asked = []

    def read():
        asked.append(1)
        raise error
    rows, status = fetched(read, sleep=lambda s: None, secret="")
    assert rows is None and len(asked) == tries and status["permanent"] is permanent


def test_some_source_came_beside_a_rejected_one(spark):
    status = spark.createDataFrame([("a", True, 3, None, False), ("b", False, 0, "HTTP 403", True)], "source string, ok boolean, rows long, error string, permanent boolean")
    assert exit_code(status, None) == 0 and exit_code(status.filter("not ok"), 1) == 1


@pytest.mark.parametrize("ok, permanent, age, key, want", [(False, False, 100, True, 0), (False, False, 200, True, 1), (False, False, None, True, 1), (False, True, 10, True, 1), (True, False, None, True, 0), (True, False, 1, False, 2)])
def test_exit_codes(spark, ok, permanent, age, key, want):
    status = spark.createDataFrame([("a", ok, 0, None, permanent)], "source string, ok boolean, rows long, error string, permanent boolean")
    assert exit_code(status, age, key) == want
