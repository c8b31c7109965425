"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from cindergrid.functions import feed
from cindergrid.streaming.feed import Rejected
from cindergrid.sources import sinks, tables


def test_csv_in_a_box_and_between_days(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date\n39.5,-121.5,2024-07-24\n39.5,-121.5,2024-07-25\n10,-121.5,2024-07-25\n39.5,-121.5,what\n39.5,-121.5,2024-07-26\n")
    rows = tables.detections_csv(spark, str(tmp_path / "a.csv"), "latitude double, longitude double, acq_date string", (-122, 39, -121, 40), "2024-07-25", "2024-07-26")
    assert sorted(r.acq_date for r in rows.collect()) == ["2024-07-25", "2024-07-26"]


def test_bodies(spark):
    schema = spark.createDataFrame([], "a int, b string, c double").schema
    assert [tuple(r) for r in tables.csv_body(spark, "b,a\nx,1\ny,no\n", schema).collect()] == [(1, "x", None), (None, "y", None)]
    assert tables.csv_body(spark, "  \n", schema).count() == 0 and tables.csv_body(spark, "nothing here", schema).count() == 0
    assert tables.csv_body(spark, "no table\n1,2\n", schema).count() == 0
    assert [tuple(r) for r in tables.csv_body(spark, 'b,"a"\n"x, ""y""",1\n\n,2\n', schema).collect()] == [(1, 'x, "y"', None), (2, None, None)]
    with pytest.raises(Rejected, match="Invalid"):
        tables.csv_body(spark, "Invalid key, sorry", schema)


def test_layer_prunes_at_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 1.0D as lon", "50D as lat", "'x' as more").write.parquet(str(tmp_path / "pts"))
    rows = tables.layer(spark, str(tmp_path), "pts", ["id"], (10, 0, 19, 60))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 10 and "more" not in plan and "GreaterThanOrEqual(lon,10.0)" in plan


def test_only_row(spark):
    rows = spark.createDataFrame([("camp", 2018, "BTU"), ("camp", 2018, "NEU"), ("camp", 2001, "BTU")], "name string, year int, unit string")
    assert tables.only_row(rows, "name = 'camp' and year = 2018 and unit = 'BTU'").count() == 1
    for bad in ("name = 'camp' and year = 2018", "name = 'other'"):
        with pytest.raises(ValueError):
            tables.only_row(rows, bad)


def test_pages(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    for k in range(3):
        (tmp_path / "ok" / f"{k}.json").write_text(json.dumps({"features": [{"id": 2 * k}, {"id": 2 * k + 1}]}))
    assert sorted(r.id for r in tables.pages(spark, str(tmp_path / "ok"), "struct<id:int>").collect()) == list(range(6))
    (tmp_path / "ok" / "9.json").write_text(json.dumps({"error": "token expired"}))
    with pytest.raises(Exception, match="token expired"):
        tables.pages(spark, str(tmp_path / "ok"), "struct<id:int>").collect()


def test_first_of(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"a": 3}))
    read = {"remote": lambda: spark.read.json(str(tmp_path / "none")), "local": lambda: tables.document(spark, str(tmp_path / "b.json"), "a int")}
    rows, status = tables.first_of(spark, read, "a int")
    assert rows.first().a == 3 and status["source"] == "local" and status["tried"][0][0] == "remote"
    rows, status = tables.first_of(spark, {"remote": read["remote"]}, "a int")
    assert rows.count() == 0 and not status["ok"]


def test_index_without_a_message(spark):
    lines = [("f", "1:0:d=1:UGRD:10 m:anl:"), ("f", "2:500:d=1:VGRD:10 m:anl:"), ("f", "3:900:d=1:TMP:2 m:anl:"), ("f", "4:1200:d=1:GUST:surface:anl:"), ("f", "5:1500:d=1:GUST:surface:1 hour fcst:")]
    own = spark.createDataFrame(lines, "path string, line string")
    assert [(r.message, r.first, r.last) for r in tables.byte_ranges(own).orderBy("first").collect()] == [("UGRD", 0, 499), ("VGRD", 500, 899), ("GUST", 1200, 1499)]
    with pytest.raises(Exception, match="messages are missing"):
        tables.byte_ranges(own.filter("line not like '%VGRD%'")).collect()


def test_variable_name(spark):
    rows = spark.createDataFrame([('<gridDataset><grid name="wind_speed" desc="x"/></gridDataset>',), ("<none/>",)], "xml string")
    assert [r[0] for r in rows.select(tables.variable_name(F.col("xml"))).collect()] == ["wind_speed", None]


def test_writers(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id * 0.5D as v", "id % 2 as k")
    sinks.write_layers({"a": rows, "b": rows.limit(1)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 200 and spark.read.parquet(str(tmp_path / "b")).count() == 1
    sinks.write_sorted(rows, str(tmp_path / "s"), "v", by="k")
    sinks.write_compact(rows, str(tmp_path / "c"))
    assert dict(spark.read.parquet(str(tmp_path / "c")).dtypes)["v"] == "float" and spark.read.parquet(str(tmp_path / "s")).filter("k = 1").count() == 100
    sinks.write_top(rows, str(tmp_path / "t"), F.desc("v"), n=3)
    assert [r.id for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "t")).collect()] == [199, 198, 197]
    sinks.write_document(rows.agg(F.max("id").alias("n")), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().n == 199
    found = feed.normalised(spark.createDataFrame([(39.8, -121.4, "2024-07-25", "5", "n", 1.0)], "latitude double, longitude double, acq_date string, acq_time string, confidence string, frp double"), "a")
    sinks.write_features(found, str(tmp_path / "f"))
    assert json.loads(spark.read.text(str(tmp_path / "f")).first().value)["geometry"]["coordinates"] == [-121.4, 39.8]
    assert "| 199 |" in sinks.report("All", top=rows.orderBy(F.desc("id")).limit(1).select("id"))


def test_masked_before_scaled(spark):
    rows = spark.createDataFrame([(-9999.0,), (float("nan"),), (None,), (25.0,)], "v double")
    assert [r[0] for r in rows.select(tables.masked(F.col("v"), .1)).collect()] == [None, None, None, 2.5]


def test_no_machines_own_folder_on_a_cluster(spark):
    from types import SimpleNamespace as N

    from cindergrid.operators.state import shared_dir
    session = lambda master, **conf: N(conf=N(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=N(master=master))
    assert shared_dir(session("local[2]", spark_sql_warehouse_dir="file:/w")).startswith("file:/w/s-")
    assert shared_dir(session("spark://h", spark_sql_warehouse_dir="hdfs://w")).startswith("hdfs://w/s-")
    assert shared_dir(session("spark://h", spark_checkpoint_dir="file:/shared", spark_sql_warehouse_dir="file:/w")).startswith("file:/shared/s-")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://h", spark_sql_warehouse_dir="file:/w"))
