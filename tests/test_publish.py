"""Publishing by a pointer, and polled feeds that lose and repeat nothing."""

import json

import pytest
from pyspark.sql import functions as F

from cindergrid.streaming import poll, publish


def test_failures_leave_what_is_published(spark, tmp_path):
    root = str(tmp_path / "live")
    assert publish.pointer(spark, root) is None
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    first = publish.publish(spark.range(3), root, {"age": 5})
    held = publish.published(spark, root)
    assert first["rows"] == 3 and publish.pointer(spark, root)["about"] == {"age": 5}
    bad = spark.range(9).withColumn("x", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.lit(0)))
    with pytest.raises(Exception, match="lost"):
        publish.publish(bad, root)
    assert publish.pointer(spark, root) == first and sorted(r.id for r in publish.published(spark, root).collect()) == [0, 1, 2]
    publish.publish(spark.range(10, 12), root)
    assert sorted(r.id for r in publish.published(spark, root).collect()) == [10, 11] and held.count() == 3
    assert publish.tidy(spark, root) >= 1 and publish.published(spark, root).count() == 2
    assert not [p for p in (tmp_path / "live").iterdir() if p.name.endswith(".part")]


def test_two_writers_never_mix(spark, tmp_path):
    """One writer's version is done while the other still writes; readers see one or the other."""
    root, seen = str(tmp_path / "live"), []

    def slow(rows, path):
        rows.write.parquet(path)
        publish.publish(spark.range(100, 105), root)
        seen.append(sorted(r.id for r in publish.published(spark, root).collect()))
    publish.publish(spark.range(2), root, write=slow)
    assert seen == [list(range(100, 105))] and sorted(r.id for r in publish.published(spark, root).collect()) == [0, 1]


COLUMNS = ["latitude", "longitude", "frp"]


def run(spark, tmp_path, feeds, **how):
    rows = poll.polled(spark, feeds, COLUMNS, str(tmp_path / "spool"))
    add = lambda before, batch: batch if before is None else before.unionByName(batch)
    query = publish.publish_batches(rows, str(tmp_path / "live"), str(tmp_path / "check"), how.get("merge", add), once=True)
    query.awaitTermination()


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    feeds = {"a": str(a), "b": str(b), "gone": str(tmp_path / "no.csv")}
    a.write_text("latitude,longitude,frp\n1,2,3\n4,5,\n")
    b.write_text('frp,latitude,longitude,more\n7,8,"9",x\n')
    run(spark, tmp_path, feeds)
    rows = lambda: sorted((r.feed, r.answer, r.latitude, r.frp) for r in publish.published(spark, str(tmp_path / "live")).collect())
    first = [("a", 1, "1", "3"), ("a", 1, "4", ""), ("b", 1, "8", "7")]
    assert rows() == first
    assert json.loads((tmp_path / "spool" / "STATUS").read_text()) == {"a": None, "b": None, "gone": "FileNotFoundError"}
    run(spark, tmp_path, feeds)
    assert rows() == first

    a.write_text("latitude,longitude,frp\n11,2,3\n")

    def lost(before, batch):
        raise OSError("the sink is away")
    with pytest.raises(Exception, match="away"):
        run(spark, tmp_path, feeds, merge=lost)
    assert rows() == first
    # The answer that the failed batch read has since been replaced at its source.
    a.write_text("latitude,longitude,frp\n12,2,3\n")
    run(spark, tmp_path, feeds)
    run(spark, tmp_path, feeds)
    assert rows() == sorted([*first, ("a", 2, "11", "3"), ("a", 3, "12", "3")])


def test_a_batch_counts_once(spark, tmp_path):
    """A batch whose version was published, but whose end wasn't noted, isn't merged again."""
    root = str(tmp_path / "live")
    publish.publish(spark.range(4), root, {"batch": 0})
    (tmp_path / "in").mkdir()
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    publish.publish_batches(rows, root, str(tmp_path / "check"), lambda before, batch: before.unionByName(batch)).awaitTermination()
    assert publish.published(spark, root).count() == 4
