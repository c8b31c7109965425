"""Large groups of equal rows and long ranges: each of these took time that grew with the square of its rows, or never ended. Jobs are cancelled after a while."""

import threading

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import geometry, joins, polygons, sampling, spread


@pytest.fixture(autouse=True)
def limit(spark):
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


@pytest.mark.parametrize("cutoff", [None, 3.0])
def test_many_rows_at_few_places(spark, cutoff):
    """F8, F10: 120,000 places of two kinds and as many points of two kinds."""
    asks = spark.range(120_000).selectExpr("id as a", "cast(id % 2 as double) as x", "0.0 as y")
    points = spark.range(120_000).selectExpr("id + 5 as p", "1.5 + id % 2 as x", "0.0 as y")
    got = joins.nearest_points(asks, points, "a", "p", "x", "y", 4.0, cutoff).groupBy("p", "distance").count().collect()
    assert sorted(map(tuple, got)) == [(5, .5, 60_000), (5, 1.5, 60_000)]


def test_points_of_a_dense_plane(spark):
    """F8: the reach given would put all points into few squares."""
    rows = spark.range(90_000).selectExpr("id", "id % 300 + 0.25 as x", "cast(id div 300 as double) as y")
    got = joins.nearest_points(rows.withColumnRenamed("id", "a"), rows.select(F.col("id").alias("p"), (F.col("x") + .25).alias("x"), "y"), "a", "p", "x", "y", 1000.0)
    assert got.filter("a = p and distance = 0.25").count() == 90_000 == got.count()


def test_axis_in_one_bin(spark):
    """asks that all lie within a width of 1000."""
    asks = spark.range(200_000).selectExpr("id as a", "id / 1000.0 as v").withColumn("v", F.col("v").cast("double"))
    points = spark.range(100_001).selectExpr("cast(id * 2 / 1000.0 as double) as w")
    got = joins.nearest_on_axis(asks, points, "v", "w")
    assert got.count() == 200_000
    # Odd ones lie between two points, and the smaller is taken up to the last digits of their distances.
    assert got.filter("a % 2 = 0 and nearest <> v or abs(nearest - v) > 0.00100001").count() == 0


def test_draws_that_are_used_up(spark):
    """more controls are wanted than there are pairs of draws."""
    cases = spark.createDataFrame([(3, "2024-01-02")], "cell long, day string").withColumn("day", F.to_date("day"))
    got = sampling.controls(cases, 2000, "2024-01-01", 1000, ratio=990_000)
    assert got.count() == got.distinct().count() == 990_000
    assert 500_000 < sampling.controls(cases, 2000, "2024-01-01", 1000, ratio=990_000, grow=False).count() < 990_000


def test_a_step_reads_edges_near_what_burns(spark, monkeypatch):
    """of a chain of 40,000 cells a step reads what lies between its burning cells."""
    read, step = [], spread.step
    monkeypatch.setattr(spread, "step", lambda parts, edges, *a: read.append(edges.count()) or step(parts, edges, *a))
    chain = spark.range(40_000).selectExpr("id as src", "id + 1 as dst", "1 as dir", "1D as p")
    got = spread.ensemble(spark.createDataFrame([(0, 20_000)], "run int, cell long"), chain, 3, burn=1).collect()
    assert sorted((r.cell, r.arrival) for r in got) == [(20_000 + k, k) for k in range(4)] and read == [1, 1, 1]


def test_points_in_polygons_are_not_broadcast(spark):
    """exploded points were taken for a small table and sent to the driver."""
    square = spark.sql("select 1 as k, array(array(struct(0D as x, 0D as y), struct(9D as x, 0D as y), struct(9D as x, 9D as y))) as rings")
    found = polygons.within(spark.range(9).selectExpr("id + 0.5D as x", "id div 2 + 0D as y"), "x", "y", polygons.cover(square, "k", 5.0, 1), "k", 5.0, 1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 9


def test_pairs_of_rough_rings(spark):
    """F1 of round 5: 3,000,000 pairs of rings around few places, none of which crosses as little as its boxes say."""
    def around(n, vertices, place, radius):
        turn = f"j * 2 * pi() / {vertices}"
        return spark.sql(f"select id as k, array(transform(sequence(0, {vertices - 1}), j -> struct({place} + ({radius}) * cos({turn}) as x, ({radius}) * sin({turn}) as y))) as rings from range({n})")
    got = polygons.intersecting(around(6000, 12, "id % 7 / 10", "2 + (id + j * 5) % 3"), "k", around(500, 400, "id % 5 / 10", "4 + (id + j * 7) % 5"), "k", 25.0)
    assert got.count() == 3_000_000
    apart = polygons.intersecting(around(6000, 12, "id % 7 / 10", "2 + (id + j * 5) % 3"), "k", around(500, 400, "13.7 + id % 5 / 10", "4 + (id + j * 7) % 5"), "k", 25.0)
    assert apart.count() == 0


def test_distances_along_a_long_column(spark):
    """F3 of round 5: 200,000 rows in a column, a few cells to a row; a cell without a row keeps its row of the result."""
    cells = spark.range(400_000).selectExpr("id div 2 as row", "id % 2 as col", "id % 100000 = 0 as hit").unionAll(spark.sql("select null, 1L, true"))
    got = geometry.distance_transform(cells, "hit", 2.0).selectExpr("*", "least(row % 50000, 50000 - row % 50000) as up").persist()
    assert got.filter("row is null and distance is null and col = 1").count() == 1 and got.count() == 400_001
    assert got.filter("row <= 150000 and abs(distance - 2 * sqrt(up * up + col)) > 1e-9").count() == 0


def test_edges_are_cut_in_one_pass(spark):
    """F2 of round 5: level edges were cut by a second pass over all polygons."""
    ring = spark.sql("select 1 as k, array(array(struct(0D as x, 0D as y), struct(9D as x, 0D as y), struct(9D as x, 9D as y))) as rings")
    assert "Union" not in polygons.crossed(ring, "k", 5.0)[1]._jdf.queryExecution().executedPlan().toString()
