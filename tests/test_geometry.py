"""Geometry, nearest neighbours and the spread's parts on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import geometry, joins, spread
from cindergrid.operators.zonal import zonal_mode, zonal_stats

SQUARE = [(0., 0.), (10., 0.), (10., 10.), (0., 10.)]


def ring(spark, *rings):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)], "k int, ring array<struct<x:double,y:double>>")


def test_areas_and_validity(spark):
    rows = ring(spark, SQUARE, SQUARE + SQUARE[:1], [(0., 0.), (1., 1.)], [(0., 0.), (1., 1.), (2., 2.)], [(0., 0.), (float("nan"), 1.), (2., 0.)], [])
    got = [(r.a, r.v) for r in rows.select("k", geometry.area(F.col("ring")).alias("a"), geometry.valid(F.col("ring")).alias("v")).orderBy("k").collect()]
    assert got[:4] == [(100, True), (100, True), (0, False), (0, False)] and not got[4][1] and not got[5][1]


def test_concave_and_outside(spark):
    hook = [(0., 0.), (10., 0.), (10., 10.), (5., 2.), (0., 10.)]
    pts = spark.createDataFrame([(5., 1.), (5., 5.), (1., 6.), (20., 5.)], "x double, y double").join(ring(spark, hook), F.lit(True))
    got = [(r.i, r.d) for r in pts.select(geometry.holds(F.col("ring"), F.col("x"), F.col("y")).alias("i"), geometry.distance_to(F.col("ring"), F.col("x"), F.col("y")).alias("d")).collect()]
    assert [i for i, _ in got] == [True, False, True, False] and got[0][1] == 0 and got[3][1] == 10 and 0 < got[1][1] < 3


def test_nearest_in_the_plane(spark):
    rng = random.Random(5)
    asks, points = [(i, rng.random() * 100, rng.random() * 100) for i in range(60)], [(i, rng.random() * 30, rng.random() * 30) for i in range(40)] + [(99, 0., 0.), (98, 0., 0.)]
    a, p = spark.createDataFrame(asks + [(77, None, 1.)], "a int, x double, y double"), spark.createDataFrame(points, "p int, x double, y double")
    want = {i: min((math.hypot(x - u, y - v), k) for k, u, v in points) for i, x, y in asks}
    got = {r.a: (r.distance, r.p) for r in joins.nearest_points(a, p, "a", "p", "x", "y", 2.0).collect()}
    assert set(got) == set(want) and all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)
    near = {r.a for r in joins.nearest_points(a, p, "a", "p", "x", "y", 2.0, cutoff=5.0).collect()}
    assert near == {i for i, (d, _) in want.items() if d <= 5}
    assert joins.nearest_points(a, p.limit(0), "a", "p", "x", "y", 2.0).count() == 0


def test_points_on_edges(spark):
    grid = geometry.lattice(spark, (0, 0, 20, 20), 10).withColumn("cell_id", F.col("row") * 2 + F.col("col"))
    pts = spark.createDataFrame([(5., 5.), (10., 5.), (25., 5.), (None, 5.)], "x double, y double")
    n = joins.match_counts(joins.points_to_cells(pts, grid, "x", "y", (0, 0), 10)).first()
    assert (n.n, n.matched, n.unmatched) == (4, 2, 2)
    assert joins.match_counts(joins.points_to_cells(pts, grid, "x", "y", (0, 0), 10, strict=True)).first().matched == 1


def test_labels_and_ranges(spark):
    rows = spark.createDataFrame([(1,), (12,), (15,), (None,)], "v int")
    got = rows.select(joins.classified(F.col("v"), [(1, 9, "low"), (15, 20, "mid")]), joins.labelled(F.col("v"), {1: "one", 15: "more"})).collect()
    assert [tuple(r) for r in got] == [("low", "one"), (None, "Not recorded"), ("mid", "more"), (None, "Not recorded")]


def test_circular_mean_and_modes(spark):
    px = spark.createDataFrame([(1, 350., 3), (1, 10., 3), (1, 90. - 90., 1), (1, 0., 1), (2, -1., None), (2, -1., None)], "cell int, aspect double, fuel int").withColumns({"v": F.lit(1.0), "s": F.lit(2.0)})
    got = {r.cell: r for r in zonal_stats(px, "cell", "v", "s", "aspect").collect()}
    assert got[1].northness > .9 and abs(got[1].eastness) < 1e-12 and (got[2].northness, got[2].consistency, got[2].pct_flat) == (0, 0, 100)
    assert {r.cell: r.majority for r in zonal_mode(px, "cell", "fuel").collect()} == {1: 1, 2: -1}


def lattice(spark, n, fuel=1.0):
    return spark.createDataFrame([(r * n + c, r, c, fuel, 0.0) for r in range(n) for c in range(n)], "cell int, row int, col int, fuel double, elev double")


def test_fire_grows_as_a_square_and_not_over_edges(spark):
    e = spread.edges(lattice(spark, 9), 1000)
    p = e.select("src", "dst", "dir", spread.probability(F.col("fuel"), F.lit(0.), F.lit(0.), F.col("steep"), F.col("dr"), F.col("dc"), 99, .2, .5).alias("p"))
    got = {r.cell: r.arrival for r in spread.ensemble(spark.createDataFrame([(0, 40)], "run long, cell int"), p, 3, burn=1).collect()}
    assert got == {r * 9 + c: max(abs(r - 4), abs(c - 4)) for r in range(9) for c in range(9) if max(abs(r - 4), abs(c - 4)) <= 3}
    corner = {r.cell for r in spread.ensemble(spark.createDataFrame([(0, 8)], "run long, cell int"), p, 1).collect()}
    assert corner == {8, 7, 16, 17}
    bare = spread.edges(lattice(spark, 3, 0.0), 1000)
    assert bare.count() == 0


def test_wind_drives_by_the_hour(spark):
    e = spread.edges(lattice(spark, 5), 1000)
    winds = spark.createDataFrame([(t, c, 9.0 if t == 1 else 0.0, 0.0) for t in (1, 2) for c in range(25)], "step int, cell int, u double, v double")
    f = spread.hourly(winds, {"p0": 1e-4, "k_wind": 2.0, "k_slope": 0.0})
    one, two = ({(r.src, r.dst): r.p for r in f(e, t).collect()} for t in (1, 2))
    assert one[12, 13] == 1 and one[12, 11] < 1e-9 and two[12, 13] == two[12, 11] == pytest.approx(1e-4)
    hours = {r.step: r.hour for r in spread.hour_of_step(5, spark.createDataFrame([(0,), (2,), (4,)], "hour int")).collect()}
    assert hours == {1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_search_finds_the_known_run(spark):
    own = lattice(spark, 9).withColumn("fuel", F.when(F.col("col") == 4, 1.0).otherwise(.4))
    e = spread.edges(own, 1000).withColumns({"u": F.lit(0.), "v": F.lit(0.)})
    tried = spark.createDataFrame([(0, .01, 0., 0.), (1, 9., 0., 0.), (2, 9., 0., 0.)], "cand long, p0 double, k_wind double, k_slope double")
    seen = own.select("cell", F.greatest(F.abs(F.col("row") - 4), F.abs(F.col("col") - 4)).alias("arrival")).filter("arrival <= 3")
    got = spread.search(tried, e, 40, seen, 3, repeats=2, burn=1).collect()
    assert [r.cand for r in got][:2] == [1, 2] and got[0].iou == 1 and got[0].mae == 0 and got[2].mae is None
    assert spread.best(spark.createDataFrame(got), "p0").first().cand == 1


def test_candidates_stay_in_their_ranges(spark):
    rows = spread.candidates(spark, 50).collect()
    assert all(lo <= r[name] <= hi for r in rows for name, (lo, hi) in spread.RANGES.items()) and len({r.p0 for r in rows}) == 50


def test_scenario_follows_the_wind(spark):
    own = lattice(spark, 9).withColumns({"x": F.col("col") * 1.0, "y": F.col("row") * 1.0})
    winds = own.select(F.lit(0).alias("hour"), "cell", F.lit(9.0).alias("u"), F.lit(0.0).alias("v"))
    found, summary = spread.scenario(own, (1.2, 3.9), winds, {"p0": 1e-6, "k_wind": 3.0, "k_slope": 0.0}, 3, runs=4, burn=1)
    assert {r.cell for r in found.collect()} >= {37, 38, 39, 40} and all(r.cell % 9 >= 1 for r in found.collect())
    r = summary.first()
    assert r.reach >= 3 and r.acres == int(r.likely_cells * 247.105)


def test_distances_are_exact(spark):
    rng = random.Random(6)
    cells = [(r, c, rng.random() < .06) for r in range(25) for c in range(30) if rng.random() < .9]
    got = {(r.row, r.col): r.distance for r in geometry.distance_transform(spark.createDataFrame(cells, "row int, col int, hit boolean"), "hit", 3.0).collect()}
    hits = [(r, c) for r, c, h in cells if h]
    assert got.keys() == {(r, c) for r, c, _ in cells}
    assert all(got[r, c] == pytest.approx(3 * min(math.hypot(r - a, c - b) for a, b in hits)) for r, c, _ in cells)
    none = geometry.distance_transform(spark.createDataFrame([(0, 1, False), (0, 2, None)], "row int, col int, hit boolean"), "hit").collect()
    assert [r.distance for r in none] == [None, None]


def test_a_row_of_100000_columns(spark):
    cells = spark.range(100_000).select(F.lit(0).alias("row"), F.col("id").alias("col"), F.col("id").isin(0, 40_000, 99_000).alias("hit"))
    got = geometry.distance_transform(cells, "hit").filter("distance <> least(col, abs(col - 40000), abs(col - 99000))").count()
    assert got == 0


def test_neighbours_are_not_broadcast(spark):
    cells = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col", "id as v")
    n = geometry.neighbours(cells, "v")
    assert "Broadcast" not in n._jdf.queryExecution().executedPlan().toString() and n.count() == 4 * 3 + 32 * 5 + 64 * 8
