import math

import numpy as np
from pyspark.sql import functions as F

from cindergrid.functions.exprs import albers_sql, draw_sql
from cindergrid.operators.sampling import controls
from cindergrid.operators.spread import ensemble


def test_albers_origin(spark):
    x, y = albers_sql("-120e0", "0e0")
    x, y = spark.sql(f"SELECT {x}, {y}").first()
    assert abs(x) < 1e-6 and math.isclose(y, -4e6, abs_tol=1e-3)


def test_ensemble_equals_loops(spark):
    side, runs, steps = 9, 3, 5
    cells = [(r * side + c, r, c) for r in range(side) for c in range(side)]
    edges = [(a, b, (dr + 1) * 3 + dc + 1, .4) for a, r, c in cells for b, r2, c2 in cells for dr, dc in [(r2 - r, c2 - c)] if (dr or dc) and abs(dr) < 2 and abs(dc) < 2]
    draws = {(x.run, x.src, x.k): x.d for x in spark.range(runs).withColumnRenamed("id", "run").crossJoin(spark.range(side * side).withColumnRenamed("id", "src"))
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9 + 8 * steps)))).withColumn("d", F.expr(draw_sql("run", "src", "k", 11))).collect()}
    want = {}
    for run in range(runs):
        at = {40: 0}
        for t in range(1, steps + 1):
            new = {b for a, b, k, p in edges if t - 2 <= at.get(a, 99) < t and b not in at and draws[run, a, k + 8 * t] < p}
            at |= dict.fromkeys(new, t)
        want |= {(run, k): v for k, v in at.items()}
    got = ensemble(spark.range(runs).selectExpr("id AS run", "40L AS cell"), spark.createDataFrame(edges, "src long, dst long, dir int, p double"), steps)
    assert {(x.run, x.cell): x.arrival for x in got.collect()} == want
    assert len(want) > runs


def test_ensemble_without_edges_or_origins(spark):
    edges = spark.createDataFrame([], "src long, dst long, dir int, p double")
    assert ensemble(spark.range(2).selectExpr("id AS run", "5L AS cell"), edges, 4).count() == 2
    assert ensemble(spark.range(0).selectExpr("id AS run", "5L AS cell"), edges, 4).count() == 0


def test_controls(spark):
    cases = spark.sql("SELECT id % 3 AS cell, date_add(date'2024-01-01', cast(id % 5 AS int)) AS day FROM range(30) UNION ALL SELECT 0, date'2024-01-01'")
    got = {tuple(r) for r in controls(cases, 50, "2024-01-01", 30, ratio=4).collect()}
    held = {tuple(r) for r in cases.distinct().collect()}
    assert len(got) == 4 * len(held) and not got & held
    assert controls(cases.limit(0), 50, "2024-01-01", 30).count() == 0
    assert controls(cases, 3, "2024-01-01", 6, ratio=20).count() == 18 - len(held)


def test_draws_are_even(spark):
    x = np.array([r.d for r in spark.range(4000).select(F.expr(draw_sql("id", "id % 7", "3", 5)).alias("d")).collect()])
    assert abs(x.mean() - .5) < .03 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < .06
