"""Case-control sampling without the product of cells and days: draws by rule, minus the cases, in the order drawn."""

from pyspark.sql import functions as F

from cindergrid.functions.exprs import draw_sql
from cindergrid.operators.state import numbered, written


def first(rows, order, n):
    """cell and day of the first n rows in an order of no equals, found by counts of ranges: no task sorts or holds them all."""
    return numbered(rows, order, "_n").filter(F.col("_n") < n).orderBy("_n").select("cell", "day")


def controls(cases, cells, first_day, days, ratio=20, seed=42, spare=2, grow=True):
    """ratio controls for each case (cell, day), without repeats. Draws grow until there are enough; where over half of the free cell-days are wanted, or the draws give no new ones any more (a draw
    has 999,983 values, and so have pairs of them), all are listed and put in drawn order. With grow False only spare draws for each control are made, and there are as many as these give.
    """
    cases = written(cases.select("cell", "day").distinct())
    n, draws = cases.count(), 999_983
    if grow and (cells > draws or days > draws):
        raise ValueError(f"draws have {draws} values: take at most so many cells and days")
    want = min(ratio * n, cells * days - n) if grow else ratio * n
    m, had, enough = spare * want, -1, not grow or 2 * want <= cells * days - n
    while enough:
        drawn = cases.sparkSession.range(max(1, m)).select("id", F.expr(f"cast(floor({draw_sql('id % 90000', 'id div 90000', '1', seed)} * {cells}) as bigint) AS cell"),
                                                           F.expr(f"date_add(date'{first_day}', cast(floor({draw_sql('id % 90000', 'id div 90000', '2', seed)} * {days}) as int)) AS day"))
        free = written(drawn.groupBy("cell", "day").agg(F.min("id").alias("id")).join(cases, ["cell", "day"], "left_anti"))
        found = free.count()
        if found >= want or not grow:
            return first(free, ["id"], want)
        enough, had, m = found > had, found, 2 * m
    every = cases.sparkSession.range(cells * days).select("id", F.expr(f"id div {days} AS cell"), F.expr(f"date_add(date'{first_day}', cast(id % {days} as int)) AS day"))
    free = every.join(cases, ["cell", "day"], "left_anti")
    return first(free.withColumn("draw", F.expr(draw_sql("id % 90000", "id div 90000", "1", seed))), ["draw", "id"], want)
