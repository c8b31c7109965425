"""Points to cells, and nearest neighbours on an axis and in the plane, as equi joins on bins."""

import math
from functools import reduce

from pyspark.sql import Window as W, functions as F

from cindergrid.operators.state import written


def cell(x, y, origin, size):
    """row and col of the square that holds a point; a point on an edge belongs to the square above or to the right."""
    return F.floor((y - origin[1]) / size), F.floor((x - origin[0]) / size)


def points_to_cells(points, grid, x, y, origin, size, strict=False):
    """points with the grid's cell_id, null where no cell holds the point. grid: row, col, cell_id. strict: points on an edge are in no cell."""
    row, col = cell(F.col(x), F.col(y), origin, size)
    if strict:
        inner = (F.pmod(F.col(x) - origin[0], F.lit(size)) != 0) & (F.pmod(F.col(y) - origin[1], F.lit(size)) != 0)
        row = F.when(inner, row)
    own = points.withColumns({"_row": row, "_col": col})
    cells = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "cell_id")
    return own.join(cells, ["_row", "_col"], "left").drop("_row", "_col")


def match_counts(joined):
    """n, matched and unmatched rows of points_to_cells."""
    return joined.agg(F.count("*").alias("n"), F.count("cell_id").alias("matched"), F.count_if(F.col("cell_id").isNull()).alias("unmatched"))


def first_arrivals(joined, time):
    """The earliest time of each cell, and how many points it has."""
    return joined.filter("cell_id is not null").groupBy("cell_id").agg(F.min(time).alias("arrival"), F.count("*").alias("n"))


def classified(value, ranges, default=None):
    """Name of the range (low, high, name) that holds a value, both ends included."""
    out = F.lit(default)
    for low, high, name in reversed(ranges):
        out = F.when(value.between(low, high), F.lit(name)).otherwise(out)
    return out


def labelled(code, names, default="Not recorded"):
    """Label of a code."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code), F.lit(default))


def nearest_on_axis(asks, points, value, point):
    """asks with nearest: the nearest of the points' values, the smaller of equals; null for null values and where there are no points.

    Distinct values are dealt to ranges of the axis, each of which is searched by itself in both directions; the nearest points outside come from a table of one row for each range.
    """
    known = points.select(F.col(point).alias("_v"), F.lit(True).alias("_known"))
    rows = asks.select(F.col(value).alias("_v"), F.lit(False).alias("_known")).union(known).filter("_v is not null").groupBy("_v").agg(F.max("_known").alias("_known"), F.bool_or(~F.col("_known")).alias("_ask"))
    rows = written(rows.repartitionByRange("_v").withColumn("_b", F.spark_partition_id()))
    own = F.when(F.col("_known"), F.col("_v"))
    ends = rows.groupBy("_b").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    # Frames begin at the first row in both directions; one that ends at the last would be summed anew for each row.
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    line = W.partitionBy(F.lit(0))
    ends = ends.select("_b", F.max("hi").over(before(line.orderBy("_b"))).alias("_below"), F.min("lo").over(before(line.orderBy(F.desc("_b")))).alias("_above"))
    here = lambda order: W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_lo": F.max(own).over(here(F.asc("_v"))), "_hi": F.min(own).over(here(F.desc("_v")))}).filter("_ask")
    rows = rows.join(F.broadcast(ends), "_b", "left").withColumns({"_lo": F.coalesce("_lo", "_below"), "_hi": F.coalesce("_hi", "_above")})
    low = F.col("_hi").isNull() | (F.col("_v") - F.col("_lo") <= F.col("_hi") - F.col("_v"))
    near = rows.select("_v", F.when(low, F.col("_lo")).otherwise(F.col("_hi")).alias("nearest"))
    return asks.withColumn("_v", F.col(value)).join(near, "_v", "left").select(*asks.columns, "nearest")


def nearest_points(asks, points, ask_id, point_id, x, y, reach, cutoff=None):
    """ask_id, point_id, distance of the nearest point in the plane, the least point_id of equals; no row where there is none within the cutoff.

    Each place is asked for once, and of the points at one place only the least counts. Squares of a reach join with their eight neighbours; places without a point within the
    reach go on with twice the reach, up to the cutoff, or until none is left. The reach given is lowered to the mean gap between points, so that squares hold few.
    """
    asks = asks.select(F.col(ask_id).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")).filter("ax is not null and ay is not null")
    points = written(points.select(F.col(point_id).alias("p"), F.col(x).alias("px"), F.col(y).alias("py")).filter("px is not null and py is not null").groupBy("px", "py").agg(F.min("p").alias("p")))
    left, count = written(asks.select("ax", "ay").distinct()), points.count()
    ends = left.union(points.select("px", "py")).agg(*[f(c) for c in ("ax", "ay") for f in (F.min, F.max)]).first()
    if not count or ends[0] is None:
        return asks.select(F.col("a").alias(ask_id), F.lit(None).cast(points.schema["p"].dataType).alias(point_id), F.lit(0.0).alias("distance")).filter("false")
    wide, high = float(ends[1]) - float(ends[0]), float(ends[3]) - float(ends[2])
    whole, found, near = max(wide, high), [], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    if cutoff is None and not math.isfinite(wide + high):
        raise ValueError("places are not finite")
    reach = cutoff if cutoff is not None else reach
    gap = max(math.sqrt(wide * high / count), whole / count)
    reach = gap if 0 < gap < reach else reach
    while True:
        square = lambda v: F.floor(F.col(v) / reach)  # noqa: B023, E731
        around = points.select("p", "px", "py", near.alias("o")).select("p", "px", "py", (square("px") + F.col("o.i")).alias("r"), (square("py") + F.col("o.j")).alias("c"))
        d = F.sqrt((F.col("ax") - F.col("px")) ** 2 + (F.col("ay") - F.col("py")) ** 2)
        best = left.select("*", square("ax").alias("r"), square("ay").alias("c")).join(around, ["r", "c"]).select("ax", "ay", "p", d.alias("d")).filter(F.col("d") <= reach)
        best = written(best.groupBy("ax", "ay").agg(F.min(F.struct("d", "p")).alias("of")).select("ax", "ay", "of.p", "of.d"))
        found.append(best)
        if reach == cutoff:
            break
        left = written(left.join(best, ["ax", "ay"], "left_anti"))
        if left.isEmpty():
            break
        if cutoff is None and reach > 2 * whole:
            raise ValueError("places are not finite")
        reach = 2 * reach if cutoff is None else min(2 * reach, cutoff)
    out = asks.join(reduce(lambda f, g: f.union(g), found), ["ax", "ay"])
    return out.select(F.col("a").alias(ask_id), F.col("p").alias(point_id), F.col("d").alias("distance"))


def nearest_to(rows, x, y, place, *order):
    """The row nearest to a place; ties by the order."""
    return rows.orderBy((F.col(x) - place[0]) ** 2 + (F.col(y) - place[1]) ** 2, *order).limit(1)


def filled_from(features, grid, key, wanted):
    """features joined with the grid's row of the key: each wanted column comes from the features, or else from the grid."""
    missing = [c for c in wanted if c not in features.columns]
    return features.join(grid.select(key, *missing), key, "left").select(key, *wanted)
