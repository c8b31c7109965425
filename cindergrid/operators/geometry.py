"""Plane geometry in column expressions. A ring is an array of structs x, y; its last vertex is joined to its first, whether or not that is repeated."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

MOORE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def edges(ring):
    """Array of (a, b): each vertex and the next."""
    return F.transform(ring, lambda v, i: F.struct(v.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def total(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring):
    """Area of a ring, negative if it runs clockwise."""
    return total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(ring):
    return F.abs(signed_area(ring))


def centroid(ring):
    """The centre of a ring's area as a struct x, y; null for a ring without one."""
    def moment(c):
        return F.try_divide(total(F.transform(edges(ring), lambda e: (e["a"][c] + e["b"][c]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))), 6 * signed_area(ring))
    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def holds(ring, x, y):
    """Whether a ring holds a point, by the parity of crossings to the right."""
    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def distance_to(ring, x, y):
    """Distance of a point to a ring's nearest edge; 0 inside."""
    def to(e):
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt((a["x"] + t * dx - x) ** 2 + (a["y"] + t * dy - y) ** 2)
    return F.when(holds(ring, x, y), 0.0).otherwise(F.array_min(F.transform(edges(ring), to)))


def valid(ring):
    """Whether a ring has three different vertices at least, all finite, and an area."""
    finite = F.forall(ring, lambda v: F.coalesce((F.abs(v["x"]) < float("inf")) & (F.abs(v["y"]) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(F.array_distinct(ring)) >= 3) & finite & (area(ring) > 0), F.lit(False))


def lattice(spark, bounds, size):
    """cell squares that cover bounds snapped outward: row, col, x0, y0, x1, y1, x, y (the centre). Made in parallel, a row of cells at a time."""
    c0, r0 = int(bounds[0] // size), int(bounds[1] // size)
    cols, rows = -int(-bounds[2] // size) - c0, -int(-bounds[3] // size) - r0
    out = spark.range(rows * cols).select((F.col("id") / cols).cast("bigint").alias("row"), (F.col("id") % cols).alias("col"))
    x, y = (F.col("col") + c0) * size, (F.col("row") + r0) * size
    return out.select("row", "col", *[v.cast("double").alias(n) for v, n in ((x, "x0"), (y, "y0"), (x + size, "x1"), (y + size, "y1"), (x + size / 2, "x"), (y + size / 2, "y"))])


def neighbours(cells, *values, reach=MOORE):
    """src_row, src_col, row, col, dr, dc, dir and the values of both ends (src_ and dst_) of every cell and its neighbours; there are none over the edge."""
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("dir"), F.lit(i).alias("dr"), F.lit(j).alias("dc")) for k, (i, j) in enumerate(reach, 1)])).alias("s")
    a = cells.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), *[F.col(v).alias(f"src_{v}") for v in values], step)
    a = a.select("*", "s.dir", "s.dr", "s.dc", (F.col("src_row") + F.col("s.dr")).alias("row"), (F.col("src_col") + F.col("s.dc")).alias("col")).drop("s")
    # The planner takes exploded rows for as few as their source's, and would send them to the driver and all tasks.
    return a.join(cells.select("row", "col", *[F.col(v).alias(f"dst_{v}") for v in values]).hint("merge"), ["row", "col"])


def dense(cells, values):
    """Every cell with its values, null where there are none: a raster to draw. Both have row and col."""
    return cells.join(values, ["row", "col"], "left")


def slope(rise, dr, dc, size):
    """Rise over run between neighbouring cells."""
    return rise / (F.hypot(dr, dc) * size)


def pixel(x, y, left, top, size, rows, cols):
    """Row and column of the raster's pixel at a place, held within the raster."""
    hold = lambda v, n: F.least(F.greatest(v.cast("bigint"), F.lit(0)), F.lit(n - 1))
    return hold((F.lit(top) - y) / size, rows), hold((x - left) / size, cols)


def bounds(df, x, y):
    return df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def window_of(df, lat, lon, box):
    """The least and greatest row and column of a curvilinear grid whose places are in the box (lat0, lon0, lat1, lon1)."""
    inside = df.filter(F.col(lat).between(box[0], box[2]) & normal_lon(F.col(lon)).between(box[1], box[3]))
    return inside.agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def normal_lon(lon):
    """Longitude from -180 to 180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def principal_axis(df, group, x, y):
    """elongation (ratio of the axes' deviations) and bearing (degrees from north, 0 to 180) of each group's points."""
    m = df.groupBy(group).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    root = F.sqrt((F.col("a") - F.col("b")) ** 2 + 4 * F.col("c") ** 2)
    bearing = F.pmod(F.degrees(F.atan2(2 * F.col("c"), F.col("b") - F.col("a")) / 2), F.lit(180.0))
    return m.select(group, F.sqrt(F.try_divide(F.col("a") + F.col("b") + root, F.col("a") + F.col("b") - root)).alias("elongation"), bearing.alias("bearing"))


def lower_envelope(places, heights, asked):
    """Least (x - place)² + height over all places, for each asked x. places in rising order; one pass over each."""
    kept, begins, x, lift = [], [], places.tolist(), (heights + places ** 2).tolist()
    for i in np.flatnonzero(np.isfinite(heights)).tolist():
        while kept:
            j = kept[-1]
            meet = (lift[i] - lift[j]) / (2 * (x[i] - x[j]))
            if meet > begins[-1]:
                break
            kept.pop(), begins.pop()
        begins.append(meet if kept else -np.inf)
        kept.append(i)
    if not kept:
        return np.full(len(asked), np.nan)
    own = np.array(kept)[np.searchsorted(begins, asked) - 1]
    return (asked - places[own]) ** 2 + heights[own]


def distance_transform(cells, hit, size=1.0):
    """row, col and distance of each cell's centre to that of the nearest cell for which hit holds; null without any, and for cells without a row or column. cells: row, col, hit; there may be gaps. Exact, in time linear in the raster (but for sorting).

    Down each column the nearest hit row is found; along each row the least of the parabolas over these heights. A task holds a column or a row of cells at a time.
    """
    nowhere = cells.filter("row is null or col is null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(None).cast("double").alias("distance")).distinct()
    cells = cells.filter("row is not null and col is not null")
    # Columns with hits have a place in every row, so that gaps among the cells pass distances on.
    ends = cells.agg(F.min("row").alias("_first"), F.max("row").alias("_last"))
    lattice = cells.filter(F.col(hit)).select("col").distinct().crossJoin(F.broadcast(ends)).select(F.explode(F.sequence("_first", "_last")).alias("row"), "col", F.lit(False).alias("_hit"), F.lit(False).alias("_asked"))
    own = cells.select("row", "col", F.coalesce(F.col(hit), F.lit(False)).alias("_hit"), F.lit(True).alias("_asked")).unionByName(lattice)
    own = own.repartition("col").groupBy("col", "row").agg(F.max("_hit").alias("_hit"), F.max("_asked").alias("_asked"))
    seen = F.when(F.col("_hit"), F.col("row"))
    down = W.partitionBy("col").orderBy("row")
    # A window that ends with the last row would be summed anew for each row.
    before, after = F.max(seen).over(down), F.min(seen).over(W.partitionBy("col").orderBy(F.desc("row")))
    high = own.select("row", "col", "_asked", F.least(F.col("row") - before, after - F.col("row")).cast("double").alias("_high"))

    def along(parts):
        row, col, height, asked = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(4))
        col, height, asked = col.astype(float), height.astype(float) ** 2, asked.astype(bool)
        cut = np.append(np.flatnonzero(np.diff(row, prepend=row[0] - 1)), len(row))
        found = [lower_envelope(col[i:j], height[i:j], col[i:j][asked[i:j]]) for i, j in zip(cut[:-1], cut[1:])]
        return pa.record_batch([pa.array(row[asked]), pa.array(col[asked].astype(np.int64)), pa.array(np.sqrt(np.concatenate(found)) * size, from_pandas=True)], names=["row", "col", "distance"])

    def run(batches):
        # Rows of cells may go on in the next batch.
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy()
            last = int(np.searchsorted(row, row[-1]))
            if held and held[-1].column(0)[-1].as_py() != row[0]:
                yield along(held)
                held = []
            if last:
                yield along([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield along(held)
    rows = high.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "_high", "_asked")
    return rows.repartition("row").sortWithinPartitions("row", "col").mapInArrow(run, "row long, col long, distance double").unionByName(nowhere)
