"""Spread over a lattice by joins: all runs of an ensemble advance together, and every step appends the cells it newly reaches."""

from functools import reduce

from pyspark.sql import functions as F

from cindergrid.functions.exprs import draw_sql
from cindergrid.operators.geometry import neighbours, slope
from cindergrid.operators.joins import nearest_to
from cindergrid.operators.metrics import confusion, objective, timing
from cindergrid.operators.state import written


MERGE = 8


def union(parts):
    return reduce(lambda x, y: x.union(y), parts)


def receptivity(burnable, grass, shrub, timber, weights):
    """Burnable share times the weighted mean of the fuels' shares; 0 where there is no fuel, nulls count as 0."""
    shares = [F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in (grass, shrub, timber)]
    mix = sum((w * s for w, s in zip(weights, shares)), F.lit(0.0))
    return F.coalesce(burnable, F.lit(0.0)) * F.coalesce(F.try_divide(mix, sum(shares, F.lit(0.0))), F.lit(0.0))


def probability(fuel, u, v, rise_over_run, dr, dc, p0, k_wind, k_slope, at=1.0):
    """Chance that a burning cell sets off its neighbour (dr rows north, dc columns east): wind at the source along the way, slope held to 1.5, per distance."""
    d = F.hypot(dr, dc)
    along = F.coalesce((u * dc + v * dr) / d, F.lit(0.0))
    steep = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.coalesce(rise_over_run, F.lit(0.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at * p0 * fuel * F.exp(k_wind * along) * F.exp(k_slope * steep) / d))


def edges(cells, size, receptive="source"):
    """src, dst, dir, dr, dc, fuel, steep of neighbouring cells. cells: cell, row, col, fuel, elev. Fuel is the source's or the target's; a target without fuel never burns."""
    out = neighbours(cells, "cell", "fuel", "elev").filter("dst_fuel > 0")
    return out.select(F.col("src_cell").alias("src"), F.col("dst_cell").alias("dst"), "dir", "dr", "dc", F.col("src_fuel" if receptive == "source" else "dst_fuel").alias("fuel"),
                      slope(F.col("dst_elev") - F.col("src_elev"), F.col("dr"), F.col("dc"), F.lit(float(size))).alias("steep"))


def hour_of_step(steps, hours):
    """step and the hour nearest to it (the earlier of equals) of the wind's hours, which are few. steps: how many; hours: column hour."""
    at = hours.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step")).crossJoin(F.broadcast(hours.select("hour").distinct()))
    return at.groupBy("step").agg(F.min(F.struct(F.abs(F.col("hour") - F.col("step")), "hour"))["hour"].alias("hour"))


def step(parts, edges, t, burn, seed, wind=None):
    """run, cell, arrival of the cells that step t newly reaches. parts: arrivals so far, those of the last burn steps each by itself; edges: src, dst, dir, p, or what wind makes p of."""
    burning = union(parts[-burn:])
    hit = burning.join(edges if wind is None else wind(edges, t), burning.cell == F.col("src")).filter(f"arrival >= {t - burn} AND {draw_sql('run', 'src', f'dir + 8 * {t}', seed)} < p").select("run", F.col("dst").alias("cell")).distinct()
    return hit.join(union(parts), ["run", "cell"], "left_anti").withColumn("arrival", F.lit(t))


def by_source(edges):
    """edges in ranges of their source, so that a step reads those near what burns alone."""
    return written(edges.repartitionByRange("src").sortWithinPartitions("src"))


def near(edges, burning):
    """The edges of by_source between the least and the greatest burning cell; None if nothing burns."""
    ends = burning.agg(F.min("cell"), F.max("cell")).first()
    return None if ends[0] is None else edges.filter(F.col("src").between(*ends))


def ensemble(origins, edges, steps, burn=2, seed=11, wind=None):
    """run, cell, arrival. origins: run, cell. A cell spreads in the burn steps after its arrival; it stops early when nothing burns. wind: gives p to the edges of a step."""
    edges, parts = by_source(edges), [written(origins.select("run", "cell", F.lit(0).alias("arrival")))]
    for t in range(1, steps + 1):
        some = near(edges, union(parts[-burn:]))
        if some is None:
            break
        parts.append(written(step(parts, some, t, burn, seed, wind)))
        if len(parts) > burn + MERGE:
            parts = [written(union(parts[:-burn]).coalesce(4)), *parts[-burn:]]
    return union(parts)


def hourly(winds, params):
    """A function for ensemble(wind=): p of the edges under the wind at the source in the hour of the step. winds: step, cell, u, v."""
    def of(edges, t):
        at = winds.filter(F.col("step") == t).select(F.col("cell").alias("src"), "u", "v")
        p = probability(F.col("fuel"), F.coalesce("u", F.lit(0.0)), F.coalesce("v", F.lit(0.0)), F.col("steep"), F.col("dr"), F.col("dc"), params["p0"], params["k_wind"], params["k_slope"])
        return edges.join(at, "src", "left").select("src", "dst", "dir", p.alias("p"))
    return of


def burn_probability(arrivals, runs):
    """Share of runs that reach a cell, and the median arrival of those that do."""
    return arrivals.groupBy("cell").agg((F.count("*") / runs).alias("prob"), F.median("arrival").alias("arrival"))


def domain(cells, hit, margin=6):
    """The cells within the bounds of those hit and a margin, with r and c counted from the first. cells: row, col; hit: row, col."""
    ends = hit.agg(*[f(c).alias(f"{c}{k}") for c in ("row", "col") for k, f in enumerate((F.min, F.max))])
    near = cells.join(F.broadcast(ends), F.expr(f"row between row0 - {margin} and row1 + {margin} and col between col0 - {margin} and col1 + {margin}"))
    first = F.broadcast(near.agg(F.min("row").alias("r0"), F.min("col").alias("c0")))
    return near.crossJoin(first).select(*cells.columns, (F.col("row") - F.col("r0")).alias("r"), (F.col("col") - F.col("c0")).alias("c"))


def scenario_summary(found, cells, origin, likely=0.5, acres=247.105):
    """One row: likely cells, their acres (whole), cells with any chance, and the greatest distance of a likely cell from the origin, in cells. cells: cell, row, col; of one square kilometre."""
    at = cells.filter(F.col("cell") == origin).select(F.col("row").alias("r0"), F.col("col").alias("c0"))
    d = F.hypot(F.col("row") - F.col("r0"), F.col("col") - F.col("c0"))
    ok = F.col("prob") >= likely
    return found.join(cells, "cell").crossJoin(F.broadcast(at)).agg(F.count_if(ok).alias("likely_cells"), F.floor(F.count_if(ok) * acres).alias("acres"), F.count_if(F.col("prob") > 0).alias("any_cells"), F.coalesce(F.max(F.when(ok, d)), F.lit(0.0)).alias("reach"))


def scenario(cells, place, winds, params, steps, runs=20, burn=2, size=1000, seed=11):
    """(probabilities, one row of summary) of a fire that starts in the cell nearest to a place. cells: cell, row, col, x, y, fuel, elev; winds: hour, cell, u, v; each step takes the wind of the nearest hour."""
    origin = nearest_to(cells, "x", "y", place, "cell").first()["cell"]
    hours = hour_of_step(steps, winds.select("hour"))
    by_step = written(F.broadcast(hours).join(winds, "hour").select("step", "cell", "u", "v"))
    start = cells.sparkSession.range(runs).select(F.col("id").alias("run"), F.lit(origin).alias("cell"))
    found = written(burn_probability(ensemble(start, edges(cells, size), steps, burn, seed, hourly(by_step, params)), runs))
    return found, scenario_summary(found, cells.select("cell", "row", "col"), origin)


RANGES = {"p0": (0.05, 0.6), "k_wind": (0.0, 0.3), "k_slope": (0.0, 1.0)}


def candidates(spark, n, ranges=RANGES, seed=42):
    """cand and one drawn value of each parameter, uniform within its range."""
    draws = [(F.lit(float(lo)) + (hi - lo) * F.expr(draw_sql("id", str(k), "7", seed))).alias(name) for k, (name, (lo, hi)) in enumerate(ranges.items())]
    return spark.range(n).select(F.col("id").alias("cand"), *draws)


def search(tried, edges, origin, observed, steps, repeats=6, burn=2, seed=11, least=10):
    """Every candidate's iou, mae and score, the best first (the earlier of equals); all candidates and repeats run as one ensemble.

    tried: cand, p0, k_wind, k_slope; edges: src, dst, dir, dr, dc, fuel, steep, u, v; observed: cell, arrival. A cell counts as reached at a probability of one half.
    """
    p = probability(F.col("fuel"), F.col("u"), F.col("v"), F.col("steep"), F.col("dr"), F.col("dc"), F.col("p0"), F.col("k_wind"), F.col("k_slope"))
    edges, params = by_source(edges), tried.select("cand", "p0", "k_wind", "k_slope")
    parts = [written(tried.select("cand").crossJoin(tried.sparkSession.range(repeats).select(F.col("id").alias("rep"))).select("cand", (F.col("cand") * repeats + F.col("rep")).alias("run"), F.lit(origin).alias("cell"), F.lit(0).alias("arrival")))]
    for t in range(1, steps + 1):
        burning = union(parts[-burn:])
        some = near(edges, burning)
        if some is None:
            break
        hit = burning.join(params, "cand").join(some, F.col("cell") == F.col("src")).withColumn("p", p).filter(f"arrival >= {t - burn} AND {draw_sql('run', 'src', f'dir + 8 * {t}', seed)} < p")
        hit = hit.select("cand", "run", F.col("dst").alias("cell")).distinct()
        parts.append(written(hit.join(union(parts), ["cand", "run", "cell"], "left_anti").withColumn("arrival", F.lit(t))))
    reached = union(parts).groupBy("cand", "cell").agg((F.count("*") / repeats).alias("prob"), F.median("arrival").alias("simulated")).filter("prob >= 0.5")
    seen = tried.select("cand").crossJoin(observed.filter("arrival is not null").select("cell", F.col("arrival").alias("observed")))
    both = reached.join(seen, ["cand", "cell"], "full")
    hits, either = F.count_if(F.col("simulated").isNotNull() & F.col("observed").isNotNull()), F.count("*")
    out = both.groupBy("cand").agg((hits / F.greatest(either, F.lit(1))).alias("iou"), *timing("observed", "simulated", least))
    return tried.join(out, "cand").withColumn("score", objective(F.col("iou"), F.col("mae"))).orderBy(F.desc("score"), "cand")


def best(scores, *params):
    """One row: the candidate of the highest score, the first of equals."""
    return scores.agg(F.max_by(F.struct("cand", *params, "score"), F.struct("score", -F.col("cand"))).alias("of")).select("of.*")


def overlap(found, observed, threshold=0.5):
    """confusion of the cells that a simulation reaches with those observed. found: cell, prob; observed: cell."""
    rows = found.filter(F.col("prob") >= threshold).select("cell", F.lit(True).alias("simulated")).join(observed.select("cell", F.lit(True).alias("seen")), "cell", "full")
    return confusion(rows, "seen", "simulated")
