"""Antecedent windows per pixel, ranks and keep-latest; each is one shuffle on the partition key."""

from pyspark.sql import Window as W, functions as F

from cindergrid.operators.state import running


def antecedent(wx, pixel, day, value, wet=2.5, cap=120, sums=(7, 30, 90), mean=7):
    """Sums over the last days, the mean of a week and days since the last wet day (over wet; null is dry), which starts at cap. A row is a day: fill gaps by every_day first."""
    w = W.partitionBy(pixel).orderBy(day)
    idx = F.row_number().over(w)
    out = wx.withColumn("idx", idx)
    for n in sums:
        out = out.withColumn(f"sum_{n}d", F.sum(value).over(w.rowsBetween(1 - n, 0)))
    last = F.last(F.when(F.col(value) > wet, F.col("idx")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn(f"mean_{mean}d", F.avg(value).over(w.rowsBetween(1 - mean, 0))).withColumn("days_since_wet", F.least(F.lit(cap), F.coalesce(F.col("idx") - last, F.lit(cap))))


def every_day(df, pixel, day):
    """df with a row for each pixel and each day between the first and the last day of all; values are null on days without one."""
    ends = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    spine = df.select(pixel).distinct().crossJoin(F.broadcast(ends)).select(pixel, F.explode(F.sequence("first", "last")).alias(day))
    return spine.join(df, [pixel, day], "left")


def percentile_rank(df, value, by=()):
    """pct: rank over n with ties averaged, of the rows that have a value, within each value of the columns by; null for others. Counts of distinct values are summed in ranges."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    total = per.groupBy(*by).agg(F.sum("k").alias("n"))
    rows = running(per, [*by, value], "k")
    if by:
        rows = rows.join(rows.groupBy(*by).agg(F.min("k_before").alias("_start")).join(total, list(by)), list(by)).withColumn("k_before", F.col("k_before") - F.col("_start"))
    else:
        rows = rows.crossJoin(F.broadcast(total))
    per = rows.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_value"), ((F.col("k_before") + (F.col("k") + 1) / 2) / F.col("n")).alias("pct"))
    return df.join(per, [df[value] == per._value, *[df[c] == per[f"_{c}"] for c in by]], "left").drop("_value", *[f"_{c}" for c in by])


def keep_latest(df, keys, order):
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def dense_ranks(df, key, name):
    """df with the rank, from 0, of its key among the distinct keys."""
    from cindergrid.operators.state import numbered
    ranks = numbered(df.select(F.col(key).alias("_key")).distinct(), ["_key"], name)
    return df.join(ranks, df[key].eqNullSafe(ranks._key)).drop("_key")


def nearest_in_time(asks, points, key, ask_time, point_time):
    """asks with nearest: of the key's points the nearest in time, the earlier of equals, the first or last beyond the ends; null without points. One shuffle on the key."""
    rows = asks.withColumn("_t", F.col(ask_time)).withColumn("_ask", F.lit(True)).unionByName(points.select(key, F.col(point_time).alias("_t")).distinct().withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    own = F.when(~F.col("_ask"), F.col("_t"))
    w = W.partitionBy(key).orderBy("_t")
    rows = rows.withColumn("_p", F.max(own).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("_q", F.min(own).over(w.rangeBetween(0, W.unboundedFollowing))).filter("_ask")
    later = F.col("_p").isNull() | (F.timestamp_diff("MICROSECOND", "_t", "_q") < F.timestamp_diff("MICROSECOND", "_p", "_t"))
    return rows.select(*asks.columns, F.when(later, F.col("_q")).otherwise(F.col("_p")).alias("nearest"))
