"""Zonal aggregation of pixels onto cells: partial aggregation per task, one shuffle on the cell."""

from pyspark.sql import functions as F


def zonal_stats(pixels, cell, value, slope, aspect):
    a = F.when(F.col(aspect).between(0, 360), F.radians(aspect))
    flat = F.col(aspect) == -1
    out = pixels.groupBy(cell).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        (100 * F.count_if(F.col(slope) > 30) / F.count("*")).alias("pct_steep"), (100 * F.count_if(flat) / F.count("*")).alias("pct_flat"),
        F.avg(F.cos(a)).alias("northness"), F.avg(F.sin(a)).alias("eastness"), F.count("*").alias("n_pixels"))
    return out.withColumn("consistency", F.hypot("northness", "eastness")).fillna(0.0, ["northness", "eastness", "consistency"])


def zonal_mode(pixels, cell, code):
    """Most frequent code, the smallest on ties, -1 if there is none."""
    return pixels.groupBy(cell).agg(F.coalesce(F.mode(code, True), F.lit(-1)).alias("majority"))
