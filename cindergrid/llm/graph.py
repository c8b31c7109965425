"""Connected components by joins: every round each node passes the least node it knows to its neighbours."""

from pyspark.sql import functions as F

from cindergrid.llm.textkit import written


def components(links):
    """node, class for each node of links (a, b); class is the least node of its component. Rounds grow with the log of a chain's length."""
    pairs = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        passed = both.join(least, "u")
        pairs = written(passed.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m"))).filter("u > v").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("class"))
