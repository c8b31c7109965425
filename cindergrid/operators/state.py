"""Tables that cut lineage and outlive executors, and orders without a single task."""

import uuid

from pyspark.sql import Window as W, functions as F


def shared_dir(spark):
    """A new folder that tasks share: in spark.checkpoint.dir, or in the warehouse where the session names none; an error where that is a machine's own folder and the session isn't local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if (root.startswith("/") or root.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors don't share {root}")
    return f"{root}/s-{uuid.uuid4().hex}"


def written(df):
    """The rows written to the folder that tasks share and read again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df, order, *sums):
    """df with name_before for each column of sums: its sum over all rows that come earlier in the order.

    Rows are dealt to ranges of the order. Each range is summed by itself, and a table of one row for each range brings what earlier ranges hold. Rows that are equal in the order
    have no defined order among each other: group them first.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # The few rows of this window are one for each partition.
    parts = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    own = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumns({f"{c}_own": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).join(F.broadcast(parts), "_range")
    return out.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"{c}_own")).alias(f"{c}_before") for c in sums])


def numbered(df, order, name):
    """df with consecutive numbers from 0 in the given order, which has to be one of no equal rows."""
    return running(df.withColumn("one", F.lit(1)), order, "one").drop("one").withColumnRenamed("one_before", name)
