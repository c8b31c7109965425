"""Keep-latest deduplication of a stream of detections by hour and rounded place."""

from pyspark.sql import functions as F

from cindergrid.operators.state import shared_dir


def latest_by_hour(stream, ts, place, payload, late="2 hours"):
    """Latest row of each hour and place. Rows that come later than late behind the newest time are dropped; the query's progress counts them (numRowsDroppedByWatermark)."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("hour"), *place)
            .agg(F.max_by(F.struct(*payload), F.struct(ts, *payload)).alias("latest")))


def publish(stream, ts, place, payload, late="2 hours"):
    """Runs over what is there now and returns the latest row of each hour and place. Batches are written as they come, each whole or not at all."""
    spark = stream.sparkSession
    root = shared_dir(spark)
    found = latest_by_hour(stream, ts, place, payload, late).select(F.col("hour.start").alias("hour"), *place, "latest")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema.add("batch", "integer")).parquet(f"{root}/out")
    return rows.groupBy("hour", *place).agg(F.max_by("latest", "batch").alias("latest")).select("hour", *place, "latest.*")
