from pyspark.sql import SparkSession


def session(cores="*", shuffle=8):
    return (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
