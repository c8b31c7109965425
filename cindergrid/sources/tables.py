"""Sources; columns and filters are pruned by Catalyst at the scan."""

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W, functions as F

from cindergrid.functions.exprs import nan_to_null
from cindergrid.streaming.feed import Rejected


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layer(spark, root, name, columns=None, box=None, lon="lon", lat="lat"):
    """A layer's rows, or those in a box (lon0, lat0, lon1, lat1), with the columns asked for; both reach the Parquet scan."""
    rows = spark.read.parquet(f"{root}/{name}")
    if box:
        rows = rows.filter(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]))
    return rows.select(*columns) if columns else rows


def only_row(df, condition, what="row"):
    """The one row that fits; an error if there is none or there are more."""
    rows = df.filter(condition)
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"one {what} is due, found {'more' if n else 'none'}")
    return rows


def detections_csv(spark, path, schema, box=None, first_day=None, last_day=None):
    """Rows of CSV files in a box (lon0, lat0, lon1, lat1) and between two days; files are split among tasks, malformed lines are left out."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    if box:
        rows = rows.filter(F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3]))
    day = F.col("acq_date").try_cast("date")
    for bound, ok in ((first_day, lambda d: day >= F.lit(d).cast("date")), (last_day, lambda d: day <= F.lit(d).cast("date"))):
        rows = rows.filter(ok(bound)) if bound else rows
    return rows


def csv_body(spark, body, schema):
    """Rows of a CSV text as a service sends it: blank or with no comma in its first line is an empty table, one that begins with 'invalid' is rejected.

    Fields may be quoted, with commas inside. Columns are told by their names; those that the text lacks are null, as are values that don't fit.
    """
    body = body.strip()
    if body.lower().startswith("invalid"):
        raise Rejected(body.splitlines()[0][:200])
    head, *lines = body.splitlines() or [""]
    if "," not in head:
        return spark.createDataFrame([], schema)
    names = next(csv.reader([head]))
    texts = ", ".join(f"`c{i}` string" for i in range(len(names)))
    rows = spark.createDataFrame([(x,) for x in lines if x.strip()], "line string").select(F.from_csv("line", F.lit(texts), {"escape": '"'}).alias("v"))
    kinds = {f.name: f.dataType for f in schema.fields}
    return rows.select(*[F.col(f"v.c{names.index(n)}").try_cast(t).alias(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in kinds.items()])


def pages(spark, root, schema):
    """All features of a paged service's answers, a JSON file for each page. An answer with an error fails the query, also where it came as a success."""
    whole = spark.read.schema(f"features array<{schema}>, error string, exceededTransferLimit boolean").option("multiLine", True).json(root)
    good = whole.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the service says: "), F.col("error"))).cast("boolean")))
    return good.select(F.explode("features").alias("f")).select("f.*")


def document(spark, path, schema):
    """A JSON document as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_of(spark, sources, schema):
    """(rows, status) of the first source that can be read, else an empty table; never an error. sources: name -> function without arguments."""
    tried = []
    for name, read in sources.items():
        try:
            rows = read()
            rows.take(1)
            return rows, {"source": name, "ok": True, "tried": tried}
        except (AnalysisException, ValueError, OSError, Rejected) as e:
            tried.append((name, str(e).splitlines()[0][:200]))
        except Exception as e:  # what a failed Spark job raises
            if "SparkException" not in type(e).__name__ and "Py4J" not in type(e).__name__:
                raise
            tried.append((name, str(e).splitlines()[0][:200]))
    return spark.createDataFrame([], schema), {"source": None, "ok": False, "tried": tried}


def byte_ranges(index, path="path", line="line", wanted=("UGRD", "VGRD", "GUST"), step="anl"):
    """path, message, first, last of the wanted messages. index: lines number:start:date:name:level:step. A range ends before the next message's start; the last is open. A file with
    another number of wanted messages than there are names fails the query."""
    from pyspark.sql import Window as W
    part = F.split(line, ":")
    rows = index.select(F.col(path), F.get(part, 1).try_cast("bigint").alias("first"), F.get(part, 3).alias("message"), F.get(part, 5).alias("_step")).filter("first is not null")
    rows = rows.withColumn("last", F.lead("first").over(W.partitionBy(path).orderBy("first")) - 1)
    rows = rows.filter((F.col("_step") == step) & F.col("message").isin(*wanted)).drop("_step")
    n = F.count("*").over(W.partitionBy(path))
    return rows.withColumn("_ok", F.when(n == len(wanted), F.lit(True)).otherwise(F.raise_error(F.lit("messages are missing")).cast("boolean"))).filter("_ok").drop("_ok")


def variable_name(xml, pattern=r'<grid name="([^"]+)"'):
    """Name of the grid that a service's XML describes; null if there is none."""
    return F.nullif(F.regexp_extract(xml, pattern, 1), F.lit(""))


def cube(parts, keys, day="day"):
    """One table of all variables: each variable's years under one another, then full joins on the keys. parts: variable -> list of tables (keys and the variable)."""
    tables = [reduce(lambda a, b: a.unionByName(b), years) for years in parts.values()]
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def masked(value, scale=1.0, nodata=-9000):
    """A raster's value times its scale; NaN and no-data (at most -9000 before scaling) are null."""
    return F.when(nan_to_null(value) > nodata, value * scale)
