"""Detections as features, documents and summaries."""

from functools import reduce

from pyspark.sql import functions as F

from cindergrid.functions.exprs import confidence_label
from cindergrid.functions.times import instant, iso_z


def rounded_half_even(c, places):
    """Rounding by scaling, ties to the even digit, as in IEEE arithmetic."""
    return F.rint(c * 10**places) / 10**places


def redacted(text, secret):
    """text without the secret; an empty secret changes nothing."""
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def normalised(raw, source):
    """Raw detections with acq_utc, confidence_label, is_vegetation_fire and source; rows without a place or a readable instant go.

    A missing type column means that all are vegetation fires.
    """
    kind = F.coalesce(F.col("type") == 0, F.lit(False)) if "type" in raw.columns else F.lit(True)
    out = raw.withColumns({"acq_utc": instant(F.col("acq_date"), F.col("acq_time")), "confidence_label": confidence_label(F.col("confidence").cast("string")), "is_vegetation_fire": kind, "source": F.lit(source)})
    return out.filter("acq_utc is not null and latitude is not null and longitude is not null")


def combined(feeds):
    """All feeds under one another; columns that a feed lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def feature(lat, lon, properties):
    """A GeoJSON point feature with coordinates of 5 places. properties: name -> column."""
    point = F.struct(F.lit("Point").alias("type"), F.array(rounded_half_even(lon, 5), rounded_half_even(lat, 5)).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"))


def features(detections):
    """One feature for each detection; a missing power is 0."""
    frp = F.coalesce(F.nanvl("frp", F.lit(0.0)), F.lit(0.0))
    return detections.select(feature(F.col("latitude"), F.col("longitude"), {
        "acq_utc": iso_z(F.col("acq_utc")), "source": F.col("source"), "confidence_label": F.col("confidence_label"), "frp_mw": frp, "is_vegetation_fire": F.col("is_vegetation_fire")}).alias("feature"))


def collection(detections, generated, disclaimer, most=200_000):
    """A FeatureCollection in one row, for feeds of at most so many features; larger ones are written by write_features, a line each."""
    rows = features(detections)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} features: write them line by line")
    return rows.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("feature").alias("features"), F.struct(F.lit(disclaimer).alias("disclaimer"), F.lit(generated).alias("generated_utc")).alias("properties"))).alias("document"))


FEATURES = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<acq_utc:string,confidence_label:string,frp_mw:double,is_vegetation_fire:boolean>>>>"


def summary(documents, column="document"):
    """Counts of a document's features, and the largest power or 0."""
    own = F.from_json(column, FEATURES)["features"]
    fire = F.filter(own, lambda f: f["properties"]["is_vegetation_fire"])
    return documents.select("*", F.coalesce(F.size(own), F.lit(0)).alias("total"), F.coalesce(F.size(fire), F.lit(0)).alias("vegetation"),
                            F.coalesce(F.size(own) - F.size(fire), F.lit(0)).alias("other"), F.coalesce(F.array_max(F.transform(own, lambda f: f["properties"]["frp_mw"])), F.lit(0.0)).alias("max_frp"))


def metadata(detections, status, generated, day_range, bbox):
    """The feed's description in one row. status: a row (source, ok, rows, error, permanent) for each source, which are few."""
    mix = detections.groupBy("confidence_label").count()
    mix = mix.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("confidence_label", "count")))).alias("confidence_mix"))
    of = status.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.struct("ok", "rows", "error", "permanent"))))).alias("sources"))
    total = detections.agg(F.count("*").alias("total_detections"), F.count_if("is_vegetation_fire").alias("vegetation_fire_detections"), iso_z(F.max("acq_utc")).alias("latest_detection_utc"))
    out = total.crossJoin(mix).crossJoin(of)
    return out.withColumns({"generated_utc": F.lit(generated), "day_range": F.lit(day_range), "bbox": F.array(*map(F.lit, bbox)), "data_is_unverified": F.lit(True), "not_an_official_source": F.lit(True)})
