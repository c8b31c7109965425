"""Sinks. Every writer replaces what was there; tables are written by all tasks."""

from pyspark.sql import functions as F

from cindergrid.functions.feed import features


def write_layers(layers, root):
    """Each table of a dict to a folder of its own."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_sorted(df, path, *order, by=None):
    """Parquet in ranges of the order, each sorted, so that readers skip row groups; by: column of folders."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def write_compact(df, path):
    """Parquet with doubles as floats, compressed by zstd."""
    floats = {c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}
    df.withColumns(floats).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_features(detections, path):
    """A GeoJSON feature a line, by all tasks."""
    features(detections).select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def write_document(one_row, path):
    """A table of one row as one JSON line."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def write_top(df, path, *order, n=50):
    """The first n rows as a CSV file with names."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path, about):
    """A fitted pipeline and, beside it, a one-row table about it."""
    model.write().overwrite().save(f"{path}/model")
    about.write.mode("overwrite").json(f"{path}/about")


def report(title, **tables):
    """Markdown text with a table for each small result (at most 200 rows are shown)."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(200).collect()
        out += ["", f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{'-|' * len(df.columns)}", *[f"| {' | '.join(f'{v:.4f}' if isinstance(v, float) else str(v) for v in r)} |" for r in rows]]
    return "\n".join(out) + "\n"


def stretched(value, low, high):
    """Value from 0 to 1 between two bounds, held there."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))


def ramp(share, stops):
    """Piecewise linear value at a share. stops: (share, value) in order."""
    out = F.lit(float(stops[-1][1]))
    for (a, x), (b, y) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(share <= b, x + (y - x) * F.greatest(F.lit(0.0), (share - a) / (b - a))).otherwise(out)
    return out
