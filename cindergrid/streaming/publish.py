"""Tables that are replaced whole: a version is written beside the others, then one pointer file is renamed over the old one.

Readers take the version that the pointer names, so they never see a part of one, nor rows of two writers; of two writers the later rename holds. A writer that fails leaves the pointer, and so what is published.
"""

import json
import uuid

from pyspark.sql import functions as F

POINTER = "CURRENT"


def _files(spark, path):
    """(Hadoop's file context of the path's store, a function that makes its paths)."""
    jvm = spark._jvm
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), spark._jsc.hadoopConfiguration()), make


def _switch(spark, root, text):
    """Puts the text in place of the pointer, by one rename that overwrites."""
    files, make = _files(spark, root)
    jvm, own = spark._jvm, f"{root}/.{uuid.uuid4().hex}.part"
    system = make(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(make(own), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(make(own), make(f"{root}/{POINTER}"), how)


def pointer(spark, root):
    """What the pointer says (version, rows, about), or None before the first version."""
    _, make = _files(spark, root)
    system, at = make(root).getFileSystem(spark._jsc.hadoopConfiguration()), make(f"{root}/{POINTER}")
    if not system.exists(at):
        return None
    source = system.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
    finally:
        source.close()


def publish(df, root, about=None, write=None):
    """Publishes the rows of df; gives the pointer. about: small values that go with the version; write: writes a table to a path, as Parquet by default."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    (write or (lambda rows, path: rows.write.parquet(path)))(df, f"{root}/{version}")
    rows = spark.read.schema(df.schema).parquet(f"{root}/{version}").count() if write is None else None
    now = {"version": version, "rows": rows, "about": about or {}}
    _switch(spark, root, json.dumps(now))
    return now


def published(spark, root):
    """The published rows; an error before the first version. The version is fixed when this is called."""
    now = pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{now['version']}").withColumn("version", F.lit(now["version"]))


def tidy(spark, root, keep=()):
    """Deletes the versions that neither the pointer nor keep names; for when no reader holds an older one. Gives how many went."""
    now = pointer(spark, root)
    _, make = _files(spark, root)
    system, gone = make(root).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for s in system.listStatus(make(root)):
        name = s.getPath().getName()
        if name.startswith("v-") and now and name != now["version"] and name not in keep:
            gone += bool(system.delete(s.getPath(), True))
    return gone


def publish_batches(rows, root, checkpoint, merge=None, **trigger):
    """A stream whose every batch replaces the published table. merge(published or None, batch) -> what is published; the batch alone by default.

    A batch that is tried again after a failure isn't merged a second time: the pointer tells which batch it came from.
    """
    def replace(batch, number):
        spark = batch.sparkSession
        now = pointer(spark, root)
        if now and now["about"].get("batch", -1) >= number:
            return
        before = published(spark, root).drop("version") if now else None
        publish(merge(before, batch) if merge else batch, root, {"batch": number})
    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
