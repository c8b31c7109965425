"""Numpy views of Arrow text: whole batches are handled as bytes, in blocks of bounded size."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cindergrid.operators import state

_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TABLE[IS_SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, np.uint64))


def utf8(column):
    """Bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offs


def blocks(column, limit=1 << 21, rows=1 << 16):
    """(first row, last row, bytes, offsets) of runs of at most so many rows and about limit bytes; a longer text is a run of its own."""
    data, offs = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data, offs, lower=True):
    """(64-bit hash, row, start, end) of each white-space separated word; text ends part words too."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    first = ~space
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    inner = offs[1:-1]
    before[inner[inner < len(data)]] = True
    starts = np.flatnonzero(first & before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    row = np.searchsorted(offs, starts, "right") - 1
    pos = np.arange(len(data))
    width = np.diff(np.append(starts, len(data)))
    place = pos[starts[0]:] - np.repeat(starts, width)
    h = np.add.reduceat(TABLE[(LOWER[data] if lower else data)[starts[0]:]] * POWER[place & 0xFFFF], starts - starts[0])
    after = np.append(np.flatnonzero(space), len(data))
    ends = np.minimum(after[np.searchsorted(after, starts)], offs[row + 1])
    return mix(h), row, starts, ends


def shingles(h, row, n):
    """Hashes of runs of n words within a row, and the index of their first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + m]
    at = np.flatnonzero(row[:m] == row[n - 1:])
    return mix(out[at]), at


def shared_dir(spark):
    """A new folder that driver and executors share, as the other operators' tables have."""
    return state.shared_dir(spark)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df):
    """The rows written to the shared folder and read again: cuts lineage and outlives executors. Shuffle files of the write go when it is done."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables):
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(numbers, size):
    """A foldable array of size long numbers, 0 where none is given."""
    return F.split(F.lit(",".join(str(numbers.get(b, 0)) for b in range(size))), ",").cast("array<bigint>")


def marked(rows, *names, size=1 << 20, probes=1):
    """A test for the names' values that is true of all that are in rows, and of few others unless there are more than size in rows.

    The table has size bits, however many rows there are; a full one only lets more through. Each row sets as many bits as probes: with rows for a sixth of the bits, one
    lets 15 % of the others through, three let 6 %.
    """
    def place(h):
        return F.floor(h / 64).cast("int"), (h % 64).cast("int")
    at = [F.pmod(F.xxhash64(*names, *[F.lit(j)] * (j > 0)), F.lit(size).cast("bigint")) for j in range(probes)]
    word, bit = place(F.col("at"))
    seen = rows.select(F.explode(F.array(*at)).alias("at")).groupBy(word.alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("v")).collect()
    table = bounded({r.k: r.v for r in seen}, size // 64)
    return reduce(lambda x, y: x & y, [F.call_function("getbit", F.get(table, word), bit) == 1 for word, bit in map(place, at)])


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def mapped(df, run, schema):
    """df.mapInArrow in batches of at most BATCH_ROWS rows, for rows with texts.

    Executor and Python each hold a batch several times, and batches are bounded by rows. The bound counts when the rows are asked for, so the session keeps it; a smaller one of its own stays.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def batches(names, types):
    """Schema of output columns."""
    return pa.schema([pa.field(n, t) for n, t in zip(names, types)])
