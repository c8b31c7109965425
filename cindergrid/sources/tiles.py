"""A pyramid of picture tiles over a raster, for maps: each level has half the rows and columns of the one before, and every tile is a PNG file made by a task of its own."""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cindergrid.sources.grids import put

TOP = 65535


def png(grey, alpha):
    """A PNG file of 16-bit grey and alpha; rows from the top."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    high, wide = grey.shape
    rows = np.stack([grey, alpha], axis=2).astype(">u2").reshape(high, -1).view(np.uint8)
    # Each row begins with the number of its filter: 0, none.
    data = np.concatenate([np.zeros((high, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 16, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def pyramid(cells, levels):
    """level, row, col, value: the raster, and at each further level the mean of the values under each cell (nulls left out). cells: row, col, value; equal places are averaged."""
    sums = cells.filter(F.col("value").isNotNull()).groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.sum(F.col("value").cast("double")).alias("_s"), F.count("*").alias("_n"))
    out = sums.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        sums = sums.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        out = out.unionByName(sums.withColumn("level", F.lit(level)))
    return out.select("level", "row", "col", (F.col("_s") / F.col("_n")).alias("value"))


def write_tiles(cells, root, low, high, levels=4, side=256):
    """Tiles of side x side pixels in files root/level/tile row/tile column.png; a row for each: level, row, col, path, cells. Grey goes from low (0) to high (TOP), values beyond are held there; places without a value are clear."""
    def encode(key, table):
        level, r, c = (k.as_py() for k in key)
        at = tuple(table.column(n).to_numpy() % side for n in ("row", "col"))
        grey, alpha = np.zeros((side, side), np.uint16), np.zeros((side, side), np.uint16)
        share = (table.column("value").to_numpy() - low) / (high - low) if high > low else np.zeros(len(table))
        grey[at], alpha[at] = np.rint(np.clip(share, 0, 1) * TOP), TOP
        path = f"{root}/{level}/{r}/{c}.png"
        put(path, png(grey, alpha))
        return pa.table({"level": pa.array([level], pa.int32()), "row": [r], "col": [c], "path": [path], "cells": [len(table)]})
    rows = pyramid(cells, levels).withColumns({"_r": F.floor(F.col("row") / side), "_c": F.floor(F.col("col") / side)})
    return rows.groupBy("level", "_r", "_c").applyInArrow(encode, "level int, row long, col long, path string, cells long")
