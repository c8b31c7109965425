"""Tiles are decoded by hand and held against the table's cells at every level."""

import struct
import zlib

import numpy as np
import pytest

from cindergrid.sources import tiles


def decoded(path):
    data, at, body = open(path, "rb").read(), 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at:at + 8])
        part = data[at + 8:at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n:at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            wide, high = struct.unpack(">II", part[:8])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(high, 1 + 4 * wide)
    assert (rows[:, 0] == 0).all()
    return rows[:, 1:].copy().view(">u2").reshape(high, wide, 2)


def test_tiles_hold_the_cells_of_every_level(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("cast(p_partkey div 20 as int) as row", "cast(p_partkey % 20 as int) as col", "case when p_size > 4 then p_retailprice end as value")
    want = {}
    for r in part.filter("value is not null").collect():
        for level in range(4):
            want.setdefault((level, r.row >> level, r.col >> level), []).append(r.value)
    low, high = 900.0, 1900.0
    made = tiles.write_tiles(part, str(tmp_path / "t"), low, high, levels=3, side=4).collect()
    got = {}
    for t in made:
        image = decoded(t.path)
        for i, j in zip(*np.nonzero(image[:, :, 1])):
            got[t.level, t.row * 4 + int(i), t.col * 4 + int(j)] = low + int(image[i, j, 0]) / tiles.TOP * (high - low)
        assert (image[:, :, 1] > 0).sum() == t.cells
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(min(max(np.mean(v), low), high), abs=.01) for k, v in want.items())
    assert tiles.write_tiles(part.limit(0), str(tmp_path / "none"), 0, 1).count() == 0
