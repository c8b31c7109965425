"""Files of rasters and cubes against arrays; the netCDF files are put together here, byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql.datasource import GreaterThan, LessThan, LessThanOrEqual

from cindergrid.sources import grids, tables


def test_raster_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {(r, c): (None if rng.random() < .1 else float(rng.normal())) for r in range(70) for c in range(12) if rng.random() < .95}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in want.items()], "row int, col int, value double")
    out = grids.write_rasters(cells, f"{tmp_path}/r", 100.0, 900.0, 5.0, 12, band=32).collect()
    assert sorted(r.rows for r in out) == [6, 32, 32] and not list((tmp_path / "r").glob("*.part"))
    got = grids.raster(spark, f"{tmp_path}/r").collect()
    assert len(got) == 70 * 12
    for r in got:
        row = round((900 - r.y) / 5 - .5)
        assert r.x == 100 + (r.col + .5) * 5 and r.value == want.get((row, r.col))


def test_only_strips_in_the_box_are_read(spark, tmp_path):
    values = np.arange(400.0).reshape(20, 20)
    (tmp_path / "a.tif").write_bytes(grids.tiff_bytes(values, 0.0, 20.0, 1.0, strip=4))
    reader = grids.TiffReader(str(tmp_path), {"y_min": "9", "y_max": "11", "x_min": "3", "x_max": "4.5"})
    parts = reader.partitions()
    assert [p.first for p in parts] == [8]
    got = sorted(r.value for r in grids.raster(spark, str(tmp_path), (3, 9, 4.5, 11)).collect())
    assert got == [183.0, 184.0, 203.0, 204.0]
    asked = grids.TiffReader(str(tmp_path), {})
    left = list(asked.pushFilters([GreaterThan(("y",), 9.0), LessThanOrEqual(("y",), 11.0), LessThan(("value",), 5.0)]))
    assert len(left) == 3 and [p.first for p in asked.partitions()] == [8]
    assert sorted(r.value for r in grids.raster(spark, str(tmp_path)).filter("y >= 9 and y <= 11 and x between 3 and 4.5").collect()) == got
    assert grids.raster(spark, str(tmp_path), (500, 0, 600, 1)).count() == 0


@pytest.mark.parametrize("kind, letter, fmt, bits", [("u1", "B", 1, 8), ("i2", "h", 2, 16), ("f4", "f", 3, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_other_layouts(spark, tmp_path, kind, letter, fmt, bits, order):
    """Plain strips of other kinds, in either byte order, of a file of one strip."""
    v = np.array([[1, 2, 3], [4, 5, 6]], f"{order}{kind}")
    raw = v.tobytes()
    fields = [(256, 3, 3), (257, 3, 2), (258, 3, bits), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(raw)), (339, 3, fmt)]
    doubles = struct.pack(f"{order}3d", 2, 2, 0) + struct.pack(f"{order}6d", 0, 0, 0, 10, 50, 0)
    at = 8 + len(raw)
    end = at + 2 + 12 * 11 + 4
    table = b"".join(struct.pack(f"{order}HHI", t, k, 1) + (struct.pack(f"{order}HH", x, 0) if k == 3 else struct.pack(f"{order}I", x)) for t, k, x in fields)
    table += struct.pack(f"{order}HHII", 33550, 12, 3, end) + struct.pack(f"{order}HHII", 33922, 12, 6, end + 24)
    mark = b"II*\0" if order == "<" else b"MM\0*"
    (tmp_path / "x.tif").write_bytes(mark + struct.pack(f"{order}I", at) + raw + struct.pack(f"{order}H", 11) + table + b"\0" * 4 + doubles)
    got = grids.raster(spark, str(tmp_path / "x.tif")).orderBy("row", "col").collect()
    assert [(r.x, r.y, r.value) for r in got] == [(11 + 2 * c, 49 - 2 * r, float(v[r, c])) for r in range(2) for c in range(3)]


def test_what_cannot_be_read_is_an_error(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"not a raster")
    with pytest.raises(ValueError, match="no TIFF"):
        grids.TiffReader(str(tmp_path), {}).partitions()
    (tmp_path / "a.nc").write_bytes(b"\x89HDF" + b"\0" * 90)
    with pytest.raises(ValueError, match="netCDF"):
        grids.NetCdfReader(str(tmp_path), "v", {})


def name(s):
    return struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")


def netcdf(version, records, dims, variables):
    """A classic file. dims: (name, size or 0); variables: name -> (dims, attributes, array)."""
    codes = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def attributes(a):
        return (struct.pack(">ii", 12, len(a)) if a else b"\0" * 8) + b"".join(name(k) + struct.pack(">ii", 6, 1) + struct.pack(">d", v) for k, v in a.items())

    def size(v):
        return -(-v[2].dtype.itemsize * int(np.prod(v[2].shape[1:] if record(v) else v[2].shape)) // 4) * 4

    def record(v):
        return bool(v[0]) and dims[v[0][0]][1] == 0
    kept = [v for v in variables.values() if record(v)]

    def head(starts):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(name(n) + struct.pack(">i", s) for n, s in dims) + b"\0" * 8 + struct.pack(">ii", 11, len(variables))
        for k, (n, v) in enumerate(variables.items()):
            out += name(n) + struct.pack(">i", len(v[0])) + struct.pack(f">{len(v[0])}i", *v[0]) + attributes(v[1]) + struct.pack(">ii", codes[v[2].dtype.str[1:]], size(v)) + struct.pack(">q" if version == 2 else ">i", starts[k])
        return out
    at, starts, body = len(head([0] * len(variables))), [], b""
    for v in variables.values():
        if not record(v):
            starts.append(at + len(body))
            raw = v[2].astype(v[2].dtype.newbyteorder(">")).tobytes()
            body += raw.ljust(size(v), b"\0")
        else:
            starts.append(None)
    step = 0
    for k, v in enumerate(variables.values()):
        if record(v):
            starts[k] = at + len(body) + step
            step += size(v)
    for r in range(records):
        for v in kept:
            raw = v[2][r].astype(v[2].dtype.newbyteorder(">")).tobytes()
            body += raw.ljust(size(v), b"\0") if len(kept) > 1 else raw
    return head(starts) + body


@pytest.mark.parametrize("version", [1, 2])
def test_cubes(spark, tmp_path, version):
    rng = np.random.default_rng(2)
    dims = [("day", 0), ("lat", 3), ("lon", 5)]
    rain, wind = rng.normal(size=(4, 3, 5)), rng.integers(-50, 50, (4, 3, 5)).astype("i2")
    wind[1, 2, 3] = -99
    lat = np.array([40.0, 41.0, 42.0], "f4")
    for n, part in ((2021, slice(0, 2)), (2022, slice(2, 4))):
        own = {"pr": ([0, 1, 2], {}, rain[part]), "vs": ([0, 1, 2], {"_FillValue": -99, "scale_factor": .1, "add_offset": 3}, wind[part]), "lat": ([1], {}, lat)}
        (tmp_path / f"w-{n}.nc").write_bytes(netcdf(version, 2, dims, own))
    for n, k in ((2021, 0), (2022, 2)):
        one = f"{tmp_path}/w-{n}.nc"
        got = {(r.day, r.lat, r.lon): r.pr for r in grids.cube_variable(spark, one, "pr").collect()}
        assert got == {(d, i, j): rain[k + d, i, j] for d in range(2) for i in range(3) for j in range(5)}
    got = {(r.day, r.lat, r.lon): r.vs for r in grids.cube_variable(spark, f"{tmp_path}/w-2021.nc", "vs", day=(1, 1), lon=(2, 3)).collect()}
    assert got == {(1, i, j): None if (i, j) == (2, 3) else pytest.approx(wind[1, i, j] * .1 + 3) for i in range(3) for j in (2, 3)}
    assert [r.lat for r in grids.cube_variable(spark, f"{tmp_path}/w-2022.nc", "lat").drop("file").toDF("i", "lat").orderBy("i").collect()] == lat.tolist()
    parts = grids.NetCdfReader(f"{tmp_path}", "pr", {"day_min": "1", "values": "15"}).partitions()
    assert [(p.where[-7:], p.first, p.count) for p in parts] == [("2021.nc", 1, 1), ("2022.nc", 1, 1)]
    both = tables.cube({v: [grids.cube_variable(spark, f"{tmp_path}/w-{n}.nc", v).selectExpr("'%d' || day as day" % n, "lat", "lon", v) for n in (2021, 2022)] for v in ("pr", "vs")}, ["day", "lat", "lon"])
    assert both.count() == 60 and both.filter("pr is null").count() == 0 and both.filter("vs is null").count() == 1


def test_one_record_variable_is_not_padded(spark, tmp_path):
    v = np.arange(9, dtype="i2").reshape(3, 3)
    (tmp_path / "a.nc").write_bytes(netcdf(1, 3, [("t", 0), ("x", 3)], {"v": ([0, 1], {}, v)}))
    assert [r.v for r in grids.cube_variable(spark, f"{tmp_path}/a.nc", "v").orderBy("t", "x").collect()] == list(range(9))
