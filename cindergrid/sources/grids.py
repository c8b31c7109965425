"""Rasters and cubes of numbers in files, as Spark data sources: each task reads the bytes of one strip or a run of records, and only those that a box asks for.

Rasters are TIFF files of one band in strips (plain or deflated; integers or floats of 8 to 64 bits), placed by pixel size and tie point. Cubes are
classic netCDF files (versions 1 and 2). Other layouts raise an error. Paths may be a file, a folder, or the address of any store that pyarrow opens; headers are read on the driver, values in tasks.
"""

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def opened(path):
    """(file system, path in it)."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def files(path, ends):
    """The file, or those of the folder with one of the endings, in order."""
    store, where = opened(path)
    if store.get_file_info(where).type == fs.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(where, recursive=True)) if f.is_file and f.path.endswith(ends))
    return [where]


def part_of(path, where, start, size):
    store, _ = opened(path)
    with store.open_input_file(where) as f:
        return f.read_at(size, start)


# TIFF: sizes and letters of the field types that are read, by their fixed numbers, and the numbers of the fields.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, PACKING, STARTS, BANDS, ROWS, SIZES, PREDICTOR, TILES, FORMAT, PIXEL, TIE, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339, 33550, 33922, 42113
LETTERS = {1: "u", 2: "i", 3: "f"}


def tiff_header(path, where):
    """The fields of a file's first image, and its byte order."""
    start = part_of(path, where, 0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(start[:4])
    if order is None:
        raise ValueError(f"{where} is no TIFF file of 32-bit offsets")
    at = struct.unpack(f"{order}I", start[4:])[0]
    n = struct.unpack(f"{order}H", part_of(path, where, at, 2))[0]
    table, out = part_of(path, where, at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", table[12 * k:12 * k + 8])
        if kind in TYPES:
            size, letter = TYPES[kind]
            raw = table[12 * k + 8:12 * k + 12] if size * count <= 4 else part_of(path, where, struct.unpack(f"{order}I", table[12 * k + 8:12 * k + 12])[0], size * count)
            out[tag] = raw[:count] if letter == "s" else struct.unpack(f"{order}{count}{letter}", raw[:size * count])
    if TILES in out or out.get(BANDS, (1,))[0] != 1 or out.get(PACKING, (1,))[0] not in (1, 8, 32946) or out.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError(f"{where}: only one band in strips, plain or deflated, can be read")
    return out, order


class Strip(InputPartition):
    def __init__(self, where, first, rows, start, size, about):
        self.where, self.first, self.rows, self.start, self.size, self.about = where, first, rows, start, size, about


class Box:
    """Least and greatest values of columns, from options and pushed filters."""

    def __init__(self, options, names):
        self.ends = {n: [float(options.get(f"{n}_min", "-inf")), float(options.get(f"{n}_max", "inf"))] for n in names}

    def take(self, filters):
        """Narrows the box by the filters that it can; yields all, since a bound that isn't sharp has to be tried again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.ends and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.ends[name][0] = max(self.ends[name][0], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.ends[name][1] = min(self.ends[name][1], f.value)
            yield f

    def meets(self, name, low, high):
        return high >= self.ends[name][0] and low <= self.ends[name][1]

    def inside(self, name, values):
        return (values >= self.ends[name][0]) & (values <= self.ends[name][1])


class TiffReader(DataSourceReader):
    def __init__(self, path, options):
        self.path, self.box = path, Box(options, ("x", "y"))

    def pushFilters(self, filters):
        yield from self.box.take(filters)

    def partitions(self):
        out = []
        for where in files(self.path, (".tif", ".tiff")):
            f, order = tiff_header(self.path, where)
            wide, high, (sx, sy, *_), tie = f[WIDTH][0], f[HEIGHT][0], f[PIXEL], f[TIE]
            left, top = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
            about = {"wide": wide, "left": left, "top": top, "sx": sx, "sy": sy, "kind": f"{order}{LETTERS[f.get(FORMAT, (1,))[0]]}{f[BITS][0] // 8}", "packed": f.get(PACKING, (1,))[0] != 1, "nodata": float(f[NODATA].strip(b"\0 ")) if NODATA in f else None}
            each = f.get(ROWS, (high,))[0]
            for k, (start, size) in enumerate(zip(f[STARTS], f[SIZES])):
                rows = min(each, high - k * each)
                if self.box.meets("y", top - (k * each + rows - .5) * sy, top - (k * each + .5) * sy) and self.box.meets("x", left + sx / 2, left + (wide - .5) * sx):
                    out.append(Strip(where, k * each, rows, start, size, about))
        return out or [Strip("", 0, 0, 0, 0, {})]

    def read(self, p):
        if p.rows:
            a, raw = p.about, part_of(self.path, p.where, p.start, p.size)
            values = np.frombuffer(zlib.decompress(raw) if a["packed"] else raw, a["kind"])[:p.rows * a["wide"]].reshape(p.rows, a["wide"]).astype(float)
            x, y = a["left"] + (np.arange(a["wide"]) + .5) * a["sx"], a["top"] - (p.first + np.arange(p.rows) + .5) * a["sy"]
            rows, cols = np.flatnonzero(self.box.inside("y", y)), np.flatnonzero(self.box.inside("x", x))
            own = values[np.ix_(rows, cols)].ravel()
            gone = np.isnan(own) if a["nodata"] is None else np.isnan(own) | (own == a["nodata"])
            r, c = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
            yield pa.record_batch([pa.array(np.full(len(own), p.where)), pa.array(p.first + r), pa.array(c), pa.array(x[c]), pa.array(y[r]), pa.array(own, mask=gone)], names=["file", "row", "col", "x", "y", "value"])


class Tiff(DataSource):
    """file, row, col, x, y (the pixel's centre) and value, null where there is none. Options x_min, x_max, y_min, y_max: only the strips that meet this box are read."""

    @classmethod
    def name(cls):
        return "tiff_band"

    def schema(self):
        return "file string, row long, col long, x double, y double, value double"

    def reader(self, schema):
        return TiffReader(self.options["path"], self.options)


def tiff_bytes(values, left, top, size, strip=64, nodata=-9999.0):
    """A TIFF file of doubles, deflated in strips of so many rows; NaN is written as the no-data value."""
    high, wide = values.shape
    data = np.where(np.isnan(values), nodata, values).astype("<f8")
    strips = [zlib.compress(data[k:k + strip].tobytes()) for k in range(0, high, strip)]
    starts = (8 + np.cumsum([0, *map(len, strips[:-1])])).tolist()
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    fields = [(WIDTH, 4, [wide]), (HEIGHT, 4, [high]), (BITS, 3, [64]), (PACKING, 3, [8]), (262, 3, [1]), (STARTS, 4, starts), (BANDS, 3, [1]), (ROWS, 4, [strip]), (SIZES, 4, [len(s) for s in strips]), (FORMAT, 3, [3]),
              (PIXEL, 12, [size, size, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (NODATA, 2, f"{nodata:g}\0".encode())]
    at, table, more = 8 + len(body), b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind][1]}", *v)
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, len(v), after + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            table += struct.pack("<HHI4s", tag, kind, len(v), raw.ljust(4, b"\0"))
    return struct.pack("<4sI", b"II*\0", at) + body + struct.pack("<H", len(fields)) + table + b"\0" * 4 + more


def put(path, data):
    """Writes a file under another name and renames it, so that readers never see a part of it."""
    store, where = opened(path)
    store.create_dir(posixpath.dirname(where), recursive=True)
    own = f"{where}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, where)


def write_rasters(cells, path, left, top, size, wide, band=256):
    """A TIFF file for each band of so many rows of a raster, each by a task of its own; a row for each file: path, rows. cells: row (from the top), col, value; the first value of a repeated cell stays, cells outside of 0..wide-1 are an error."""
    def write(key, table):
        k = key[0].as_py()
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        if len(col) and (col.min() < 0 or col.max() >= wide):
            raise ValueError("a cell lies outside of the raster")
        values = np.full((int(row.max()) - k * band + 1, wide), np.nan)
        order = np.arange(len(row))[::-1]
        values[row[order] - k * band, col[order]] = table.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)[order]
        put(f"{path}/band-{k:06d}.tif", tiff_bytes(values, left, top - k * band * size, size))
        return pa.table({"path": [f"{path}/band-{k:06d}.tif"], "rows": pa.array([len(values)], pa.int64())})
    own = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), F.floor(F.col("row") / band).alias("_band"))
    return own.groupBy("_band").applyInArrow(write, "path string, rows long")


# Classic netCDF: the type numbers, and the marks of the header's lists.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class Header:
    """Dimensions and variables of a classic netCDF file."""

    def __init__(self, path, where, most=1 << 24):
        self.data, self.at = part_of(path, where, 0, 1 << 16), 4
        self.more = lambda: part_of(path, where, 0, most)
        if self.data[:3] != b"CDF" or self.data[3] not in (1, 2):
            raise ValueError(f"{where} is no classic netCDF file")
        wide = self.data[3] == 2
        self.records = self.number()
        self.dims = self.listed(lambda: (self.text(), self.number()))
        self.attributes()
        self.variables = {}
        for name, (dims, about, kind, size, start) in self.listed(lambda: (self.text(), ([self.number() for _ in range(self.number())], self.attributes(), self.number(), self.number(), self.number(8 if wide else 4)))):
            self.variables[name] = {"dims": dims, "about": about, "kind": np.dtype(KINDS[kind]), "size": size, "start": start}
        kept = [v for v in self.variables.values() if v["dims"] and not self.dims[v["dims"][0]][1]]
        for v in self.variables.values():
            v["record"] = v in kept if v["dims"] else False
            v["shape"] = [self.records if k == 0 and v["record"] else self.dims[d][1] for k, d in enumerate(v["dims"])]
            v["names"] = [self.dims[d][0] for d in v["dims"]]
        exact = lambda v: v["kind"].itemsize * int(np.prod(v["shape"][1:]))
        self.step = exact(kept[0]) if len(kept) == 1 else sum(-(-exact(v) // 4) * 4 for v in kept)

    def take(self, n):
        if self.at + n > len(self.data):
            self.data = self.more()
            if self.at + n > len(self.data):
                raise ValueError("the header is cut off")
        self.at += n
        return self.data[self.at - n:self.at]

    def number(self, size=4):
        return int.from_bytes(self.take(size), "big", signed=size == 4)

    def text(self):
        n = self.number()
        return self.take(-(-n // 4) * 4)[:n].decode()

    def listed(self, item):
        self.number()
        return [item() for _ in range(self.number())]

    def attributes(self):
        def value():
            name, kind, n = self.text(), np.dtype(KINDS[self.number()]), self.number()
            raw = self.take(-(-n * kind.itemsize // 4) * 4)[:n * kind.itemsize]
            return name, raw if kind.kind == "S" else np.frombuffer(raw, kind).astype(float)
        return dict(self.listed(value))


class Run(InputPartition):
    def __init__(self, where, first, count):
        self.where, self.first, self.count = where, first, count


class NetCdfReader(DataSourceReader):
    def __init__(self, path, name, options):
        self.path, self.name = path, name
        self.heads = {w: Header(path, w) for w in files(path, (".nc", ".cdf"))}
        v = next(iter(self.heads.values())).variables[name]
        self.names, self.box, self.each = v["names"], Box(options, v["names"]), int(options.get("values", 1 << 20))
        for h in self.heads.values():
            h.more = None

    def pushFilters(self, filters):
        yield from self.box.take(filters)

    def partitions(self):
        """Runs of the first dimension, about so many values each, within the box."""
        out = []
        for where, h in self.heads.items():
            shape = h.variables[self.name]["shape"]
            low, high = (self.box.ends[self.names[0]] if self.names else (-np.inf, np.inf))
            first, end = int(max(0, np.ceil(low))), int(min((shape or [1])[0], np.floor(high) + 1))
            step = max(1, self.each // max(1, int(np.prod(shape[1:]))))
            out += [Run(where, k, min(step, end - k)) for k in range(first, end, step)]
        return out or [Run("", 0, 0)]

    def read(self, p):
        if not p.count:
            return
        h = self.heads[p.where]
        v = h.variables[self.name]
        inner = v["shape"][1:]
        width = v["kind"].itemsize * int(np.prod(inner))
        gap = h.step if v["record"] else width
        raw = np.frombuffer(part_of(self.path, p.where, v["start"] + p.first * gap, (p.count - 1) * gap + width), np.uint8)
        raw = np.lib.stride_tricks.as_strided(raw, (p.count, width), (gap, 1)).copy()
        values = raw.view(v["kind"]).astype(float).reshape([p.count, *inner] if v["dims"] else [])
        for mark in ("_FillValue", "missing_value"):
            if mark in v["about"]:
                values = np.where(values == v["about"][mark][0], np.nan, values)
        values = values * v["about"].get("scale_factor", [1.0])[0] + v["about"].get("add_offset", [0.0])[0]
        places = [np.arange(p.first, p.first + p.count), *map(np.arange, inner)] if v["dims"] else []
        some = [np.flatnonzero(self.box.inside(n, x)) for n, x in zip(self.names, places)]
        own = values[np.ix_(*some)].ravel() if some else values.reshape(1)
        at = np.meshgrid(*[x[s] for x, s in zip(places, some)], indexing="ij") if some else []
        yield pa.record_batch([pa.array(np.full(len(own), p.where)), *[pa.array(a.ravel().astype(np.int64)) for a in at], pa.array(own, mask=np.isnan(own))], names=["file", *self.names, "value"])


class NetCdf(DataSource):
    """file, a number from 0 for each dimension of the variable, and value (scaled; null where it is missing). Options: variable; day_min, day_max and so on for each dimension's bounds."""

    @classmethod
    def name(cls):
        return "classic_netcdf"

    def made(self):
        return NetCdfReader(self.options["path"], self.options["variable"], self.options)

    def schema(self):
        return ", ".join(["file string", *[f"{n} long" for n in self.made().names], "value double"])

    def reader(self, schema):
        return self.made()


def reading(spark, source):
    """A reader of the source. Filters reach Python sources only in sessions that say so, so this turns that on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def raster(spark, path, box=None):
    """The pixels of the TIFF files at a path, or those with centres in a box (x0, y0, x1, y1); filters on x and y narrow what is read, too."""
    read = reading(spark, Tiff)
    for name, value in zip(("x_min", "y_min", "x_max", "y_max"), box or ()):
        read = read.option(name, value)
    return read.load(path)


def cube_variable(spark, path, variable, **bounds):
    """One variable of the netCDF files at a path, as rows with the variable's name for value. bounds: dimension -> (first, last); filters on dimensions narrow what is read, too."""
    read = reading(spark, NetCdf).option("variable", variable)
    for name, (first, last) in bounds.items():
        read = read.option(f"{name}_min", first).option(f"{name}_max", last)
    return read.load(path).withColumnRenamed("value", variable)
