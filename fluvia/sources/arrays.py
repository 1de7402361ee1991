"""Array files as Spark data sources: netCDF classic and GeoTIFF.

The header is parsed when a read is planned; a partition is a range of records, or a run of strips or tiles, and reads
its own bytes alone. Ranges asked for, by options or by filters that Spark hands down, leave the others out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from fluvia.session import ship

#: Values of a partition, about.
VALUES = 1 << 21


def open_file(path: str):
    """A file that can be read from any place; plain paths, or what pyarrow's file systems reach."""
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
    return where.open_input_file(name)


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the file ends too early")
    return data


class Ranges:
    """Closed ranges of columns that are asked for, from options and filters."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.low = {c: float(options.get(f"{c}.from".lower(), -inf)) for c in columns}
        self.high = {c: float(options.get(f"{c}.to".lower(), inf)) for c in columns}

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the ranges; all filters go back to Spark, which applies them to the rows that are left."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if name in self.low and isinstance(value, (int, float)) and not isinstance(value, bool):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], value)
            yield f


# ---- netCDF classic

#: Types of the format by their numbers.
_NC = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    dtype: np.dtype
    begin: int


@dataclass
class Header:
    """Of a netCDF classic file: names and lengths of dimensions, variables, the number of records and a record's bytes."""

    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable]
    records: int
    record_bytes: int = 0
    record: int | None = None

    def shape(self, v: Variable) -> list[int]:
        return [self.records if d == self.record else self.dims[d][1] for d in v.dims]


class _Reader:
    """Reads a header piece by piece."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            self.file.seek(len(self.data))
            more = self.file.read(1 << 16)
            if not more:
                raise ValueError("the header ends too early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str = ">i") -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def netcdf_header(file) -> Header:
    """Parse the header of formats 1 (classic), 2 (64-bit offsets) and 5 (64-bit data)."""
    r = _Reader(file)
    if r.take(3) != b"CDF" or (version := r.take(1)[0]) not in (1, 2, 5):
        raise ValueError("not a netCDF classic file")
    size, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")

    def name() -> str:
        n = r.number(size)
        return r.take(-(-n // 4) * 4)[:n].decode()

    def items(tag: int) -> range:
        found, n = r.number(), r.number(size)
        if found not in (0, tag):
            raise ValueError("the header is damaged")
        return range(n if found else 0)

    def attributes() -> dict:
        out = {}
        for _ in items(_ATTRIBUTES):
            key, kind, n = name(), r.number(), r.number(size)
            dtype = np.dtype(_NC[kind])
            raw = r.take(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
            out[key] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    records = r.number(size)
    dims = [(name(), r.number(size)) for _ in items(_DIMENSIONS)]
    head = Header(dims, attributes(), {}, records)
    head.record = next((i for i, (_, n) in enumerate(dims) if n == 0), None)
    sizes = []
    for _ in items(_VARIABLES):
        key, ids = name(), [r.number(size) for _ in range(r.number(size))]
        extra, kind, _, begin = attributes(), r.number(), r.number(size), r.number(offset)
        head.variables[key] = v = Variable(key, ids, extra, np.dtype(_NC[kind]), begin)
        if ids and ids[0] == head.record:
            sizes.append(v.dtype.itemsize * int(np.prod([dims[d][1] for d in ids[1:]], initial=1)))
    # A single record variable isn't padded.
    head.record_bytes = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
    if head.records < 0:  # being written: as many as the file holds
        file.seek(0, 2)
        begins = [v.begin for v in head.variables.values() if v.dims and v.dims[0] == head.record]
        head.records = max(0, (file.tell() - min(begins)) // head.record_bytes) if begins and head.record_bytes else 0
    return head


def netcdf_slab(file, head: Header, v: Variable, first: int, n: int) -> np.ndarray:
    """n steps of the first dimension of a variable from `first` on, as they stand in the file; other bytes aren't read,
    but for those between records."""
    shape = head.shape(v)
    if not shape:
        return np.frombuffer(_read(file, v.begin, v.dtype.itemsize), v.dtype)
    step = v.dtype.itemsize * int(np.prod(shape[1:], initial=1))
    if v.dims[0] != head.record:
        return np.frombuffer(_read(file, v.begin + first * step, n * step), v.dtype).reshape(n, *shape[1:])
    rows = [_read(file, v.begin + (first + i) * head.record_bytes, step) for i in range(n)]
    return np.frombuffer(b"".join(rows), v.dtype).reshape(n, *shape[1:])


def decoded(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """Values as doubles: fill values are NaN, and scale and offset are applied."""
    one = lambda key, default: attributes[key][0] if isinstance(attributes.get(key), list) else default
    out = raw.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in attributes and isinstance(attributes[key], list):
            out[np.isin(raw, np.array(attributes[key], raw.dtype))] = np.nan
    return out * one("scale_factor", 1.0) + one("add_offset", 0.0)


@dataclass
class Slab(InputPartition):
    first: int
    n: int


class NetcdfSource(DataSource):
    """format("netcdf"): options path and variable. A row for each value: a column for each dimension, its coordinate where the file
    has a variable of that name, else its place from 0 as a double, and value, null where filled. Options <dimension>.from and
    <dimension>.to, and filters on the first dimension, choose the records that are read."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _head(self) -> tuple[Header, Variable]:
        with open_file(self.options["path"]) as file:
            head = netcdf_header(file)
        if self.options["variable"] not in head.variables:
            raise ValueError(f"no variable {self.options['variable']!r}; there are {', '.join(head.variables)}")
        return head, head.variables[self.options["variable"]]

    def schema(self) -> str:
        head, v = self._head()
        return ", ".join([*(f"`{head.dims[d][0]}` double" for d in v.dims), "value double"])

    def reader(self, schema) -> DataSourceReader:
        return NetcdfReader(self.options["path"], *self._head(), {k.lower(): x for k, x in self.options.items()})


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, head: Header, v: Variable, options: dict[str, str]):
        self.path, self.head, self.v = path, head, v
        self.names = [head.dims[d][0] for d in v.dims]
        self.ranges = Ranges(options, self.names)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.ranges.push(filters)

    def _axis(self, file, k: int) -> np.ndarray:
        """Coordinates of the k-th dimension."""
        own = self.head.variables.get(self.names[k])
        n = self.head.shape(self.v)[k]
        if own is None or own.dims != [self.v.dims[k]] or own.dtype.kind == "S":
            return np.arange(n, dtype=float)
        return decoded(netcdf_slab(file, self.head, own, 0, n), own.attributes)

    def partitions(self) -> list[Slab]:
        shape = self.head.shape(self.v)
        if not shape:
            return [Slab(0, 1)]
        with open_file(self.path) as file:
            axis = self._axis(file, 0)
        wanted = np.flatnonzero((axis >= self.ranges.low[self.names[0]]) & (axis <= self.ranges.high[self.names[0]]))
        each = max(1, VALUES // max(1, int(np.prod(shape[1:], initial=1))))
        out = []
        # Runs of wanted steps, in pieces.
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else []:
            out += [Slab(int(run[i]), len(run[i : i + each])) for i in range(0, len(run), each)]
        return out or [Slab(0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        shape = self.head.shape(self.v)
        if not partition.n:
            return
        with open_file(self.path) as file:
            axes = [self._axis(file, k) for k in range(len(shape))]
            if axes:
                axes[0] = axes[0][partition.first : partition.first + partition.n]
            keep = [np.flatnonzero((a >= self.ranges.low[c]) & (a <= self.ranges.high[c])) for a, c in zip(axes, self.names, strict=True)]
            # A step at a time where one is large.
            each = max(1, VALUES // max(1, int(np.prod(shape[1:], initial=1))))
            for at in range(0, partition.n, each):
                n = min(each, partition.n - at)
                part = decoded(netcdf_slab(file, self.head, self.v, partition.first + at, n), self.v.attributes)
                own = [k for k in keep]
                if own:
                    own[0] = keep[0][(keep[0] >= at) & (keep[0] < at + n)]
                    part = part[np.ix_(own[0] - at, *own[1:])]
                grid = np.meshgrid(*(a[k] for a, k in zip(axes, own, strict=True)), indexing="ij") if own else []
                flat = part.ravel()
                yield pa.RecordBatch.from_arrays([*(pa.array(g.ravel()) for g in grid), pa.array(flat, mask=np.isnan(flat))], [*self.names, "value"])


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    """Spark hands filters down to sources in Python only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark).dataSource.register(source)


#: Seconds of the units that times are counted in.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def cf_timestamp(steps: Column, units: str) -> Column:
    """Times from numbers 'days since 1900-01-01 00:00:00' and the like, in the standard calendar and UTC."""
    unit, _, start = units.strip().partition(" since ")
    unit = unit.strip().lower().rstrip("s")
    if unit not in UNITS or not start:
        raise ValueError(f"not a unit of time: {units!r}")
    epoch = F.unix_micros(F.to_timestamp(F.lit(start.strip().replace("T", " "))))
    return F.timestamp_micros((epoch + F.round(steps * UNITS[unit] * 1_000_000)).cast("long"))


def read_netcdf(spark: SparkSession, path: str, variable: str, **ranges: tuple[float, float]) -> DataFrame:
    """A variable of a netCDF classic file as rows (see NetcdfSource); ranges: dimension=(from, to), both ends included."""
    _register(spark, NetcdfSource)
    reader = spark.read.format("netcdf").option("path", path).option("variable", variable)
    for name, (low, high) in ranges.items():
        reader = reader.option(f"{name}.from", str(low)).option(f"{name}.to", str(high))
    return reader.load()


def netcdf_info(path: str) -> Header:
    """Dimensions, attributes and variables of a file, from its header alone."""
    with open_file(path) as file:
        return netcdf_header(file)


# ---- GeoTIFF

#: Bytes of the types of tags, and their formats.
_TIFF = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Raster:
    """What a GeoTIFF's tags say: shape, blocks (strips or tiles), number type, and how cells lie."""

    rows: int
    cols: int
    bands: int
    block: tuple[int, int]
    offsets: list[int]
    counts: list[int]
    dtype: np.dtype
    compression: int = _NONE
    predictor: int = 1
    separate: bool = False
    none: float | None = None
    size: tuple[float, float] | None = None
    corner: tuple[float, float] | None = None
    epsg: int | None = None
    tags: dict = field(default_factory=dict)

    @property
    def across(self) -> int:
        return ceil(self.cols / self.block[1])

    @property
    def down(self) -> int:
        return ceil(self.rows / self.block[0])


def tiff_header(file) -> Raster:
    """Parse the first image's tags, classic or big, of either byte order."""
    head = _read(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", _read(file, 8, 8))[0] if big else struct.unpack(f"{order}I", head[4:])[0]
    n = struct.unpack(f"{order}Q" if big else f"{order}H", _read(file, at, 8 if big else 2))[0]
    step, room = (20, 8) if big else (12, 4)
    body = _read(file, at + (8 if big else 2), n * step)
    tags: dict[int, list] = {}
    for i in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", body, i * step)
        count = struct.unpack_from(f"{order}Q" if big else f"{order}I", body, i * step + 4)[0]
        if kind not in _TIFF:
            continue
        bytes_ = struct.calcsize(f"={_TIFF[kind]}") * count
        place = i * step + step - room
        data = body[place : place + bytes_] if bytes_ <= room else _read(file, struct.unpack_from(f"{order}Q" if big else f"{order}I", body, place)[0], bytes_)
        tags[tag] = [data.rstrip(b"\0").decode("latin-1")] if kind == 2 else list(struct.unpack(f"{order}{count * len(_TIFF[kind])}{_TIFF[kind][0]}", data))
    one = lambda tag, default: tags.get(tag, [default])[0]
    bits, kind = one(258, 1), {1: "u", 2: "i", 3: "f"}.get(one(339, 1))
    if bits not in (8, 16, 32, 64) or kind is None or len(set(tags.get(258, [1]))) > 1:
        raise ValueError(f"numbers of {bits} bits and format {one(339, 1)} aren't read")
    rows, cols = one(257, 0), one(256, 0)
    tiled = 324 in tags
    block = (one(323, 0), one(322, 0)) if tiled else (min(one(278, rows), rows), cols)
    out = Raster(rows, cols, one(277, 1), block, tags[324 if tiled else 273], tags[325 if tiled else 279], np.dtype(f"{order}{kind}{bits // 8}"), one(259, _NONE), one(317, 1), one(284, 1) == 2)
    if out.compression not in (_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS) or out.predictor not in (1, 2):
        raise ValueError(f"compression {out.compression} with predictor {out.predictor} isn't read")
    if 42113 in tags:
        out.none = float(tags[42113][0])
    if 33550 in tags and 33922 in tags:
        i, j, _, x, y, _ = tags[33922][:6]
        sx, sy = tags[33550][:2]
        out.size, out.corner = (sx, -sy), (x - i * sx, y + j * sy)
    keys = tags.get(34735, [])
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    out.epsg = named.get(3072, named.get(2048))
    return out


def unpack_lzw(data: bytes) -> bytes:
    """Codes with the highest bit first, whose width grows one entry early."""
    out, table, old = [], [bytes([i]) for i in range(256)] + [b"", b""], b""
    bits = have = at = 0
    width = 9
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            bits, have, at = (bits << 8) | data[at], have + 8, at + 1
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            del table[258:]
            width, old = 9, b""
            continue
        if not old:
            now = table[code]
        else:
            now = table[code] if code < len(table) else old + old[:1]
            table.append(old + now[:1])
        out.append(now)
        old, width = now, max(9, min(12, (len(table) + 1).bit_length()))


def unpack_bits(data: bytes) -> bytes:
    """Runs of literal and of repeated bytes."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def read_block(file, raster: Raster, i: int) -> np.ndarray:
    """The i-th strip or tile: (rows, columns, bands); tiles are full, the last strip may be short."""
    data = _read(file, raster.offsets[i], raster.counts[i])
    unpack = {_NONE: bytes, _LZW: unpack_lzw, _PACKBITS: unpack_bits}.get(raster.compression, zlib.decompress)
    bands = 1 if raster.separate else raster.bands
    here = i % (raster.across * raster.down)
    rows = raster.block[0] if 324 in raster.tags or raster.block[1] != raster.cols else min(raster.block[0], raster.rows - here // raster.across * raster.block[0])
    flat = np.frombuffer(unpack(data), raster.dtype)
    out = flat[: flat.size // (raster.block[1] * bands) * raster.block[1] * bands].reshape(-1, raster.block[1], bands)[: max(rows, 0)]
    if raster.predictor == 2:
        with np.errstate(over="ignore"):
            out = np.cumsum(out.astype(raster.dtype.newbyteorder("=")), axis=1, dtype=raster.dtype.newbyteorder("="))
    return out


@dataclass
class Blocks(InputPartition):
    numbers: list[int]


class GeotiffSource(DataSource):
    """format("geotiff"): option path. Rows r, c, band (all from 0) and value, null where the file's no-data value stands. Options r.from,
    r.to, c.from, c.to, band.from and band.to, and filters on these columns, choose the strips or tiles that are read."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "r int, c int, band int, value double"

    def reader(self, schema) -> DataSourceReader:
        with open_file(self.options["path"]) as file:
            return GeotiffReader(self.options["path"], tiff_header(file), {k.lower(): x for k, x in self.options.items()})


class GeotiffReader(DataSourceReader):
    def __init__(self, path: str, raster: Raster, options: dict[str, str]):
        self.path, self.raster, self.ranges = path, raster, Ranges(options, ["r", "c", "band"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.ranges.push(filters)

    def _place(self, i: int) -> tuple[int, int, range]:
        """First row and column of a block, and its bands."""
        each = self.raster.across * self.raster.down
        here = i % each
        return here // self.raster.across * self.raster.block[0], here % self.raster.across * self.raster.block[1], range(i // each, i // each + 1) if self.raster.separate else range(self.raster.bands)

    def _wanted(self, i: int) -> bool:
        r, c, bands = self._place(i)
        inside = lambda name, low, high: self.ranges.low[name] <= high and self.ranges.high[name] >= low
        return inside("r", r, r + self.raster.block[0] - 1) and inside("c", c, c + self.raster.block[1] - 1) and inside("band", bands[0], bands[-1])

    def partitions(self) -> list[Blocks]:
        wanted = [i for i in range(len(self.raster.offsets)) if self._wanted(i)]
        each = max(1, VALUES // max(1, self.raster.block[0] * self.raster.block[1]))
        return [Blocks(wanted[i : i + each]) for i in range(0, len(wanted), each)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        cut = lambda name, first, n, most: slice(max(0, ceil(max(self.ranges.low[name], -1)) - first), max(0, min(n, most - first, floor(min(self.ranges.high[name], 1 << 40)) - first + 1)))
        with open_file(self.path) as file:
            for i in partition.numbers:
                r, c, bands = self._place(i)
                block = read_block(file, self.raster, i)
                rows, cols = cut("r", r, block.shape[0], self.raster.rows), cut("c", c, block.shape[1], self.raster.cols)
                some = [b for b in bands if self.ranges.low["band"] <= b <= self.ranges.high["band"]]
                part = block[rows, cols][:, :, [b - bands[0] for b in some]]
                if not part.size:
                    continue
                at = np.meshgrid(np.arange(rows.start, rows.start + part.shape[0]) + r, np.arange(cols.start, cols.start + part.shape[1]) + c, some, indexing="ij")
                flat = part.ravel().astype(float)
                gone = np.isnan(flat) | (flat == self.raster.none if self.raster.none is not None else False)
                yield pa.RecordBatch.from_arrays([*(pa.array(a.ravel().astype(np.int32)) for a in at), pa.array(flat, mask=gone)], ["r", "c", "band", "value"])


def read_geotiff(spark: SparkSession, path: str, **ranges: tuple[int, int]) -> DataFrame:
    """Cells of a GeoTIFF (see GeotiffSource); ranges: r, c or band=(from, to), both ends included."""
    _register(spark, GeotiffSource)
    reader = spark.read.format("geotiff").option("path", path)
    for name, (low, high) in ranges.items():
        reader = reader.option(f"{name}.from", str(low)).option(f"{name}.to", str(high))
    return reader.load()


def geotiff_info(path: str) -> Raster:
    """Shape, number type, no-data value, cell size, corner and EPSG number of a file, from its tags alone."""
    with open_file(path) as file:
        return tiff_header(file)
