"""Shapefiles by records: polygons with the fields of their table.

The index file gives the place of every record, so that a layer is read in runs of records, each by its own bytes of
the shapes and of the table. Layers are written a partition each, as Spark's other sinks write files.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluvia.operators.outlines import RINGS
from fluvia.session import ship
from fluvia.sources.arrays import _read, open_file

#: Records of a partition.
RECORDS = 4096
#: Kinds of shapes that are polygons, plain and with heights and measures.
POLYGONS = (5, 15, 25)


@dataclass
class Field:
    name: str
    kind: str
    size: int
    digits: int
    at: int

    @property
    def type(self) -> str:
        return {"N": "double" if self.digits or self.size > 18 else "long", "F": "double", "D": "date", "L": "boolean"}.get(self.kind, "string")

    def value(self, raw: bytes, code: str):
        text = raw[self.at : self.at + self.size].decode(code, "replace").strip(" \0")
        if not text or text.startswith("*"):
            return None
        try:
            if self.type in ("double", "long"):
                return float(text) if self.type == "double" else int(text)
            if self.type == "date":
                return datetime.datetime.strptime(text, "%Y%m%d").date()
        except ValueError:
            return None
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if self.type == "boolean" else text


@dataclass
class Table:
    """Of a layer's .dbf: fields, rows, and the bytes of the header and of a row."""

    fields: list[Field]
    rows: int
    head: int
    row: int
    code: str


def table_header(file, code: str) -> Table:
    head = _read(file, 0, 32)
    rows, size, row = struct.unpack_from("<IHH", head, 4)
    body, fields, at = _read(file, 32, size - 32), [], 1
    for i in range(0, len(body) - 31, 32):
        if body[i] == 0x0D:
            break
        name = body[i : i + 11].split(b"\0")[0].decode(code, "replace")
        kind, length, digits = chr(body[i + 11]), body[i + 16], body[i + 17]
        fields.append(Field(name, kind, length, digits, at))
        at += length
    return Table(fields, rows, size, row, code)


def index(file) -> np.ndarray:
    """Places and lengths of all records, in bytes, from the .shx."""
    if struct.unpack(">i", _read(file, 0, 4))[0] != 9994:
        raise ValueError("not an index of shapes")
    words = struct.unpack(">i", _read(file, 24, 4))[0]
    return np.frombuffer(_read(file, 100, words * 2 - 100), ">i4").reshape(-1, 2).astype(np.int64) * 2


def rings_of(record: bytes) -> list[list[dict]] | None:
    """Rings of a polygon record, turned so that outlines run against the clock, without their last point, which is the first;
    None where the shape is no polygon."""
    if struct.unpack_from("<i", record, 0)[0] not in POLYGONS:
        return None
    parts, points = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ring = xy[a:b][::-1]
        ring = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
        out.append([{"x": float(x), "y": float(y)} for x, y in ring])
    return out


@dataclass
class Records(InputPartition):
    first: int
    n: int


class ShapefileSource(DataSource):
    """format("shapes"): options path (of the .shp; its .shx and, if there is one, .dbf stand beside it) and encoding. Rows: record from 1,
    rings (null where the shape isn't a polygon), and the table's fields."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def _table(self) -> Table | None:
        try:
            with open_file(f"{self.options['path'][:-4]}.dbf") as file:
                return table_header(file, self.options.get("encoding", "utf-8"))
        except FileNotFoundError:
            return None

    def schema(self) -> str:
        table = self._table()
        return ", ".join([f"record int, rings {RINGS}", *(f"`{f.name}` {f.type}" for f in (table.fields if table else []))])

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"], self._table())


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, table: Table | None):
        self.path, self.table = path, table

    def partitions(self) -> list[Records]:
        with open_file(f"{self.path[:-4]}.shx") as file:
            n = len(index(file))
        return [Records(i, min(RECORDS, n - i)) for i in range(0, n, RECORDS)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.n:
            return
        with open_file(f"{self.path[:-4]}.shx") as file:
            at = np.frombuffer(_read(file, 100 + 8 * partition.first, 8 * partition.n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = b""
        if self.table:
            with open_file(f"{self.path[:-4]}.dbf") as file:
                rows = _read(file, self.table.head + partition.first * self.table.row, min(partition.n, max(0, self.table.rows - partition.first)) * self.table.row)
        with open_file(self.path) as file:
            for i, (place, size) in enumerate(at.tolist()):
                raw = rows[i * self.table.row : (i + 1) * self.table.row] if self.table else b""
                values = [f.value(raw, self.table.code) for f in self.table.fields] if self.table else []
                yield (partition.first + i + 1, rings_of(_read(file, place + 8, size)), *values)


def read_layer(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A shapefile's records (see ShapefileSource)."""
    ship(spark).dataSource.register(ShapefileSource)
    return spark.read.format("shapes").option("path", path).option("encoding", encoding).load()


def layer_crs(path: str) -> str | None:
    """The text of a layer's .prj, None without one."""
    try:
        with open_file(f"{path[:-4]}.prj") as file:
            return file.read().decode("utf-8", "replace").strip()
    except FileNotFoundError:
        return None


def _column(kind: str, name: str) -> tuple[str, int, int]:
    """Kind, size and digits of a field for a Spark type."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "N", 18, 0
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "F", 24, 12
    return {"date": ("D", 8, 0), "boolean": ("L", 1, 0)}.get(kind, ("C", 254, 0))


def _text(v, kind: str, size: int) -> bytes:
    if v is None:
        return b" " * size
    if kind == "D":
        return v.strftime("%Y%m%d").encode()
    if kind == "L":
        return b"T" if v else b"F"
    raw = (str(v) if kind == "N" else repr(float(v)) if kind == "F" else str(v)).encode()
    # A text is cut between characters.
    raw = raw[:size].decode("utf-8", "ignore").encode() if kind == "C" else raw
    return raw.ljust(size) if kind == "C" else raw.rjust(size)[:size]


def _record(rings: list[np.ndarray]) -> bytes:
    """A polygon's bytes: outlines with the clock and holes against it, closed."""
    from fluvia.operators.polygons import _area, _holds

    shaped = []
    for k, p in enumerate(rings):
        p = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
        hole = sum(_holds(q, *p[:2].mean(0)) for j, q in enumerate(rings) if j != k) % 2 == 1 if len(p) > 2 else False
        p = p if (_area(p) > 0) == hole else p[::-1]
        shaped.append(np.concatenate([p, p[:1]]))
    if not any(len(p) for p in shaped):
        return struct.pack("<i", 0)
    points = np.concatenate(shaped)
    starts = np.cumsum([0, *(len(p) for p in shaped[:-1])])
    return struct.pack("<i4dii", 5, *points.min(0), *points.max(0), len(shaped), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()


def write_layer(polygons: DataFrame, folder: str, prj: str = "") -> int:
    """Polygons (rings, and any fields) as shapefiles in a folder that all tasks reach, one for each partition with rows: part-<number>
    .shp, .shx, .dbf and, with the text of a system, .prj. Gives the number of files. Names are cut to ten letters, texts to
    254 bytes. Tasks that run again write the same files."""
    from pyspark import TaskContext

    fields = [(f.name, *_column(f.dataType.simpleString(), f.name)) for f in polygons.schema.fields if f.name != "rings"]
    order = [f[0] for f in fields]

    def run(batches):
        shapes, places, rows, box, at = [], [], [], [], 100
        for batch in batches:
            rings = batch.column(batch.schema.get_field_index("rings"))
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in order]
            for i in range(batch.num_rows):
                own = [np.stack([r.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype(float) for r in rings[i] if r.is_valid] if rings[i].is_valid else []
                record = _record(own)
                shapes.append(struct.pack(">ii", len(shapes) + 1, len(record) // 2) + record)
                places.append((at // 2, len(record) // 2))
                at += 8 + len(record)
                box += [p for p in own if len(p)]
                rows.append(b" " + b"".join(_text(v[i], kind, size) for v, (_, kind, size, _) in zip(values, fields, strict=True)))
        if not shapes:
            return
        bounds = np.concatenate(box) if box else np.zeros((1, 2))
        head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", 1000, 5, *bounds.min(0), *bounds.max(0), 0, 0, 0, 0)
        named = b"".join(name.encode()[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, digits]) + b"\0" * 14 for name, kind, size, digits in fields)
        size = 1 + sum(f[2] for f in fields)
        table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(named), size) + named + b"\r" + b"".join(rows) + b"\x1a"
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}"
        files = {"shp": head(at) + b"".join(shapes), "shx": head(100 + 8 * len(places)) + b"".join(struct.pack(">ii", *p) for p in places), "dbf": table} | ({"prj": prj.encode()} if prj else {})
        for end, data in files.items():
            _write(f"{name}.{end}", data)
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.shp"])], ["file"])

    ship(polygons.sparkSession)
    return polygons.mapInArrow(run, "file string").count()


def _write(path: str, data: bytes) -> None:
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(name) as out:
        out.write(data)
