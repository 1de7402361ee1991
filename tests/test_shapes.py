"""Shapefiles that are written and read back, and one made byte by byte."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import polygons
from fluvia.sources import shapes, tables


def square(x, y, w):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + w)), (float(x), float(y + w))]


SHAPES = [
    (1, "Neckar, oben", 2.5, datetime.date(2001, 2, 3), True, [square(0, 0, 10), square(20, 0, 10), square(22, 2, 6), square(24, 4, 2)]),
    (2, "é" * 200, None, None, None, [square(0, 0, 4)[::-1], square(1, 1, 2)[::-1]]),
    (3, None, -1e-7, datetime.date(1999, 12, 31), False, []),
    (4, "", 1e20, None, False, [[(0.5, 0.5), (3.25, 1.0), (1.0, 7.0)]]),
]
KINDS = f"code int, name string, size double, day date, kept boolean, rings {polygons.RINGS}"


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("layer"))
    df = spark.createDataFrame(SHAPES, KINDS).coalesce(1)
    assert shapes.write_layer(df, folder, 'GEOGCS["test"]') == 1
    return f"{folder}/part-00000.shp"


def test_own_output_is_read_back(spark, layer, monkeypatch):
    df = shapes.read_layer(spark, layer)
    rows = df.orderBy("record").collect()
    assert [(r["record"], r["code"], r["size"], r["day"], r["kept"]) for r in rows] == [(i + 1, s[0], s[2], s[3], s[4]) for i, s in enumerate(SHAPES)]
    assert [r["name"] for r in rows] == ["Neckar, oben", "é" * 127, None, None]
    area = {r["code"]: r["a"] for r in df.select("code", polygons.area(F.col("rings")).alias("a")).collect()}
    assert area == {1: pytest.approx(100 + 100 - 36 + 4), 2: pytest.approx(12), 3: None, 4: pytest.approx(8.8125)}
    for r, s in zip(rows, SHAPES, strict=True):
        assert [sorted((p["x"], p["y"]) for p in ring) for ring in r["rings"] or []] == [sorted(ring) for ring in s[5]]
        # Outlines run against the clock, holes with it; an island in a hole is no hole.
        turns = [np.sign(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1]))) for q in ([(p["x"], p["y"]) for p in ring] for ring in r["rings"] or [])]
        assert turns == {1: [1, 1, -1, 1], 2: [1, -1], 3: [], 4: [1]}[r["code"]]
    assert shapes.layer_crs(layer) == 'GEOGCS["test"]' and shapes.layer_crs(layer[:-5] + "9.shp") is None


def test_runs_of_records(spark, layer, monkeypatch):
    monkeypatch.setattr(shapes, "RECORDS", 3)
    reader = shapes.ShapefileSource({"path": layer}).reader(None)
    parts = reader.partitions()
    assert [(p.first, p.n) for p in parts] == [(0, 3), (3, 1)]
    assert [row[1] for row in reader.read(parts[1])] == [4] or [row[0] for row in reader.read(parts[1])] == [4]


def test_weights_of_islands(spark, layer):
    weights = {(r["r"], r["c"]): r["weight"] * 168 for r in polygons.cell_weights(shapes.read_layer(spark, layer).where("code = 1").withColumnRenamed("code", "zone"), 10.0).collect()}
    assert weights == {(0, 0): pytest.approx(100), (0, 2): pytest.approx(68)}


def test_the_plain_reader_agrees(spark, layer):
    plain = tables.read_shapefile(spark, layer.rsplit("/", 1)[0]).select("zone", polygons.area(F.col("rings")).alias("a"))
    assert {r["zone"]: r["a"] for r in plain.collect()} == {1: pytest.approx(168), 2: pytest.approx(12), 4: pytest.approx(8.8125)}


def test_several_files_empty_partitions_and_points(spark, tmp_path):
    df = spark.createDataFrame([(i, [square(i, 0, 1)]) for i in range(10)], f"zone int, rings {polygons.RINGS}").repartition(4, "zone")
    n = shapes.write_layer(df, str(tmp_path / "many"))
    files = sorted((tmp_path / "many").glob("*.shp"))
    assert n == len(files) > 1
    read = [r["zone"] for f in files for r in shapes.read_layer(spark, str(f)).collect()]
    assert sorted(read) == list(range(10))
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (108 + len(point)) // 2) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + struct.pack(">ii", 1, len(point) // 2) + point
    (tmp_path / "p.shp").write_bytes(shp)
    (tmp_path / "p.shx").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 54) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + struct.pack(">ii", 50, len(point) // 2))
    assert [tuple(r) for r in shapes.read_layer(spark, str(tmp_path / "p.shp")).collect()] == [(1, None)]
