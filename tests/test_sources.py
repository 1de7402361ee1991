"""Files written and read back, and files laid out by hand."""

import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import polygons
from fluvia.sources import tables


def test_wide_table_there_and_back(spark, tmp_path):
    rows = [("a", datetime.datetime(2020, 1, d), float(d) / 3) for d in (1, 2)] + [("b c", datetime.datetime(2020, 1, 1), 7.0)]
    path = str(tmp_path / "wide")
    tables.write_wide(spark.createDataFrame(rows, "stn string, t timestamp, value double"), path, ["a", "b c"], 4)
    got = {(r["stn"], r["t"]): r["value"] for r in tables.read_wide(spark, path).collect()}
    assert got == {("a", rows[0][1]): 0.3333, ("a", rows[1][1]): 0.6667, ("b c", rows[0][1]): 7.0, ("b c", rows[1][1]): None}


def test_coordinates(spark, tmp_path):
    (tmp_path / "c.csv").write_text(";X;Y;Z\n1;10.5;20;300\n2;bad;5;1\n1;11.5;21;\n 3 ;1;2;9\n")
    got = {r["stn"]: (r["x"], r["y"], r["z"]) for r in tables.read_coordinates(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"1": (11.5, 21.0, None), "3": (1.0, 2.0, 9.0)}


GRID = "ncols 3\nnrows 2\nxllcorner 100\nyllcorner 50\ncellsize 10\nNODATA_value -9\n1 2 -9\n4 5 6\n"


def test_grids_with_many_blocks(spark, tmp_path):
    (tmp_path / "one.asc").write_text(GRID)
    (tmp_path / "two.asc").write_text(GRID.replace("\n", "\r\n") + "\n" + GRID.replace("100", "0").replace("1 2 -9", "7 8 9"))
    got = {(r["file"].rsplit("/", 1)[1], r["block"], r["r"], r["c"]): (r["x"], r["y"], r["value"]) for r in tables.read_ascii_grid(spark, str(tmp_path / "*.asc")).collect()}
    assert len(got) == 18
    assert got["one.asc", 0, 0, 0] == (105.0, 65.0, 1.0) and got["one.asc", 0, 0, 2] == (125.0, 65.0, None) and got["one.asc", 0, 1, 1] == (115.0, 55.0, 5.0)
    assert got["two.asc", 0, 1, 2] == (125.0, 55.0, 6.0) and got["two.asc", 1, 0, 2] == (25.0, 65.0, 9.0)


def test_grid_written_and_read(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, None if r == c else float(r * 4 + c)) for r in range(3) for c in range(4)], "r int, c int, value double")
    tables.write_ascii_grid(cells, str(tmp_path / "g"), 5.0, 6.0, 2.0)
    got = {(r["r"], r["c"]): (r["x"], r["y"], r["value"]) for r in tables.read_ascii_grid(spark, str(tmp_path / "g")).collect()}
    assert got == {(r, c): (5 + 2 * (c + 0.5), 6 + 2 * (3 - r - 0.5), None if r == c else float(r * 4 + c)) for r in range(3) for c in range(4)}


def test_parameters(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1.5, 2.0), ("b2", 3.0, 4.25)], "basin string, fc double, beta double")
    tables.write_parameters(df, "basin", str(tmp_path / "p"))
    got = {(r["file"].rsplit("/", 2)[1], r["param"]): r["value"] for r in tables.read_parameters(spark, str(tmp_path / "p/*/*.csv")).collect()}
    assert got == {("basin=b1", "fc"): 1.5, ("basin=b1", "beta"): 2.0, ("basin=b2", "fc"): 3.0, ("basin=b2", "beta"): 4.25}


def test_listing_and_dates(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("rain_2001-02-03.txt", "sub/rain_2001-02-04.txt", "rain_x.txt", "rain_2001-02-05.csv", "rain_2001-99-99.txt"):
        (tmp_path / name).write_text("12345")
    found = tables.list_files(spark, str(tmp_path), "txt")
    assert found.count() == 4 and {r["size"] for r in found.collect()} == {5}
    dated = tables.date_catalogue(found, r"_(\d{4}-\d{2}-\d{2})\.", "yyyy-MM-dd")
    assert sorted(r["d"] for r in dated.collect()) == [datetime.date(2001, 2, 3), datetime.date(2001, 2, 4)]


def test_new_rasters(spark):
    made = tables.new_raster(spark, 2, 3, 1.5)
    assert {(r["r"], r["c"], r["value"]) for r in made.collect()} == {(r, c, 1.5) for r in range(2) for c in range(3)}
    values = spark.createDataFrame([(0, 1, 9.0), (5, 5, 1.0)], "r int, c int, value double")
    assert {(r["r"], r["c"], r["value"]) for r in tables.raster_like(made, values).collect()} == {(r, c, 9.0 if (r, c) == (0, 1) else None) for r in range(2) for c in range(3)}


def test_cube_and_slabs(spark, tmp_path):
    rows = [(datetime.date(y, 6, d), float(y_), float(x), float(y * d)) for y in (2000, 2001) for d in (1, 2) for y_ in (1, 2) for x in (1, 2)]
    path = str(tmp_path / "cube")
    tables.write_cube(spark.createDataFrame(rows, "t date, y double, x double, OK double"), path, "t", OK="ordinary kriging, mm")
    assert tables.read_cube(spark, path, "t").schema["OK"].metadata == {"description": "ordinary kriging, mm"}
    slab = tables.read_cube(spark, path, "t", datetime.date(2000, 6, 2), datetime.date(2001, 6, 1), (2, 3, 0, 1))
    assert sorted(tuple(r[c] for c in "tyx") + (r["OK"],) for r in slab.collect()) == sorted(r for r in rows if datetime.date(2000, 6, 2) <= r[0] <= datetime.date(2001, 6, 1) and r[2] == 2 and r[1] == 1)
    plan = slab._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters" in plan


RINGS = [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)], [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 3.0)]]


def test_shapefile(spark, tmp_path):
    """One polygon of two rings, a null shape, and one of a single ring."""

    def record(number, rings):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for ring in rings for p in ring]
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            body = struct.pack("<i4d2i", 5, 0, 0, 10, 10, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">2i", number, len(body) // 2) + body

    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, RINGS) + record(2, None) + record(3, RINGS[:1]))
    got = {r["zone"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in tables.read_shapefile(spark, str(tmp_path)).collect()}
    assert got == {1: RINGS, 3: RINGS[:1]}


def test_geojson(spark, tmp_path):
    coordinates = [[list(p) for p in ring] for ring in RINGS]
    features = [{"type": "Feature", "properties": {"DN": "7"}, "geometry": {"type": "Polygon", "coordinates": coordinates}}, {"type": "Feature", "properties": {"DN": "8"}, "geometry": {"type": "MultiPolygon", "coordinates": [coordinates, coordinates[:1]]}}]
    (tmp_path / "in.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = tables.read_geojson(spark, str(tmp_path / "in.json"), "DN")
    assert sorted((r["zone"], len(r["rings"])) for r in rows.collect()) == [("7", 2), ("8", 1), ("8", 2)]
    assert {r["a"] for r in rows.where("zone = '7'").select(polygons.area(F.col("rings")).alias("a")).collect()} == {100.0 - 8.0}
    tables.write_geojson(rows, str(tmp_path / "out"), "DN")
    first = json.loads(spark.read.text(str(tmp_path / "out")).where("value like '%\"7\"%'").first()["value"])
    assert first == features[0]


@pytest.mark.parametrize("path", ["none"])
def test_missing_files_say_so(spark, path):
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_ascii_grid(spark, f"/nowhere/{path}").count()


def test_grids_over_many_splits(spark, tmp_path):
    """Three grids in a file that is read in small splits, with blank lines between."""
    rng = np.random.default_rng(2)
    grids = [rng.integers(0, 999, (40 + 7 * b, 25)) for b in range(3)]
    text = "".join(f"ncols 25\nnrows {len(g)}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n\n" + "".join(" ".join(map(str, row)) + "\n" for row in g.tolist()) for g in grids)
    (tmp_path / "many.asc").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        df = tables.read_ascii_grid(spark, str(tmp_path / "many.asc"))
        got = {(r["block"], r["r"], r["c"]): r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(b, r, c): float(v) for b, g in enumerate(grids) for (r, c), v in np.ndenumerate(g)}
