"""Polygons, patches and projections against plain versions."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvia.functions import projection
from fluvia.operators import polygons, raster, spatial


def rows_of(shapes):
    return [(z, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for z, rings in shapes.items()]


SHAPES = {
    1: [[(1, 1), (9, 2), (6, 8)]],
    2: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]],
    3: [[(2.2, 2.3), (2.6, 2.3), (2.6, 2.8), (2.2, 2.8)]],  # smaller than a cell
    4: [[(-3, -2), (4, -1), (1, 1), (4, 5), (-3, 4), (-3, -2)]],  # dented, closed, beyond the axes
}


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(rows_of(SHAPES), f"zone int, rings {polygons.RINGS}")


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                n += 1
    return n % 2 == 1


def test_points_in_polygons(spark, shapes):
    rng = random.Random(2)
    points = [(i, rng.uniform(-4, 11), rng.uniform(-3, 11)) for i in range(400)]
    got = {(r["id"], r["zone"]) for r in polygons.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), shapes, 3.0).collect()}
    assert got == {(i, z) for i, x, y in points for z, rings in SHAPES.items() if inside(rings, x, y)}


def test_points_of_one_tile_are_the_work_of_several_tasks(spark, shapes, monkeypatch):
    monkeypatch.setattr(polygons, "POINTS", 40)
    rng = random.Random(3)
    points = [(i, rng.uniform(-4, 11), rng.uniform(-3, 11), f"p{i}") for i in range(400)] + [(400, None, 1.0, None), (401, float("nan"), 1.0, None)]
    made = polygons.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double, name string"), shapes, 100.0)
    got = made.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["id"], r["zone"], r["name"]) for r in got} == {(i, z, n) for i, x, y, n in points[:400] for z, rings in SHAPES.items() if inside(rings, x, y)}
    assert len(got) == len({(r["id"], r["zone"]) for r in got}) and len({r["task"] for r in got}) > 4


def test_weights_by_sampling(shapes):
    got = {}
    for r in polygons.cell_weights(shapes, 2.0).collect():
        got.setdefault(r["zone"], {})[r["r"], r["c"]] = r["weight"]
    fine = [(i + 0.5) / 50 for i in range(100)]
    for z, rings in SHAPES.items():
        assert sum(got[z].values()) == pytest.approx(1)
        whole = {r["zone"]: r["a"] for r in shapes.select("zone", polygons.area(F.col("rings")).alias("a")).collect()}[z]
        for r, c in itertools.product(range(-2, 6), range(-2, 6)):
            share = sum(inside(rings, 2 * c + x, 2 * r + y) for x in fine for y in fine) / 10000 * 4 / whole
            assert got[z].get((r, c), 0) == pytest.approx(share, abs=0.04 if z == 3 else 0.004)


def test_weights_of_many_polygons_are_those_of_each(spark, monkeypatch):
    """Cut many at a time, of either direction, closed or not, flat ones left out."""
    monkeypatch.setattr(polygons, "CUT", 50)
    rng = np.random.default_rng(4)
    shapes = []
    for k in range(60):
        n, turn = int(rng.integers(3, 9)), np.sort(rng.uniform(0, 2 * np.pi, 9))
        ring = [(1e4 * (k % 3) + 7 * np.cos(a), 5 * np.sin(a)) for a in turn[:n]]
        shapes.append(ring[::-1] if k % 2 else [*ring, ring[0]] if k % 5 == 0 else ring)
    flat = [[(0.0, 0.0), (5.0, 5.0), (2.0, 2.0)], [(1.0, 1.0)], []]
    got = {}
    for i, r, c, share in polygons._cut_single(pa.array([[[{"x": x, "y": y} for x, y in ring]] for ring in (*shapes, flat[0])]), 2.0):
        for *key, w in zip(i.tolist(), r.tolist(), c.tolist(), share.tolist()):
            got[tuple(key)] = w
    want = {}
    for k, ring in enumerate(shapes):
        p = np.array(ring)
        p = p if polygons._area(p) > 0 else p[::-1]
        r, c, share = polygons.covered([p / 2])
        want |= {(k, *at): w for *at, w in zip(r.tolist(), c.tolist(), (share * 4 / abs(polygons._area(p - p[0]))).tolist()) if w > 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w, abs=1e-9) for k, w in want.items())
    assert not polygons.cell_weights(spark.createDataFrame([(k, [ring]) for k, ring in enumerate(flat)], f"zone int, rings {polygons.RINGS}"), 2.0).count()


def test_all_touched_and_burn(spark, shapes):
    touched = {(r["r"], r["c"]) for r in polygons.rasterise(shapes.where("zone = 3"), 2.0, touched=True).collect()}
    assert touched == {(1, 1)} and polygons.rasterise(shapes.where("zone = 3"), 2.0).count() == 0
    cells = spark.createDataFrame([(r, c, 0.0) for r in range(5) for c in range(5)], "r int, c int, value double")
    got = {(r["r"], r["c"]): r["value"] for r in polygons.burn(cells, shapes.where("zone = 2"), F.lit(7.0), 2.0).collect()}
    assert len(got) == 25 and all((v == 7.0) == inside(SHAPES[2], 2 * c + 1, 2 * r + 1) for (r, c), v in got.items())


def test_text_and_back(shapes):
    made = shapes.select("zone", polygons.to_wkt(F.col("rings")).alias("w")).select("zone", "w", polygons.from_wkt(F.col("w")).alias("rings"))
    for r in made.collect():
        want = [ring if ring[0] == ring[-1] else [*ring, ring[0]] for ring in SHAPES[r["zone"]]]
        assert [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] == want
    assert made.select(polygons.from_wkt(F.lit("POINT (1 2)")).alias("n")).first()["n"] is None


def test_patches(spark):
    rng = random.Random(4)
    for side in (1, 12):
        grid = {(r, c): rng.randrange(2) for r in range(side) for c in range(side) if rng.random() < 0.9}
        df = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "r int, c int, value int")
        want, seen = {}, set()
        for start in sorted(grid):
            if start in seen:
                continue
            stack, part = [start], []
            while stack:
                k = stack.pop()
                if k in seen or grid.get(k) != grid[start]:
                    continue
                seen.add(k)
                part.append(k)
                stack += [(k[0] + i, k[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            for k in part:
                want[k] = start[0] * (1 << 32) + start[1]
        assert {(r["r"], r["c"]): r["patch"] for r in raster.patches(df).collect()} == want
        for r in raster.polygonise(df).collect():
            own = {k for k, p in want.items() if p == r["patch"]}
            assert r["cells"] == len(own)
            assert len(r["edges"]) == sum((a + i, b + j) not in own for a, b in own for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_transverse_mercator(spark):
    """The meridian arc to 45 degrees, symmetry, and a point whose place is known."""
    rows = [(9.0, 45.0), (12.0, 45.0), (6.0, 45.0), (9.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = projection.to_transverse_mercator(F.col("lon"), F.col("lat"), 9.0)
    got = [(r["x"], r["y"]) for r in df.select(x.alias("x"), y.alias("y")).collect()]
    assert got[0] == (pytest.approx(500000), pytest.approx(0.9996 * 4984944.378, abs=0.01))
    assert got[1][0] - 500000 == pytest.approx(500000 - got[2][0]) and got[1][1] == pytest.approx(got[2][1])
    assert got[3] == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    there = projection.to_web_mercator(F.col("lon"), F.col("lat"))
    back = projection.from_web_mercator(*there)
    for r, (lon, lat) in zip(df.select(back[0].alias("a"), back[1].alias("b")).collect(), rows):
        assert (r["a"], r["b"]) == (pytest.approx(lon), pytest.approx(lat))


def test_mesh_covers_points_with_margins(spark):
    points = spark.createDataFrame([(3.0, 4.0), (27.0, 18.0)], "x double, y double")
    got = spatial.mesh(points, 10.0).collect()
    assert {(r["r"], r["c"]) for r in got} == set(itertools.product(range(6), range(7)))
    assert min(r["x"] for r in got) == -15 and max(r["y"] for r in got) == 35 and all(r["y"] == 35 - 10 * r["r"] for r in got)


def test_zoom_of_order_nought(spark):
    df = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(2) for c in range(3)], "r int, c int, value double")
    got = {(r["r"], r["c"]): r["value"] for r in raster.zoom(df, 2, 3, 2, 0).collect()}
    assert got == {(r, c): float(r // 2 * 10 + c // 2) for r in range(4) for c in range(6)}
    with pytest.raises(ValueError):
        raster.zoom(df, 2, 3, 2, 3)


def test_index_window_truncates(spark):
    df = spark.createDataFrame([(0, c, 1.0) for c in range(10)], "r int, c int, value double")
    assert [r["c"] for r in raster.window(df, F.lit(23.0), F.lit(59.9), 10.0, 0.0, "c").orderBy("c").collect()] == [2, 3, 4, 5]
    assert math.isclose(df.select(raster.corner(F.lit(15.0), 10.0).alias("v")).first()["v"], 10.0)
