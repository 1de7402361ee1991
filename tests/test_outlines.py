"""Unions, rings of patches and areas of polygons with several parts, against plain counts of small squares."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import outlines, polygons, raster


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def table(spark, rows):
    return spark.createDataFrame([(z, [[tuple(map(float, p)) for p in ring] for ring in rings]) for z, rings in rows], f"zone int, rings {polygons.RINGS}")


def rings_of(df):
    return {r["zone"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in df.collect()}


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def test_disjoint_overlapping_nested_and_touching(spark):
    rows = [
        (1, [square(0, 0, 10)]), (1, [square(20, 0, 10)]),  # disjoint
        (2, [square(0, 0, 10)]), (2, [square(5, 5, 10)]),  # overlapping
        (3, [square(0, 0, 10), square(3, 3, 4)]), (3, [square(4, 4, 1)]),  # an island in a hole
        (4, [square(0, 0, 10)]), (4, [square(10, 0, 10)]), (4, [square(10, 10, 5)]),  # shared borders
        (5, [square(0, 0, 10)]), (5, [square(2, 2, 3)]), (5, [square(0, 0, 10)]),  # within, and twice
        (6, [square(0, 0, 10), square(3, 3, 4)]), (6, [square(3, 3, 4)]),  # a hole that is filled
        (7, [[(0, 0), (4, 0)]]), (7, []),  # no area
    ]
    df = outlines.union(table(spark, rows))
    found, parts = rings_of(df), {r["zone"]: r["outlines"] for r in df.collect()}
    area = {r["zone"]: r["a"] for r in df.select("zone", polygons.area(F.col("rings")).alias("a")).collect()}
    assert area == {z: pytest.approx(a) for z, a in {1: 200, 2: 175, 3: 85, 4: 225, 5: 100, 6: 100}.items()}
    assert parts == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1}
    assert {z: len(r) for z, r in found.items()} == {1: 2, 2: 1, 3: 3, 4: 1, 5: 1, 6: 1}
    assert found[5] == [square(0, 0, 10)] and len(found[4][0]) == 6 + 2
    for z, rings in found.items():
        assert sum(map(signed, rings)) == pytest.approx(area[z])


def test_union_of_random_rectangles_is_the_count_of_unit_squares(spark):
    rng, rows, covered = random.Random(6), [], {}
    for i in range(60):
        z, x, y, w, h = i % 3, rng.randrange(40), rng.randrange(40), rng.randint(1, 12), rng.randint(1, 12)
        rows.append((z, [square(x, y, w, h)]))
        covered.setdefault(z, set()).update(itertools.product(range(x, x + w), range(y, y + h)))
    made = outlines.union(table(spark, rows))
    got = {r["zone"]: r["a"] for r in made.select("zone", polygons.area(F.col("rings")).alias("a")).collect()}
    assert got == {z: pytest.approx(len(c)) for z, c in covered.items()}
    # And every small square's centre is in or out as it should be.
    points = spark.createDataFrame([(x, y, x + 0.5, y + 0.5) for x in range(-1, 54) for y in range(-1, 54)], "i int, j int, x double, y double")
    hit = {(r["zone"], r["i"], r["j"]) for r in polygons.points_in_polygons(points, made, 10.0).collect()}
    assert hit == {(z, x, y) for z, c in covered.items() for x, y in c}


def test_polygons_deep_in_each_other_are_not_cut(spark):
    """Edges under other polygons meet no others, so that the work grows with the outline; holes and large polygons count as they are."""
    rng, rows, covered = random.Random(3), [(2, [square(0, 0, 200), square(20, 20, 100)]), (2, [square(30, 30, 10)]), (2, [square(150, 150, 4)])], {}
    for _ in range(400):
        x, y = rng.randrange(-20, 40), rng.randrange(-20, 40)
        rows.append((1, [square(x, y, 45, 35)]))
        covered.setdefault(1, set()).update(itertools.product(range(x, x + 45), range(y, y + 35)))
    df = table(spark, rows)
    made = {r["zone"]: (r["outlines"], r["a"]) for r in outlines.union(df).select("zone", "outlines", polygons.area(F.col("rings")).alias("a")).collect()}
    assert made == {1: (1, pytest.approx(len(covered[1]))), 2: (2, pytest.approx(200 * 200 - 100 * 100 + 100))}
    edges = outlines._lattice_edges(df, 1e-6)
    dealt = outlines._deal(edges, 5e6)
    placed = dealt.where("e is not null").join(outlines._open(dealt), ["zone", "i", "j"], "left_semi")
    assert outlines._cut(edges, placed).count() < 4 * edges.count()


@pytest.mark.parametrize("seed", range(4))
def test_touched_and_covered_tiles(seed):
    """Every tile that a polygon covers away from its edges is in a run, and no other."""
    rng = np.random.default_rng(seed)
    p = rng.integers(-400, 400, (7, 2)).astype(float)
    q = np.roll(p, -1, 0)
    x0, y0, x1, y1 = *p.T, *q.T
    met = outlines.touched(x0, y0, x1, y1, 25.0)
    t = np.linspace(0, 1, 4000)[:, None]
    on = {(int(a), int(b)) for x, y in zip((x0 + t * (x1 - x0)).ravel(), (y0 + t * (y1 - y0)).ravel(), strict=True) for a, b in [(x // 25, y // 25)]}
    near = set(zip(met[1].tolist(), met[2].tolist(), strict=True))
    assert on <= near
    part, j, low, high = outlines.covered_runs(np.zeros(7, int), x0, y0, x1, y1, met, 25.0)
    inside = {(i, b) for b, c, d in zip(j.tolist(), low.tolist(), high.tolist(), strict=True) for i in range(c, d)}
    assert inside == {(i, b) for i in range(-20, 20) for b in range(-20, 20) if (i, b) not in near and polygons._holds(p, i * 25 + 12.5, b * 25 + 12.5)}
    blocks = [(level, run, n) for level, runs, ns in outlines._dyadic(low, high) for run, n in zip(runs.tolist(), ns.tolist(), strict=True)]
    assert sorted((int(j[run]), n * 2**level + s) for level, run, n in blocks for s in range(2**level)) == sorted((b, i) for i, b in inside)


def test_union_of_triangles_by_sampling(spark):
    rng, rows = random.Random(9), []
    for i in range(12):
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        rows.append((1, [[(x, y), (x + rng.uniform(3, 9), y + rng.uniform(-2, 2)), (x + rng.uniform(-2, 4), y + rng.uniform(3, 9))]]))
    made = outlines.union(table(spark, rows))
    area = made.select(polygons.area(F.col("rings")).alias("a")).first()["a"]

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    n, step = 0, 0.1
    for i, j in itertools.product(range(-30, 320), range(-30, 320)):
        n += any(inside(r[0], i * step, j * step) for _, r in rows)
    assert area == pytest.approx(n * step * step, rel=0.01)
    weights = polygons.cell_weights(made, 2.0).agg(F.sum("weight")).first()[0]
    assert weights == pytest.approx(1)


def test_multi_part_polygons_have_areas_and_weights(spark):
    """Two parts, the second with a hole and an island in it, in any order and direction."""
    rings = [square(0, 0, 10), square(20, 0, 10), square(22, 2, 6), square(24, 4, 2)]
    for order in itertools.permutations(range(4)):
        df = table(spark, [(1, [rings[i][:: 1 if i % 2 else -1] for i in order])])
        assert df.select(polygons.area(F.col("rings")).alias("a")).first()["a"] == pytest.approx(100 + 100 - 36 + 4)
        if order[0] < 2:
            got = {(r["r"], r["c"]): r["weight"] * 168 for r in polygons.cell_weights(df, 10.0).collect()}
            assert got == {(0, 0): pytest.approx(100), (0, 2): pytest.approx(68)}
            break


def test_dissolve_has_areas_and_weights(spark):
    df = polygons.dissolve(table(spark, [(1, [square(0, 0, 10)]), (1, [square(20, 0, 10)]), (2, [square(0, 0, 10)]), (2, [square(5, 0, 10)])]))
    assert {r["zone"]: (r["parts"], r["outlines"], r["a"]) for r in df.select("zone", "parts", "outlines", polygons.area(F.col("rings")).alias("a")).collect()} == {1: (2, 2, pytest.approx(200)), 2: (2, 1, pytest.approx(150))}
    weights = {(r["zone"], r["r"], r["c"]): r["weight"] for r in polygons.cell_weights(df, 10.0).collect()}
    assert weights == {(1, 0, 0): pytest.approx(0.5), (1, 0, 2): pytest.approx(0.5), (2, 0, 0): pytest.approx(2 / 3), (2, 0, 1): pytest.approx(1 / 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_of_patches(spark, seed):
    rng = random.Random(seed)
    grid = {(r, c): rng.randrange(2) for r in range(14) for c in range(11) if rng.random() < 0.92}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "r int, c int, value int")
    own = {}
    for r in raster.patches(df).collect():
        own.setdefault(r["patch"], set()).add((r["r"], r["c"]))
    rows = raster.patch_polygons(df).collect()
    assert {r["patch"] for r in rows} == set(own)
    for row in rows:
        cells, rings = own[row["patch"]], [[(p["x"], p["y"]) for p in ring] for ring in row["rings"]]
        assert row["cells"] == len(cells) == pytest.approx(sum(map(signed, rings))) and row["outlines"] == 1
        assert {grid[k] for k in cells} == {row["value"]}
        for ring in rings:
            assert len(set(ring)) == len(ring) or len(ring) > 4
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1]))
        length = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]))
        assert length == sum((a + i, b + j) not in cells for a, b in cells for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_empty(spark):
    none = table(spark, [])
    assert outlines.union(none).count() == 0 and polygons.dissolve(none).count() == 0


def test_outlines_of_many_patches_in_several_tasks(spark):
    """Patches go to tasks many at a time, whole however they are cut into batches, and to several tasks however few rows they have."""
    rng = random.Random(8)
    grid = [(r, c, rng.randrange(3)) for r in range(30) for c in range(30)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = raster.patch_polygons(spark.createDataFrame(grid, "r int, c int, value int"))
        rows = made.select("patch", "value", "cells", polygons.area(F.col("rings")).alias("area")).collect()
        edges = spark.createDataFrame([(k, *(v + 3 * k for v in e)) for k in range(40) for e in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))], "zone int, x0 int, y0 int, x1 int, y1 int")
        squares = outlines.assemble(edges, "zone", 0.5).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len({r["patch"] for r in rows}) == len(rows) and sum(r["cells"] for r in rows) == 900
    assert all(r["area"] == r["cells"] for r in rows)
    assert {r["zone"]: [[tuple(p) for p in ring] for ring in r["rings"]] for r in squares} == {k: [[(1.5 * k + x / 2, 1.5 * k + y / 2) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]] for k in range(40)}
    assert len({r["task"] for r in squares}) > 4
