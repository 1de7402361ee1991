"""Spline zooms, datum shifts and reprojections against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import projection
from fluvia.operators import raster, splines


def whole(values, order, n_out):
    """Spline interpolation along the first axis by solving for all coefficients at once."""
    n = len(values)

    def row(x):
        out = np.zeros(n)
        for k in range(math.floor(x) - 4, math.floor(x) + 6):
            i = abs(k) % (2 * n - 2) if n > 1 else 0
            out[i if i < n else 2 * n - 2 - i] += float(splines.basis(np.array([x - k]), order)[0])
        return out

    c = np.linalg.solve(np.stack([row(i) for i in range(n)]), values)
    return np.stack([row(i * (n - 1) / (n_out - 1) if n_out > 1 else 0.0) for i in range(n_out)]) @ c


def test_basis_is_the_spline():
    x = np.linspace(-3.5, 3.5, 71)
    for order in splines.POLES:
        assert splines.basis(x, order).min() > -1e-12
        assert sum(splines.basis(x[:20] % 1 + k, order) for k in range(-4, 5)) == pytest.approx(np.ones(20))
    assert splines.basis(np.array([0.0, 1.0, 2.0]), 3) == pytest.approx([2 / 3, 1 / 6, 0])


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_zoom_in_tiles_is_that_of_the_whole(spark, order, monkeypatch):
    monkeypatch.setattr(splines, "TILE", 16)
    rng = np.random.default_rng(order)
    image = rng.normal(size=(23, 41)).cumsum(0).cumsum(1)
    df = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(23) for c in range(41)], "r int, c int, value double").repartition(4)
    for factor in (2.5, 0.7):
        a, b = round(23 * factor), round(41 * factor)
        want = whole(whole(image, order, a).T, order, b).T
        got = {(r["r"], r["c"]): r["value"] for r in splines.spline_zoom(df, 23, 41, factor, order).collect()}
        assert set(got) == set(itertools.product(range(a), range(b)))
        for k, v in got.items():
            inside = image.min() <= want[k] <= image.max()
            assert v == (pytest.approx(want[k], abs=1e-8) if inside else None) or abs(want[k] - image.min()) < 1e-8 or abs(want[k] - image.max()) < 1e-8
        free = {(r["r"], r["c"]): r["value"] for r in splines.spline_zoom(df, 23, 41, factor, order, -1e9, 1e9).collect()}
        assert all(free[k] == pytest.approx(want[k], abs=1e-8) for k in free)
        assert any(v is None for v in got.values()) or factor < 1


def test_halos_are_wide_enough_in_long_rows(spark, monkeypatch):
    monkeypatch.setattr(splines, "TILE", 64)
    values = np.random.default_rng(1).normal(size=(1, 400))
    df = spark.createDataFrame([(0, c, float(values[0, c])) for c in range(400)], "r int, c int, value double")
    got = {r["c"]: r["value"] for r in splines.spline_zoom(df, 1, 400, 2.0, 5, -99.0, 99.0).where("r = 1").collect()}
    want = whole(values[0], 5, 800)
    assert [got[c] for c in range(800)] == pytest.approx(want.tolist(), abs=1e-9)


def test_missing_cells_and_empty(spark):
    image = np.arange(120.0).reshape(10, 12)
    rows = [(r, c, float(image[r, c]) if (r, c) != (4, 5) else None) for r in range(10) for c in range(12) if (r, c) != (0, 0)]
    df = spark.createDataFrame(rows, "r int, c int, value double")
    got = {(r["r"], r["c"]): r["value"] for r in splines.spline_zoom(df, 10, 12, 1.0, 3).collect()}
    assert got[4, 5] is None and got[3, 4] is None and got[0, 0] is None and got[8, 9] == pytest.approx(image[8, 9], abs=0.6)
    assert splines.spline_zoom(df.where("r > 99"), 10, 12, 2.0).count() == 0
    with pytest.raises(ValueError):
        splines.spline_zoom(df, 10, 12, 2.0, 6)


SEVEN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)


def test_datum_shift_there_and_back(spark):
    rows = [(float(lon), float(lat)) for lon in range(-170, 180, 35) for lat in (-80, -33, 0, 48, 51, 89)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    there = projection.shift_datum(F.col("lon"), F.col("lat"), projection.BESSEL, projection.WGS84, SEVEN)
    moved = df.select("lon", "lat", *(c.alias(n) for c, n in zip(there, ("a", "b", "h"))))
    back = projection.shift_datum(F.col("a"), F.col("b"), projection.BESSEL, projection.WGS84, SEVEN, F.col("h"), back=True)
    for r in moved.select("*", *(c.alias(n) for c, n in zip(back, ("c", "d", "e")))).collect():
        metre = 1 / 111_000
        assert abs(r["d"] - r["lat"]) < 1e-3 * metre and abs(r["c"] - r["lon"]) * math.cos(math.radians(r["lat"])) < 1e-3 * metre and abs(r["e"]) < 1e-3
        assert 20 < math.hypot((r["a"] - r["lon"]) * math.cos(math.radians(r["lat"])), r["b"] - r["lat"]) / metre < 1000 or abs(r["lat"]) > 60 or abs(r["lon"]) > 60


def test_cartesian_of_known_points(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (90.0, 0.0, 100.0), (0.0, 90.0, 0.0)], "lon double, lat double, h double")
    xyz = projection.to_cartesian(F.col("lon"), F.col("lat"), F.col("h"))
    got = [tuple(r) for r in df.select(*xyz).collect()]
    b = projection.WGS84[0] * (1 - projection.WGS84[1])
    for g, want in zip(got, [(6378137, 0, 0), (0, 6378237, 0), (0, 0, b)]):
        assert g == pytest.approx(want, abs=1e-6)


def test_transverse_mercator_there_and_back(spark):
    rows = [(9.0 + d, float(lat)) for d in (-3, -0.5, 0, 2.9) for lat in (-60, 0, 12, 48, 75)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = projection.to_transverse_mercator(F.col("lon"), F.col("lat"), 9.0, 1.0, 3_500_000.0, ellipsoid=projection.BESSEL)
    lon, lat = projection.from_transverse_mercator(x, y, 9.0, 1.0, 3_500_000.0, ellipsoid=projection.BESSEL)
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r["a"] - r["lon"]) < 1e-8 and abs(r["b"] - r["lat"]) < 1e-8


def test_reprojection_methods(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 100, (12, 16)).astype(float)
    df = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(12) for c in range(16)], "r int, c int, value double")
    turn = lambda x, y: (x * 0.8 - y * 0.6 + 20.0, x * 0.6 + y * 0.8 - 4.0)
    targets = spark.createDataFrame([(r, c, 4.0 * c + 2, 4.0 * r + 2) for r in range(-8, 12) for c in range(-10, 12)], "r int, c int, x double, y double")
    mean = {(r["r"], r["c"]): r["value"] for r in raster.reproject(df, targets, turn, 0.0, 0.0, 2.0, "average", 4.0).collect()}
    assert len(mean) == 20 * 22
    # Each target cell against fine points; and all together keep the sum.
    fine = (np.arange(40) + 0.5) / 10 - 2
    for (r, c), v in mean.items():
        x, y = turn(4.0 * c + 2 + fine[None, :], 4.0 * r + 2 + fine[:, None])
        i, j = np.floor(y / 2).astype(int), np.floor(x / 2).astype(int)
        inside = (i >= 0) & (i < 12) & (j >= 0) & (j < 16)
        if inside.sum() > 200:
            assert v == pytest.approx(image[i[inside], j[inside]].mean(), abs=1.5)
        elif not inside.any():
            assert v is None or (~inside).sum() > 1400
    two = {(r["r"], r["c"]): r["value"] for r in raster.reproject(df, targets, turn, 0.0, 0.0, 2.0, "bilinear").collect()}
    for (r, c), v in two.items():
        x, y = turn(4.0 * c + 2, 4.0 * r + 2)
        fr, fc = y / 2 - 0.5, x / 2 - 0.5
        if 0 <= fr < 11 and 0 <= fc < 15:
            a, b = int(fr), int(fc)
            u, w = fr - a, fc - b
            assert v == pytest.approx(image[a, b] * (1 - u) * (1 - w) + image[a + 1, b] * u * (1 - w) + image[a, b + 1] * (1 - u) * w + image[a + 1, b + 1] * u * w)
        else:
            assert v is None
    with pytest.raises(ValueError):
        raster.reproject(df, targets, turn, 0.0, 0.0, 2.0, "lanczos")


def test_average_keeps_the_mass(spark):
    """Where the targets cover the whole raster, areas times means make up the raster's sum."""
    rng = np.random.default_rng(3)
    image = rng.integers(1, 9, (6, 6)).astype(float)
    df = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(6) for c in range(6)], "r int, c int, value double")
    shear = lambda x, y: (x + 0.3 * y, y)
    targets = spark.createDataFrame([(r, c, 1.5 * c + 0.75, 1.5 * r + 0.75) for r in range(4) for c in range(-3, 5)], "r int, c int, x double, y double")
    out = raster.reproject(df, targets, shear, 0.0, 0.0, 1.0, "average", 1.5).collect()
    fine = (np.arange(60) + 0.5) / 40 - 0.75
    total = 0.0
    for r in out:
        x, y = shear(1.5 * r["c"] + 0.75 + fine[None, :], 1.5 * r["r"] + 0.75 + fine[:, None] + 0 * fine[None, :])
        total += (r["value"] or 0) * ((x >= 0) & (x < 6) & (y >= 0) & (y < 6)).mean() * 2.25
    assert total == pytest.approx(image.sum(), rel=0.01)
