"""Long groups in parts, neighbours with rules, snapping, catalogues and GeoJSON, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from fluvia.operators import copula, geostat, infill, polygons, raster, series, spatial
from fluvia.sources import tables


@pytest.mark.parametrize("part_rows", [10, 40, 100_000])
def test_kendall_in_ranges_is_that_of_all_pairs(spark, part_rows):
    rng, rows = random.Random(part_rows), []
    for g, n, ties in ((1, 150, 8), (2, 40, 1000), (3, 1, 5), (4, 90, 1)):
        rows += [(g, rng.randrange(ties) / 7, rng.randrange(ties) / 5) for _ in range(n)]
    rows += [(1, None, 0.5), (2, float("nan"), 0.5)]
    got = {r["g"]: r["tau_b"] for r in copula.kendall_tau_b(spark.createDataFrame(rows, "g int, u double, v double").repartition(5), "g", part_rows).collect()}
    for g in (1, 2, 3, 4):
        own = [(u, v) for k, u, v in rows if k == g and u is not None and u == u]
        sign = lambda x: (x > 0) - (x < 0)
        s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a, b in itertools.combinations(own, 2)]
        below = (sum(abs(x) for x, _ in s) * sum(abs(y) for _, y in s)) ** 0.5
        assert got[g] == (pytest.approx(sum(x * y for x, y in s) / below) if below else None)


def test_equal_counts_by_ranges(spark):
    """Ranges of pairs and series in pieces, for dates and for texts as times; bins of seven in the order of distance."""
    rng = random.Random(2)
    stations = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(25)]
    times = ["2001-01-%02d" % d for d in range(1, 20)]
    obs = [(i, t, rng.uniform(0, 9)) for i, _, _ in stations for t in times if rng.random() < 0.7]
    places = {i: (x, y) for i, x, y in stations}
    known = {}
    for i, t, v in obs:
        known.setdefault(t, {})[i] = v
    s = spark.createDataFrame(stations, "stn int, x double, y double")
    for kind in ("string", "date"):
        df = spark.createDataFrame(obs, "stn int, t string, value double").selectExpr("stn", f"cast(t as {kind}) as t", "value")
        made = geostat.equal_count(geostat.value_pairs(df, s, None, "t", ranged=True), 7, "t")
        got = {(str(r["t"]), r["a"], r["b"]): (r["bin"], r["va"], r["vb"]) for r in made.collect()}
        want = {}
        for t, values in known.items():
            order = sorted((((places[a][0] - places[b][0]) ** 2 + (places[a][1] - places[b][1]) ** 2) ** 0.5, a, b) for a, b in itertools.combinations(sorted(values), 2))
            want |= {(t, a, b): (k // 7, values[a], values[b]) for k, (_, a, b) in enumerate(order)}
        assert got == want


@pytest.mark.parametrize("kind", ["string", "date"])
def test_equal_count_bins(spark, monkeypatch, kind):
    """Bins of seven that lie in one or several ranges of some ten pairs; series in several pieces."""
    for name, v in (("PAIRS", 10), ("PIECE", 8)):
        monkeypatch.setattr(geostat, name, v)
    rng = random.Random(3)
    places = {i: (float(rng.randrange(30)), float(rng.randrange(30))) for i in range(15)}
    known = {"2001-01-%02d" % d: {i: rng.uniform(0, 9) for i in places if rng.random() < 0.6} for d in range(1, 20)}
    obs = spark.createDataFrame([(i, t, v) for t, own in known.items() for i, v in own.items()], "stn int, t string, value double")
    s = spark.createDataFrame([(i, *p) for i, p in places.items()], "stn int, x double, y double")
    made = geostat.equal_count_bins(obs.selectExpr("stn", f"cast(t as {kind}) as t", "value"), s, None, 7, "t")
    got = {(str(r["t"]), r["bin"]): (r["dist"], r["classic"], r["robust"], r["n"]) for r in made.collect()}
    want = {}
    for t, own in known.items():
        order = sorted((math.dist(places[a], places[b]), a, b) for a, b in itertools.combinations(sorted(own), 2))
        for k in range(0, len(order), 7):
            some, n = order[k : k + 7], len(order[k : k + 7])
            off = [abs(own[a] - own[b]) for _, a, b in some]
            root = (sum(v**0.5 for v in off) / n) ** 4 / (0.457 + 0.494 / n) / 2
            want[t, k // 7] = (sum(d for d, _, _ in some) / n, sum(v * v for v in off) / (2 * n), root, n)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest_cells_of_a_part_of_the_grid(spark, monkeypatch):
    """Points of a dense corner of a wide and thin grid are looked for at the spacing there."""
    rng = random.Random(5)
    cells = [(r, c, c + 0.1 * r, r + 0.1 * c) for r in range(8) for c in range(8)] + [(9, k, 5000.0 * k, 5000.0 * k) for k in range(1, 9)]
    points = [(i, rng.uniform(0, 7), rng.uniform(0, 7)) for i in range(40)] + [(40, 0.0, 0.0), (41, 7.0, 7.0)]
    reaches, pairs = [], spatial.tiled_pairs
    monkeypatch.setattr(spatial, "tiled_pairs", lambda a, b, reach=None: reaches.append(reach) or pairs(a, b, reach))
    made = raster.nearest_of_curved(spark.createDataFrame(points, "stn int, x double, y double"), spark.createDataFrame(cells, "r int, c int, x double, y double"))
    got = {r["stn"]: (r["r"], r["c"]) for r in made.collect()}
    assert got == {i: min((math.dist((x, y), at), r, c) for r, c, *at in cells)[1:] for i, x, y in points}
    assert max(reaches) < 20


def test_neighbours_with_enough_common_steps(spark):
    obs = [(1, t, 1.0) for t in range(10)] + [(2, t, 1.0) for t in range(4, 16)] + [(3, t, 1.0) for t in range(9)] + [(4, 20, 1.0)] + [(5, t, None) for t in range(10)]
    near = [(1, n, p) for p, n in enumerate((4, 5, 3, 2), 1)]
    df, n = spark.createDataFrame(obs, "stn int, t int, value double"), spark.createDataFrame(near, "stn int, neighbour int, place int")
    found = lambda **more: [(r["neighbour"], r["place"], r["n"]) for r in series.valid_neighbours(df, n, "t", 3, 2, **more).orderBy("place").collect()]
    assert found() == [(3, 1, 9), (2, 2, 6)] and found(gaps=True) == [(2, 1, 6)]
    assert found(first=9) == [(2, 1, 6)] and found(last=3) == [(3, 1, 9)] and found(first=20, last=30) == []


def test_infill_of_dates_without_gaps(spark):
    """Stations without a gap give no rows, of the right types; discharge and precipitation."""
    rows = [(s, f"2001-01-{d:02d}", float(d + s)) for s in (1, 2) for d in range(1, 29)]
    obs = spark.createDataFrame(rows, "stn int, d string, value double").selectExpr("stn", "cast(d as date) d", "value")
    near = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "stn int, neighbour int, place int")
    for kind in ("discharge", "precipitation"):
        made = infill.infill(obs, near, "d", infill.Settings(kind=kind, min_valid=5))
        assert made.count() == 0 and dict(made.dtypes)["d"] == "date"
        assert infill.infill(obs.where("stn = 1 or d <> '2001-01-05'"), near, "d", infill.Settings(kind=kind, min_valid=5)).count() == 1


def test_snapped_masks_and_far_cells(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(6) for c in range(6)], "r int, c int, value double")
    other = spark.createDataFrame([(0, 0, 1.0), (1, 1, None)], "r int, c int, value double")
    got = {(r["r"], r["c"]) for r in raster.mask_snapped(cells, 0.0, 0.0, 1.0, other, 1.0, 2.0, 2.5).where("value is not null").collect()}
    assert got == {(r, c) for r in range(6) for c in range(6) if 2 <= r + 0.5 < 4.5 and 1 <= c + 0.5 < 3.5}
    grid = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.2), (1, 0, -0.2, 1.0)], "r int, c int, x double, y double")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 5000.0, 3.0), (3, -9e5, -9e5)], "stn int, x double, y double")
    assert {(r["stn"], r["r"], r["c"]) for r in raster.nearest_of_curved(points, grid).collect()} == {(1, 0, 0), (2, 0, 1), (3, 0, 0)}
    assert raster.nearest_of_curved(points, grid.limit(0)).count() == 0


def test_catalogues_and_geojson(spark, tmp_path):
    one = spark.createDataFrame([("a/x1", "2001-01-01"), ("a/x2", "2001-01-02"), ("a/x3", "2001-01-02")], "path string, d string")
    two = spark.createDataFrame([("b/y2", "2001-01-02"), ("b/y9", "2001-01-09")], "path string, d string")
    assert [tuple(r) for r in tables.aligned({"rain": one, "heat": two, "snow": two}).collect()] == [("2001-01-02", "a/x2", "b/y2", "b/y2")]
    shapes = [(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], []]), (2, [[(1.5, 1.5), (2.5, 1.5), (2.0, 9.0), (1.5, 1.5)]])]
    df = spark.createDataFrame(shapes, f"zone int, rings {polygons.RINGS}")
    tables.write_geojson(df, str(tmp_path / "g"), "zone")
    back = {r["zone"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in tables.read_geojson(spark, str(tmp_path / "g"), "zone").collect()}
    assert back == {"1": [[(0, 0), (4, 0), (4, 4), (0, 0)]], "2": [[(1.5, 1.5), (2.5, 1.5), (2, 9), (1.5, 1.5)]]}
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "features": [\n{"type": "Feature", "properties": {"id": "k"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}}\n]}')
    assert tables.read_geojson(spark, str(tmp_path / "c.json"), "id").count() == 2


def test_equal_means_are_equal_however_rows_are_dealt(spark, tmp_path):
    import datetime
    import itertools

    from fluvia import plans

    day = lambda k: datetime.datetime(2024, 1, k, 5)
    rows = []
    for user, order in enumerate(itertools.permutations([60.32, 110.86, 17.23, 45.71])):
        rows += [(4 * user + 1, day(1), v) for v in (59.71, 57.35)] + [(4 * user + 1, day(2), v) for v in order]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    steps = plans.queries()["first_differences"](spark, str(tmp_path)).where("step is not null").collect()
    assert len(steps) == 24 and {(r["step"], r["rises"]) for r in steps} == {(0.0, True)}
    assert all(r["rising"] for r in plans.queries()["monotonic_check"](spark, str(tmp_path)).collect())


def test_ranges_of_distances(spark, monkeypatch):
    """Bins over several cuts, ranges, panels and tiles, with equal distances and missing values, against pairs as rows; no pair is a row, and a cut
    holds few pairs."""
    for name, v in (("PAIRS", 60), ("PANEL", 8), ("TILE", 3), ("COUNTED", 4), ("SPLIT", 3), ("FEWEST", 5)):
        monkeypatch.setattr(geostat, name, v)
    rng = np.random.default_rng(9)
    s = spark.createDataFrame([*((i * 7 % 60, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (60, 2)))), (99, None, 1.0)], "stn long, x double, y double")
    obs = spark.createDataFrame([(i, t, float(rng.normal()) if rng.random() < 0.8 else None) for i in (*range(60), 99) for t in (-9, -1, 0, 7, 8, 30)], "stn long, t int, value double")
    want = geostat.binned(geostat.equal_count(geostat.value_pairs(obs, s, 14.0, "t", ranged=True), 7, "t"), ["t", "bin"]).collect()
    made = geostat.equal_count_bins(obs, s, 14.0, 7, "t")
    got = {(r["t"], r["bin"]): (r["dist"], r["classic"], r["robust"], r["n"]) for r in made.collect()}
    assert len(want) > 100 and got == {(r["t"], r["bin"]): pytest.approx((r["dist"], r["classic"], r["robust"], r["n"])) for r in want}
    edges, found = geostat._distance_edges(s, 14.0)
    d = np.array([r["dist"] for r in spatial.station_pairs(s.where("x is not null"), 14.0).collect()])
    assert (np.diff(edges) > 0).all() and found.tolist() == np.histogram(d, edges)[0].tolist() and len(found) > 4
    assert all(n <= 60 or len(np.unique(d[(d >= low) & (d < high)])) < 6 for n, low, high in zip(found, edges, edges[1:]))
    assert "FlatMapCoGroups" not in made._jdf.queryExecution().toString()
