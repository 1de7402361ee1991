"""Queries that SQL can't express, over the whole tables of sf0.01, against plain versions."""

import itertools
import math

import numpy as np
import pytest

from fluvia import adapt, plans
from fluvia.functions import variogram
from fluvia.operators import geostat
from fluvia.operators.series import average_ranks
from fluvia.plans import space

from .test_splines import whole

SF = "/root/testdata/sf0.01"
KINDS = {"krige_ordinary": "ordinary", "krige_simple": "simple", "krige_edk": "drift", "krige_indicator": "indicator", "krige_indicator_simple": "indicator_simple", "krige_edk_multi": "drift"}


@pytest.fixture(scope="module")
def months(spark):
    """Places and drifts of stations, and their values by month."""
    at = {r["stn"]: (r["x"], r["y"], r["z"]) for r in adapt.stations(spark, SF).collect()}
    known = {}
    for r in adapt.obs_month(spark, SF).collect():
        known.setdefault(r["m"], {})[r["stn"]] = r["value"]
    return at, known


@pytest.mark.parametrize("name", KINDS)
def test_kriging(spark, months, name):
    at, known = months
    got = {(r["stn"], r["m"]): r for r in plans.queries()[name](spark, SF).collect()}
    assert got.keys() == set(itertools.product(at, known))
    model = variogram.parse(space.MODEL)
    for (s, m), r in got.items():
        if (s + m) % 3:  # systems of a hundred by a hundred, one by one: every third
            assert r["status"] == "ok"
            continue
        others = sorted(b for b in known[m] if b != s)
        x, y, d = np.array([at[b] for b in others]).T
        drift, own = (np.stack([d, x], 1), (at[s][2], at[s][0])) if name == "krige_edk_multi" else (d, at[s][2])
        sill = float(np.var(list(known[m].values())))
        want = geostat._solve(KINDS[name], model, x, y, np.array([known[m][b] for b in others]), drift, *at[s][:2], own, sill, 25.0)
        assert r["status"] == want[3] == "ok"
        assert (r["estimate"], r["variance"], r["weights"]) == pytest.approx(want[:3], rel=1e-5, abs=1e-5)


def test_kriging_of_fields(spark, months):
    at, known = months
    cells = {(r["r"], r["c"]): (r["x"], r["y"]) for r in plans.queries()["target_mesh"](spark, SF).collect()}
    got = {(r["m"], r["r"], r["c"]): r for r in plans.queries()["krige_driver"](spark, SF).collect()}
    assert got.keys() == {(m, *k) for m in known for k in cells}
    for (m, r_, c_), r in got.items():
        if m % 5 == 0:
            assert r["status"] == "no model" and r["estimate"] is None
            continue
        if (m + r_ + c_) % 4:
            continue
        own = sorted(known[m])
        x, y, d = np.array([at[b] for b in own]).T
        z = np.array([known[m][b] for b in own])
        want = geostat._solve("ordinary", variogram.parse(space.MODEL if m % 2 == 0 else "4.0 Sph(500)"), x, y, z, d, *cells[r_, c_], 0.0, 0.0, 0.0)
        assert r["status"] == want[3] and r["estimate"] == pytest.approx(min(z.max(), max(z.min(), want[0])), rel=1e-5, abs=1e-5)
        assert r["variance"] == pytest.approx(want[1], rel=1e-5, abs=1e-5)


def test_cubic_zoom(spark):
    cells = {(r["r"], r["c"]): r["value"] for r in adapt.cells(spark, SF).collect()}
    rows = max(r for r, _ in cells) + 1
    image = np.full((rows, 50), np.mean(list(cells.values())))
    for k, v in cells.items():
        image[k] = v
    want = whole(whole(image, 3, 2 * rows).T, 3, 100).T
    low, high = min(cells.values()), max(cells.values())
    got = {(r["r"], r["c"]): r["value"] for r in plans.queries()["spline_zoom_cubic"](spark, SF).collect()}
    assert got.keys() == set(itertools.product(range(2 * rows), range(100)))
    near = lambda x, n: {min(abs(k), 2 * n - 2 - abs(k)) for k in range(math.floor(x) - 1, math.floor(x) + 3) if abs(x - k) < 2}
    for (r, c), v in got.items():
        y, x = r * (rows - 1) / (2 * rows - 1), c * 49 / 99
        lost = any((i, j) not in cells for i in near(y, rows) for j in near(x, 50))
        if v is None:
            assert lost or not low + 1e-5 < want[r, c] < high - 1e-5
        else:
            assert not lost and v == pytest.approx(want[r, c], abs=2e-6) and low - 1e-5 <= v <= high + 1e-5


def test_patches(spark):
    grid = {(r["r"], r["c"]): r["cls"] // 18 for r in adapt.cells(spark, SF).collect()}
    seen, want = set(), {}
    for start in sorted(grid):
        if start not in seen:
            stack, own = [start], set()
            while stack:
                k = stack.pop()
                if k not in own and grid.get(k) == grid[start]:
                    own.add(k)
                    stack += [(k[0] + i, k[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            seen |= own
            want[start[0] * (1 << 32) + start[1]] = (grid[start], len(own), sum((a + i, b + j) not in own for a, b in own for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    assert {r["patch"]: (r["value"], r["cells"], r["edges"]) for r in plans.queries()["polygonise"](spark, SF).collect()} == want


def test_fitted_models(spark, months):
    """Every month has its two best; their sums are those of their models, no higher than those of any model of a plain grid."""
    at, known = months
    rows = {}
    for r in plans.queries()["variogram_fit"](spark, SF).collect():
        rows.setdefault(r["m"], []).append(r)
    assert rows.keys() == {m for m, v in known.items() if len(v) >= 5}
    for m, two in rows.items():
        pairs = [(math.dist(at[a][:2], at[b][:2]), known[m][a] - known[m][b]) for a, b in itertools.combinations(sorted(known[m]), 2)]
        bins = {}
        for d, diff in pairs:
            if d <= 600:
                bins.setdefault(min(int(d // 50), 11), []).append((d, diff * diff))
        h, g, n = (np.array(v) for v in zip(*((np.mean([d for d, _ in b]), sum(q for _, q in b) / (2 * len(b)), len(b)) for _, b in sorted(bins.items())), strict=True))
        w = n / np.maximum(g, 1e-9) ** 2
        cost = lambda model: float(w @ (variogram.gamma_array(h, model) - g) ** 2)
        assert [r["place"] for r in sorted(two, key=lambda r: r["place"])] == [1, 2]
        best = min(two, key=lambda r: r["place"])
        for r in two:
            assert r["objective"] == pytest.approx(cost(variogram.parse(r["model"])), rel=1e-3, abs=1e-5)
        for kind in ("Sph", "Exp"):
            for reach in np.linspace(h.min(), 1.5 * h.max(), 8):
                shape = variogram.gamma_array(h, [(1.0, kind, reach)])
                plain = len(h) * math.log(max(cost([(float((w * shape) @ g / ((w * shape) @ shape)), kind, reach)]), 1e-300)) + 4
                assert best["aic"] <= plain + 1e-3


def test_asymmetries_of_copulas(spark, months):
    at, known = months
    got = {(r["a"], r["b"]): r for r in plans.queries()["copula_symmetry"](spark, SF).collect()}
    for a in at:
        near = sorted((math.dist(at[a][:2], at[b][:2]), b) for b in at if b != a)[:3]
        for _, b in near:
            both = [(v[a], v[b]) for v in known.values() if a in v and b in v]
            r = got[a, b]
            p = average_ranks(np.array(both)) / (len(both) + 1)
            assert r["n"] == len(both) and r["a1"] == pytest.approx(float(((p.sum(1) - 1) ** 3).mean())) and r["a2"] == pytest.approx(float(((p[:, 0] - p[:, 1]) ** 3).mean()))
            assert r["low1"] <= r["high1"] and r["symmetric"] == (r["low1"] <= r["a1"] <= r["high1"] and r["low2"] <= r["a2"] <= r["high2"])
    assert len(got) == 3 * len(at)


@pytest.fixture(scope="module")
def filled(spark):
    return {(r["stn"], r["m"]): r for r in plans.queries()["infill_discharge"](spark, SF).collect()}


def test_flags_and_summary_follow_the_infilling(spark, filled):
    flags = {k: -1 if r["observed"] < r["q"][0] else int(r["observed"] > r["q"][-1]) for k, r in filled.items() if r["observed"] is not None and r["q"] is not None}
    share = {}
    for (s, _), f in flags.items():
        share.setdefault(s, []).append(abs(f))
    got = plans.queries()["qc_flags"](spark, SF).collect()
    assert {(r["stn"], r["m"]): r["flag"] for r in got} == flags
    assert all(r["flagged"] == pytest.approx(100 * np.mean(share[r["stn"]]), abs=1e-5) for r in got)
    rows = {r["stn"]: r for r in plans.queries()["infill_summary"](spark, SF).collect()}
    assert rows.keys() == {s for s, _ in filled}
    for s, r in rows.items():
        own = [v for (k, _), v in filled.items() if k == s]
        middle = lambda v: v["q"][len(v["q"]) // 2] if v["q"] is not None else None
        pairs = np.array([(v["observed"], middle(v)) for v in own if v["observed"] is not None and middle(v) is not None]).reshape(-1, 2)
        gaps = [v for v in own if v["observed"] is None]
        assert (r["available"], r["missing"], r["infilled"], r["compared"]) == (len(own) - len(gaps), len(gaps), sum(middle(v) is not None for v in gaps), len(pairs))
        if len(pairs) > 2:
            o, f = pairs.T
            assert (r["bias"], r["mae"], r["rmse"], r["mean_observed"], r["var_infilled"]) == pytest.approx((np.mean(o - f), np.mean(abs(o - f)), np.mean((o - f) ** 2) ** 0.5, o.mean(), f.var()))
            assert r["ns"] == pytest.approx(1 - ((o - f) ** 2).sum() / ((o - o.mean()) ** 2).sum()) and r["pearson"] == pytest.approx(np.corrcoef(o, f)[0, 1])


def test_rain_and_dry_days(spark):
    """Every gap has a row; it is dry exactly where all neighbours with a value are; quantiles rise and stay within the station's values."""
    rain = {}
    for r in adapt.series(spark, SF).collect():
        rain.setdefault(r["stn"], {})[r["d"]] = max(0.0, r["value"] - 45)
    days = sorted({d for v in rain.values() for d in v})
    every = [days[0] + (days[1] - days[0]) * 0 + i * (days[-1] - days[0]) / max(1, (days[-1] - days[0]).days) for i in range((days[-1] - days[0]).days + 1)]
    near = {}
    for r in infill_neighbours(spark):
        near.setdefault(r["stn"], []).append(r["neighbour"])
    got = {(r["stn"], r["d"]): r for r in plans.queries()["infill_precip"](spark, SF).collect()}
    assert got.keys() == {(s, d) for s, v in rain.items() for d in every if d not in v}
    for (s, d), r in got.items():
        values = [rain[n][d] for n in near.get(s, []) if d in rain[n]]
        assert r["n_raw"] == len(values) and r["observed"] is None
        if not values:
            assert r["status"] == "too few neighbours"
        elif max(values) <= 0:
            assert r["status"] == "dry" and set(r["q"]) == {0.0}
        else:
            assert r["status"] in ("ok", "too few common values", "no solution", "no range")
            if r["status"] == "ok":
                assert r["q"] == sorted(r["q"]) and 0 <= r["q"][0] and r["q"][-1] <= max(rain[s].values()) + 1e-3 and 0 < r["sigma"] <= 1


def infill_neighbours(spark):
    from pyspark.sql import functions as F

    from fluvia.operators import series

    rain = adapt.series(spark, SF).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - 45))
    return series.correlated_neighbours(rain, "d", 4, 0.0, 15).select("stn", "neighbour", "place").collect()
