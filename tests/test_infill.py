"""Infilling against plain versions, one number at a time."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions.normal import cdf_array, ppf_array
from fluvia.operators import infill, series


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def ppf(p):
    return float(ppf_array(np.array(p)))


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


@pytest.fixture(scope="module")
def panel(spark):
    """Four related stations with gaps; the first is to be filled."""
    rng, rows = random.Random(3), []
    for m in range(80):
        base = rng.gauss(10, 3)
        for stn in (1, 2, 3, 4):
            v = base + rng.gauss(0, 1 + stn / 3)
            if not ((stn == 1 and m % 7 == 0) or (stn == 3 and m % 9 == 0) or (stn == 4 and m > 60)):
                rows.append((stn, m, round(v, 3)))
    return rows, spark.createDataFrame(rows, "stn int, m int, value double")


def neighbours(spark, near):
    return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(near)], "stn int, neighbour int, place int")


def test_conditional_moments_and_quantiles(spark, panel):
    rows, df = panel
    table = {}
    for s, m, v in rows:
        table.setdefault(m, {})[s] = v
    got = {r["m"]: r for r in infill.infill(df, neighbours(spark, (2, 3, 4)), "m", everywhere=True).where("stn = 1").collect()}
    assert set(got) == set(range(80))
    for m, r in got.items():
        free = [s for s in (2, 3, 4) if s in table[m]]
        assert r["n_raw"] == len(free)
        chosen = next(c for k in range(len(free), 0, -1) for c in itertools.combinations(free, k) if sum(all(s in table[t] for s in (1, *c)) for t in table) >= 20)
        sample = [t for t in sorted(table) if all(s in table[t] for s in (1, *chosen))]
        cols = {s: [table[t][s] for t in sample] for s in (1, *chosen)}
        p = {s: [x / (len(sample) + 1) for x in ranks(c)] for s, c in cols.items()}
        z = {s: [ppf(x) for x in c] for s, c in p.items()}
        corr = np.array([[pearson(z[a], z[b]) for b in (1, *chosen)] for a in (1, *chosen)])
        w = np.linalg.inv(corr[1:, 1:]) @ corr[1:, 0]
        u = []
        for s in chosen:
            pts = sorted(zip(cols[s], p[s]))
            u.append(ppf(np.interp(table[m][s], [a for a, _ in pts], [b for _, b in pts])))
        mu, sigma = float(w @ u), math.sqrt(1 - float(w @ corr[1:, 0]))
        assert (r["status"], r["n_used"], r["n_recs"]) == ("ok", len(chosen), len(sample))
        assert (r["mu"], r["sigma"]) == (pytest.approx(mu, abs=1e-9), pytest.approx(sigma, abs=1e-9))
        pts = [(v, q) for v, q in sorted(zip(cols[1], p[1])) if 1e-4 < float(cdf_array(np.array((ppf(q) - mu) / sigma))) < 0.9999]
        at = np.linspace(0, len(pts) - 1, 300)
        v, q = np.interp(at, range(len(pts)), [a for a, _ in pts]), np.interp(at, range(len(pts)), [b for _, b in pts])
        g = [float(cdf_array(np.array((ppf(x) - mu) / sigma))) for x in q]
        assert r["q"] == pytest.approx([round(float(np.interp(c, g, v)), 3) for c in (0.05, 0.25, 0.5, 0.75, 0.95)], abs=1.1e-3)
        assert r["q"] == sorted(r["q"])
        if 1 in table[m]:
            assert r["prob"] == pytest.approx(float(np.interp(table[m][1], v, g, left=1e-4, right=0.9999)))
        else:
            assert r["prob"] is None and r["observed"] is None


def test_only_gaps_and_their_status(spark, panel):
    _, df = panel
    gaps = infill.infill(df, neighbours(spark, (2, 3, 4)), "m").where("stn = 1").collect()
    assert {r["m"] for r in gaps} == {m for m in range(80) if m % 7 == 0} and all(r["status"] == "ok" for r in gaps)
    strict = infill.infill(df, neighbours(spark, (2,)), "m", infill.Settings(min_valid=79)).where("stn = 1")
    assert {r["status"] for r in strict.collect()} == {"too few common values"}
    nobody = infill.infill(df, spark.createDataFrame([], "stn int, neighbour int, place int"), "m").where("stn = 1")
    assert {r["status"] for r in nobody.collect()} == {"too few neighbours"}
    twin = df.union(df.where("stn = 2").selectExpr("9", "m", "value"))
    both = infill.infill(twin, neighbours(spark, (2, 9)), "m").where("stn = 1").collect()
    assert {r["n_used"] for r in both} == {1}  # a neighbour that equals another is dropped


def test_moments_alone_and_in_several_tasks(spark, panel):
    rows, df = panel
    near = neighbours(spark, [2, 3, 4])
    both = [infill.infill(df, near, "m", infill.Settings(quantiles=q), everywhere=True) for q in (True, False)]
    whole, moments = ({(r["stn"], r["m"]): r for r in made.collect()} for made in both)
    assert whole.keys() == moments.keys() and any(r["q"] for r in whole.values())
    for k, r in moments.items():
        assert all(r[c] == whole[k][c] for c in ("observed", "status", "n_raw", "n_used", "n_recs", "mu", "sigma"))
        assert r["q"] is r["prob"] is None or r["status"] == "dry"
    # Stations are spread, however few rows they have.
    assert len({r["task"] for r in both[1].select(F.spark_partition_id().alias("task")).collect()}) > 1


def test_draws_are_seeded_and_within_range(spark, panel):
    rows, df = panel
    s = infill.Settings(draws=50)
    one, two = (sorted((r["m"], tuple(r["draws"])) for r in infill.infill(df, neighbours(spark, (2, 3)), "m", s).where("stn = 1").collect()) for _ in range(2))
    own = [v for s_, _, v in rows if s_ == 1]
    assert one == two and all(min(own) <= v <= max(own) for _, d in one for v in d)


def test_precipitation(spark):
    rng, rows = random.Random(8), []
    for m in range(120):
        wet = rng.random() < 0.6
        for stn in (1, 2, 3):
            v = max(0.0, rng.gammavariate(0.8, 6) - 1) if wet and rng.random() < 0.9 else 0.0
            if not (stn == 1 and m % 6 == 0):
                rows.append((stn, m, round(v, 2)))
    df = spark.createDataFrame(rows, "stn int, m int, value double")
    got = infill.infill(df, neighbours(spark, (2, 3)), "m", infill.Settings(kind="precipitation", dry=0.0, damp=1.0), everywhere=True).where("stn = 1").collect()
    at = {(s, m): v for s, m, v in rows}
    for r in got:
        if at[2, r["m"]] == 0 and at[3, r["m"]] == 0:
            assert r["status"] == "dry" and set(r["q"]) == {0.0}
        else:
            assert r["status"] == "ok" and r["q"] == sorted(r["q"]) and r["q"][0] >= 0
    wet = [r["q"][2] for r in got if r["status"] == "ok" and at[2, r["m"]] > 8]
    damp = [r["q"][2] for r in got if r["status"] == "ok" and at[2, r["m"]] < 1]
    assert np.mean(wet) > np.mean(damp)


def test_mixed_probabilities_are_sorted_twice_at_most(spark):
    rng = random.Random(5)
    rows = [(s, k, float(rng.randrange(0, 12))) for s in range(3) for k in range(49)]
    made = series.mixed_probabilities(spark.createDataFrame(rows, "stn int, m int, value double"), 3, 6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort ") <= 2
    for r in made.collect():
        own = [v for s, _, v in rows if s == r["stn"]]
        wet, p0, p1 = [v for v in own if v > 6], sum(v <= 3 for v in own) / 49, sum(v <= 6 for v in own) / 49
        rank = sum(v < r["value"] for v in wet) + (sum(v == r["value"] for v in wet) + 1) / 2
        assert r["p"] == (p1 + (1 - p1) * rank / (len(wet) + 1) if r["value"] > 6 else p0 / 2 if r["value"] <= 3 else (p0 + p1) / 2)


def test_mixed_probabilities_of_a_sample():
    s = infill.Settings(kind="precipitation", dry=0.0, damp=1.0)
    m = infill._Marginal(np.array([0, 0, 0, 0.5, 2, 5, 5, 9.0]), s)
    assert m.p == pytest.approx([0.1875] * 3 + [0.4375, 0.6, 0.75, 0.75, 0.9])
    assert m.at(np.array([0.0, 0.7, 3.5, 100]), 0.5) == pytest.approx([0.28125, 0.4375, 0.675, 0.9])


@pytest.mark.parametrize("wrong", [{"kind": "snow"}, {"probabilities": (0.5, 0.5)}, {"probabilities": (0.0, 0.5)}, {"low": 0.9, "high": 0.1}, {"min_valid": 0}, {"points": 1}, {"dry": 2.0}, {"max_corr": 1.5}, {"draws": -1}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        infill.Settings(**wrong)


def test_symmetry_against_simulation(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(300)
    y = 0.7 * x + 0.7 * rng.standard_normal(300)
    skew = np.where(x > 0, x, 0.1 * x + rng.standard_normal(300))  # tightly related at one end alone
    rows = [(1, 2, float(a), float(b)) for a, b in zip(x, y)] + [(1, 3, float(a), float(b)) for a, b in zip(x, skew)]
    got = {r["b"]: r for r in infill.symmetric_pairs(spark.createDataFrame(rows, "a int, b int, va double, vb double")).collect()}
    assert got[2]["symmetric"] and not got[3]["symmetric"]
    u, v = np.array(ranks(x)) / 301, np.array(ranks(y)) / 301
    assert (got[2]["a1"], got[2]["a2"]) == pytest.approx((((u + v - 1) ** 3).mean(), ((u - v) ** 3).mean()))


def test_symmetry_of_many_pairs_in_a_task(spark):
    """Pairs are rows of batches, not groups; one with a single value, or one value alone, has no correlation."""
    rows = [(1, 2, 1.0, 2.0), (1, 3, 1.0, 5.0), (1, 3, 1.0, 5.0)] + [(1, 4, float(i), float(i * i % 7)) for i in range(20)]
    made = infill.symmetric_pairs(spark.createDataFrame(rows, "a int, b int, va double, vb double"))
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got = {r["b"]: r for r in made.collect()}
    assert {b: r["n"] for b, r in got.items()} == {2: 1, 3: 2, 4: 20}
    assert got[2]["rho"] is None and got[3]["rho"] is None and not got[2]["symmetric"] and got[4]["low1"] < got[4]["high1"]


def test_rank_correlations_with_gaps(spark):
    rng = random.Random(6)
    rows = [(s, t, rng.choice([1.0, 2.0, 3.5, rng.random() * 9])) for s in range(9) for t in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "stn int, d int, value double")
    by = {}
    for s, t, v in rows:
        by.setdefault(s, {})[t] = v
    for ranked, made in ((False, series.correlations(df, "d", 4)), (True, series.rank_correlations(df, "d", 4))):
        got = {(r["a"], r["b"]): (r["rho"], r["n"]) for r in made.collect()}
        for a, b in itertools.combinations(range(9), 2):
            common = sorted(by[a].keys() & by[b].keys())
            x, y = [by[a][t] for t in common], [by[b][t] for t in common]
            if ranked:
                x, y = ranks(x), ranks(y)
            assert got[a, b] == (pytest.approx(pearson(x, y)), len(common))
    flat = spark.createDataFrame([(1, t, 5.0) for t in range(5)] + [(2, t, float(t)) for t in range(5)], "stn int, d int, value double")
    assert [(r["rho"], r["n"]) for r in series.correlations(flat, "d").collect()] == [(None, 5)]


@pytest.mark.parametrize("share", [0.7, 1.0])
def test_best_neighbours_of_blocks(spark, share):
    """Of many blocks, ties to the smaller id; a block is sent a bounded number of times, however many stations there are."""
    rng = random.Random(8)
    rows = [(s, t, float(rng.randrange(4))) for s in range(40) for t in range(12) if rng.random() < share]
    rows += [(s + 100, t, v) for s, t, v in rows if s < 10]
    df = spark.createDataFrame(rows, "stn int, d int, value double")
    rho = [r for r in series.rank_correlations(df, "d", 100).collect() if r["rho"] is not None and r["n"] > 5 and abs(r["rho"]) >= 0.2]
    want = {}
    for r in rho:
        for s, o in ((r["a"], r["b"]), (r["b"], r["a"])):
            want.setdefault(s, []).append((-math.floor(abs(r["rho"]) * 1e9 + 0.5), o))
    made = {}
    for r in series.correlated_neighbours(df, "d", 3, 0.2, 5, block=2).collect():
        made.setdefault(r["stn"], {})[r["place"]] = r["neighbour"]
    assert made == {s: {i + 1: o for i, (_, o) in enumerate(sorted(v)[:3])} for s, v in want.items()}
    blocks = series._blocks_met(df, "d", 1).select("i_", "j_").collect()
    assert len(blocks) <= series.BLOCKS * (series.BLOCKS + 1) // 2 and all(r["i_"] <= r["j_"] for r in blocks)


def test_counted_ranks_are_those_of_each_pair():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (30, 40)).astype(float), rng.integers(0, 6, (30, 50)).astype(float)
    mx, my = ((rng.random(v.shape) < 0.8).astype(float) for v in (x, y))
    mx[:, 3] = 0
    rho, n = series._counted_moments(x * mx, y * my, mx, my)
    for i, j in itertools.product(range(40), range(50)):
        common = (mx[:, i] * my[:, j]) > 0
        a, b = ranks(x[common, i].tolist()), ranks(y[common, j].tolist())
        flat = len(set(a)) < 2 or len(set(b)) < 2
        assert n[i, j] == common.sum() and (np.isnan(rho[i, j]) if flat else rho[i, j] == pytest.approx(pearson(a, b)))


def test_equal_masks_are_ranked_together(monkeypatch):
    """Stations whose masks alternate in a block meet by their masks, with the results of each pair by itself."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    masks = rng.random((9, 24)) > 0.2
    x = np.where(masks[np.arange(240) % 9].T, rng.integers(0, 6, (24, 240)), np.nan)
    names = list(range(240))
    batch = pa.RecordBatch.from_arrays([pa.array([v]) for v in (0, 1, names, list(range(24)), x.tobytes(), names, list(range(24)), x.tobytes())], list("ijabcdef"))
    calls, ranks = [], series.average_ranks
    monkeypatch.setattr(series, "PAIRS", 240 * 20)
    monkeypatch.setattr(series, "KINDS", 0)
    monkeypatch.setattr(series, "average_ranks", lambda m: calls.append(1) or ranks(m))
    rho, n = np.full((240, 240), np.inf), np.zeros((240, 240))
    for own, _, _, at, r, k in series._slices(batch, 0, series._ranked_moments):
        assert not own
        rho[at], n[at] = r, k
    assert len(calls) <= 9 * (12 + 9) + 9 * 9  # 2 * 9 * 9 * 12 at first; of the second block once for two masks
    for i, j in rng.integers(0, 240, (300, 2)):
        both = ~np.isnan(x[:, [i, j]]).any(1)
        p, q = ranks(x[both][:, [i, j]]).T
        assert n[i, j] == both.sum() and rho[i, j] == pytest.approx(np.corrcoef(p, q)[0, 1], nan_ok=True)
