"""Rules, chains and annealing against a classification made anew."""

import numpy as np
import pytest

from fluvia import adapt
from fluvia.operators import patterns
from fluvia.plans import patterns as plans

TRIANGLES = np.array([n[1:] for n in plans.NUMBERS])


def made(seed=0, steps=40, points=12, cps=4):
    rng = np.random.default_rng(seed)
    rules = patterns.random_rules(cps, points, 4, 3, rng)
    return rng, rng.random((steps, points)), rng.gamma(1, 10, (steps, 3)), rules


def test_random_rules_have_room():
    for seed in range(20):
        rules = patterns.random_rules(5, 9, 4, 3, np.random.default_rng(seed))
        assert rules.min() >= 0 and rules.max() <= 4 and all((row == k).sum() <= 3 for row in rules for k in range(4))


def test_changes_keep_up_with_a_new_start():
    rng, x, y, rules = made()
    args = ([5.0, 12.0], 2.0, (1.0, 0.5, 0.1), 0.1, 2.0)
    chain = patterns.Chain(x, y, TRIANGLES, rules, *args)
    for _ in range(60):
        cp, pt, new = patterns._random_change(chain, rng, 3)
        old, before = int(chain.rules[cp, pt]), (chain.objective(), chain.chosen.copy())
        chain.change(cp, pt, new)
        fresh = patterns.Chain(x, y, TRIANGLES, chain.rules, *args)
        assert np.array_equal(chain.chosen, fresh.chosen) and chain.objective() == pytest.approx(fresh.objective())
        if rng.random() < 0.5:
            chain.change(cp, pt, old)
            assert chain.objective() == pytest.approx(before[0]) and np.array_equal(chain.chosen, before[1])


def test_a_chain_classifies_as_the_relational_operators(spark):
    _, x, y, rules = made(3)
    field = spark.createDataFrame([(t, p, float(x[t, p])) for t in range(len(x)) for p in range(x.shape[1])], "t int, pt int, value double")
    given = spark.createDataFrame([(c, p, int(rules[c, p])) for c in range(len(rules)) for p in range(x.shape[1]) if rules[c, p] < 4], "cp int, pt int, cls int")
    numbers = spark.createDataFrame(plans.NUMBERS, "cls int, a double, b double, c double")
    sel = patterns.select_pattern(patterns.fulfilment(patterns.memberships(field, given, numbers), 4, 2), len(rules))
    chain = patterns.Chain(x, y, TRIANGLES, rules, [5.0, 12.0], 2.0, (1.0, 1.0, 1.0), 0.0, 0.0)
    want = {r["t"]: r["cp"] for r in sel.collect()}
    assert want == {t: int(c) for t, c in enumerate(chain.chosen)}
    rain = spark.createDataFrame([(t, s, float(y[t, s])) for t in range(len(y)) for s in range(3)], "t int, stn int, value double")
    o = patterns.objectives(patterns.conditional(sel, rain, [5.0, 12.0]), 2).first()
    assert chain.objective() == pytest.approx(o["shares"] + o["ratios"] + o["squares"])


def test_annealing_improves_and_is_seeded(spark, sf_dir):
    field = plans.scaled(spark, sf_dir)
    rain = adapt.series(spark, sf_dir).withColumnRenamed("d", "t")
    run = lambda: patterns.anneal(field, rain, plans.NUMBERS, 5, [40.0], chains=2, iterations=400)
    rows = run().collect()
    assert {r["chain"] for r in rows} == {0, 1}
    assert all(r["objective"] >= r["start"] for r in rows) and any(r["objective"] > r["start"] for r in rows)
    key = lambda r: tuple(r)
    assert sorted(map(key, rows)) == sorted(map(key, run().collect()))
    count = {}
    for r in rows:
        k = r["chain"], r["cp"], r["cls"]
        count[k] = count.get(k, 0) + 1
    assert max(count.values()) <= 4


def test_penalty_counts_absent_patterns(spark):
    counts = spark.createDataFrame([(0, 90, 10.0), (1, 10, 10.0)], "cp int, n int, total double")
    got = patterns.penalised(counts["total"], counts, 3, 0.2, 0.5).first()["objective"]
    assert got == pytest.approx(10 * (1 - 0.5 * (0.1 + 0.2)))
