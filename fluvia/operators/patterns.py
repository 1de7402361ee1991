"""Circulation patterns: fuzzy rules, degrees of fulfilment, selection and quality measures.

rules: (cp, pt, cls); a point that a pattern doesn't mention has no row. numbers: (cls, a, b, c), triangles.
Rules and numbers are a user's small settings; fields are joined with them on the point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anomaly(field: DataFrame) -> DataFrame:
    """field (t, pt, value) scaled to [0, 1] within each step; null where a step has one value only."""
    step = Window.partitionBy("t")
    low, high = F.min("value").over(step), F.max("value").over(step)
    return field.withColumn("value", F.try_divide(F.col("value") - low, high - low))


def triangle(v: Column, a: Column, b: Column, c: Column) -> Column:
    """Membership: 1 at b, 0 outside (a, c); sides may have no width."""
    up = F.when(v == b, 1.0).when((v > a) & (v < b), (v - a) / F.when(b > a, b - a))
    return up.when((v > b) & (v < c), (c - v) / F.when(c > b, c - b)).otherwise(0.0)


def memberships(scaled: DataFrame, rules: DataFrame, numbers: DataFrame) -> DataFrame:
    """(t, cp, pt, cls, mu) for every point that a pattern's rules mention."""
    mu = triangle(F.col("value"), F.col("a"), F.col("b"), F.col("c"))
    return scaled.join(rules, "pt").join(numbers, "cls").select("t", "cp", "pt", "cls", mu.alias("mu"))


def fulfilment(mu: DataFrame, classes: int, power: float) -> DataFrame:
    """(t, cp, dof): the product over classes of the power mean of memberships; 0 if a class isn't used."""
    p = F.lit(power)
    each = mu.groupBy("t", "cp", "cls").agg(F.pow(F.avg(F.pow("mu", p)), F.lit(1 / power)).alias("part"))
    product = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(1.0), lambda a, x: a * x)
    return each.groupBy("t", "cp").agg(F.when(F.count(F.lit(1)) == classes, product).otherwise(0.0).alias("dof"))


def select_pattern(dof: DataFrame, none: int) -> DataFrame:
    """(t, cp): the pattern with the largest degree above 1e-5 (ties: the first), else `none`."""
    best = F.max_by("cp", F.struct(F.round("dof", 12), -F.col("cp")))
    return dof.groupBy("t").agg(F.when(F.max("dof") > 1e-5, best).otherwise(none).alias("cp"))


def frequency(chosen: DataFrame) -> DataFrame:
    """(cp, n, share in per cent)."""
    counts = chosen.groupBy("cp").agg(F.count(F.lit(1)).alias("n"))
    total = chosen.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counts.join(F.broadcast(total), how="cross").select("cp", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("share"))


def composite(chosen: DataFrame, field: DataFrame) -> DataFrame:
    """(cp, pt, value): the mean field of each pattern."""
    return field.join(chosen, "t").groupBy("cp", "pt").agg(F.avg("value").alias("value"))


def conditional(chosen: DataFrame, rain: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, stn, cp, n, mean, overall, total, p0.., q0..): means and shares above thresholds within patterns and overall.

    Overall shares count values above a threshold, those of patterns values that reach it. by: more
    keys of chosen, such as a classification's number or a period.
    """
    v = F.col("value")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = rain.join(chosen, "t")
    inside = rows.groupBy(*by, "stn", "cp").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), *(share(v >= x).alias(f"p{i}") for i, x in enumerate(thresholds)))
    whole = rows.groupBy(*by, "stn").agg(F.count(F.lit(1)).alias("total"), F.avg(v).alias("overall"), *(share(v > x).alias(f"q{i}") for i, x in enumerate(thresholds)))
    return inside.join(whole, [*by, "stn"])


def wet_pair(w0: Column, w1: Column, floor: float = 0.0) -> Column:
    """Chance that one of two places alone is wet; below the floor: none."""
    both = w0 + w1 - 2 * w0 * w1
    return F.when(both < floor, 0.0).otherwise(both)


def wet_three(w0: Column, w1: Column, w2: Column) -> Column:
    """Sum of the wetness of three places and of each two of them against the third."""
    return w0 + w1 + w2 + (w0 + w1 - w2 + 1) + (w1 + w2 - w0 + 1) + (w0 + w2 - w1 + 1)


def wetness(rows: DataFrame) -> DataFrame:
    """Adds wet: a pattern's mean over the overall mean, at least 1e-100."""
    return rows.withColumn("wet", F.greatest(F.lit(1e-100), F.try_divide("mean", "overall")))


def quality(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, stn, i1, i2, i3, i4) from conditional() with two thresholds."""
    n, total = F.col("n"), F.first("total")
    i3, i4 = F.sum(F.abs(F.col("wet") - 1) * n) / total, F.sum(F.abs(F.ln("wet")) * n) / total
    return wetness(rows).groupBy(*by, "stn").agg(_spread(0).alias("i1"), _spread(1).alias("i2"), i3.alias("i3"), i4.alias("i4"))


def _spread(i: int) -> Column:
    """Root of the weighted squared difference of shares above threshold i."""
    return F.sqrt(F.sum(F.col("n") * F.pow(F.col(f"p{i}") - F.col(f"q{i}"), F.lit(2))) / F.first("total"))


def objectives(rows: DataFrame, thresholds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, shares, ratios, squares), each summed over the stations of conditional().

    shares: of values above thresholds (objective 1 of stations, 2 of catchments, 4 of neighbours' wetness);
    ratios: of means (3, 5, and 8 of cumulated shares); squares: of differences of means (6 and 7 of wetness).
    """
    n, total = F.col("n"), F.first("total")
    ratios = F.sum(n * F.abs(F.try_divide("mean", "overall") - 1)) / total
    squares = F.sum(n * F.pow(F.col("mean") - F.col("overall"), F.lit(2))) / total
    each = rows.groupBy(*by, "stn").agg(*(_spread(i).alias(f"s{i}") for i in range(thresholds)), ratios.alias("ratios"), squares.alias("squares"))
    shares = sum((F.sum(f"s{i}") for i in range(1, thresholds)), F.sum("s0")) if thresholds else F.lit(0.0)
    return each.groupBy(*by).agg(shares.alias("shares"), F.sum("ratios").alias("ratios"), F.sum("squares").alias("squares"))


def penalised(total: Column, counts: DataFrame, patterns: int, least: float, weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """counts (by, cp, n, and what total reads) with the objective less weight * (least - share) * total for
    each of the patterns, numbered from 0, whose share of steps lies below least; those without a step count too."""
    steps = F.sum("n").over(Window.partitionBy(*by))
    rare = counts.withColumn("share_", F.col("n") / steps).where(F.col("cp") < patterns)
    lack = F.sum(F.greatest(F.lit(0.0), least - F.col("share_"))) + (patterns - F.count_distinct("cp")) * least
    return rare.groupBy(*by).agg((F.first(total) * (1 - weight * lack)).alias("objective"))


def random_rules(patterns: int, points: int, classes: int, most: int, rng: np.random.Generator) -> np.ndarray:
    """Rules (patterns, points): for each class of a pattern up to most points; the rest are of no class (the number of classes)."""
    rules = np.full((patterns, points), classes)
    for row in rules:
        free, at = rng.permutation(points), 0
        for k in range(classes):
            n = min(int(rng.random() * (most + 1)), points - at)
            row[free[at : at + n]] = k
            at += n
    return rules


class Chain:
    """A classification under change: degrees of fulfilment, chosen patterns and the objective, kept up step by step.

    scaled: (steps, points); rain: (steps, stations); a change of one rule touches the sums of one pattern, and
    the objective's sums at the steps whose pattern changes.
    """

    def __init__(self, scaled, rain, triangles, rules, thresholds, power, weights, least, penalty):
        a, b, c = (triangles[:, i, None, None] for i in range(3))
        v = scaled[None]
        with np.errstate(all="ignore"):
            up, down = np.where(b > a, (v - a) / (b - a), 0.0), np.where(c > b, (c - v) / (c - b), 0.0)
        mu = np.where(v == b, 1.0, np.where((v > a) & (v < b), up, np.where((v > b) & (v < c), down, 0.0)))
        self.mu, self.power, self.rules = mu**power, power, rules.copy()
        self.classes, self.cps, self.steps = len(triangles), len(rules), len(scaled)
        self.weights, self.least, self.penalty = weights, least, penalty
        self.what = np.concatenate([np.ones((self.steps, 1)), rain, *((rain >= x) for x in thresholds)], 1)
        self.stations, self.thresholds = rain.shape[1], len(thresholds)
        self.mean, self.above = rain.mean(0), np.stack([(rain > x).mean(0) for x in thresholds])
        self.sums = np.zeros((self.cps, self.classes, self.steps))
        self.count = np.zeros((self.cps, self.classes), int)
        for cp in range(self.cps):
            for k in range(self.classes):
                at = self.rules[cp] == k
                self.sums[cp, k], self.count[cp, k] = self.mu[k][:, at].sum(1), at.sum()
        self.dof = np.stack([self._degrees(cp) for cp in range(self.cps)])
        self.chosen = self._choose()
        self.totals = np.zeros((self.cps + 1, self.what.shape[1]))
        np.add.at(self.totals, self.chosen, self.what)

    def _degrees(self, cp: int) -> np.ndarray:
        if not self.count[cp].all():
            return np.zeros(self.steps)
        return (np.maximum(self.sums[cp], 0.0) / self.count[cp][:, None]).prod(0) ** (1 / self.power)

    def _choose(self) -> np.ndarray:
        best = np.round(self.dof, 12)
        return np.where(best.max(0) > 1e-5, best.argmax(0), self.cps)

    def change(self, cp: int, pt: int, new: int) -> None:
        """Give a point of a pattern another class; changing it back undoes it."""
        old = int(self.rules[cp, pt])
        for k, sign in ((old, -1), (new, 1)):
            if k < self.classes:
                self.sums[cp, k] += sign * self.mu[k][:, pt]
                self.count[cp, k] += sign
        self.rules[cp, pt] = new
        self.dof[cp] = self._degrees(cp)
        chosen = self._choose()
        moved = np.flatnonzero(chosen != self.chosen)
        np.subtract.at(self.totals, self.chosen[moved], self.what[moved])
        np.add.at(self.totals, chosen[moved], self.what[moved])
        self.chosen = chosen

    def objective(self) -> float:
        """Weighted sum of shares, ratios and squares (see objectives), less a penalty for rare patterns."""
        n = self.totals[:, :1]
        some = n[:, 0] > 0
        part, n = self.totals[some, 1:] / n[some], n[some]
        s = self.stations
        means, shares = part[:, :s], part[:, s:].reshape(len(part), self.thresholds, s)
        o_shares = np.sqrt((n[..., None] * (shares - self.above) ** 2).sum(0) / self.steps).sum()
        with np.errstate(all="ignore"):
            o_ratios = np.nansum(n * np.abs(means / self.mean - 1)) / self.steps
        o_squares = (n * (means - self.mean) ** 2).sum() / self.steps
        total = float(self.weights[0] * o_shares + self.weights[1] * o_ratios + self.weights[2] * o_squares)
        lack = np.maximum(0.0, self.least - self.totals[: self.cps, 0] / self.steps).sum()
        return total * (1 - self.penalty * float(lack))


def _warmth(chain: Chain, rng, most: int, wanted: float) -> float:
    """A temperature at which the wanted share of random changes would be accepted, by bisection."""
    losses, now = [], chain.objective()
    for _ in range(60):
        cp, pt, new = _random_change(chain, rng, most)
        old = int(chain.rules[cp, pt])
        chain.change(cp, pt, new)
        losses.append(max(0.0, now - chain.objective()))
        chain.change(cp, pt, old)
    low, high = 1e-9, max(1e-6, 100 * max(losses))
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if np.exp(-np.array(losses) / middle).mean() < wanted else (low, middle)
    return high


def _random_change(chain: Chain, rng, most: int) -> tuple[int, int, int]:
    """A pattern, a point and another class for it that has room (or none)."""
    while True:
        cp, pt, new = int(rng.integers(chain.cps)), int(rng.integers(chain.rules.shape[1])), int(rng.integers(chain.classes + 1))
        if new != chain.rules[cp, pt] and (new == chain.classes or chain.count[cp, new] < most):
            return cp, pt, new


def anneal(
    scaled: DataFrame,
    rain: DataFrame,
    numbers: list[tuple[int, float, float, float]],
    patterns: int,
    thresholds: list[float],
    most: int = 4,
    chains: int = 4,
    iterations: int = 2000,
    per_temperature: int = 100,
    cooling: float = 0.95,
    idle: int = 800,
    accepted: float = 0.6,
    power: float = 2.0,
    weights: tuple[float, float, float] = (1.0, 1.0, 0.0),
    least: float = 0.02,
    penalty: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """(chain, objective, start, cp, pt, cls): rules found by simulated annealing that make the objective large.

    scaled: t, pt, value; rain: t, stn, value; steps that lack a point or a station are left out. Chains run apart,
    a task each, seeded by their number; a chain holds the fields and rain in memory. A step gives one point of one
    pattern another class; it stays if the objective rises, or by chance exp(change / temperature), else it is
    undone. Rules without a class aren't listed.
    """
    triangles = np.array([n[1:] for n in sorted(numbers)], float)
    rows = scaled.select(F.lit(0).alias("side"), "t", F.col("pt").cast("long").alias("k"), F.col("value").cast("double").alias("value"))
    rows = rows.union(rain.select(F.lit(1), "t", F.col("stn").cast("long"), F.col("value").cast("double"))).where("value is not null")
    many = rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = (frame[frame["side"] == i].pivot(index="t", columns="k", values="value").sort_index() for i in (0, 1))
        x = x.dropna()
        y = y.loc[:, y.notna().all()] if y.notna().all().any() else y.dropna(axis=1, thresh=1).fillna(0.0)
        both = x.index.intersection(y.index)
        x, y = x.loc[both], y.loc[both]
        rng = np.random.default_rng([seed, int(key[0])])
        chain = Chain(x.to_numpy(), y.to_numpy(), triangles, random_rules(patterns, x.shape[1], len(triangles), most, rng), thresholds, power, weights, least, penalty)
        start = now = best = chain.objective()
        rules, heat, still = chain.rules.copy(), _warmth(chain, rng, most, accepted), 0
        for i in range(iterations):
            cp, pt, new = _random_change(chain, rng, most)
            old = int(chain.rules[cp, pt])
            chain.change(cp, pt, new)
            value = chain.objective()
            if value > now or rng.random() < np.exp((value - now) / heat):
                now = value
            else:
                chain.change(cp, pt, old)
            still += 1
            if now > best:
                best, rules, still = now, chain.rules.copy(), 0
            if (i + 1) % per_temperature == 0:
                heat *= cooling
            if still >= idle:
                break
        cp, pt = np.nonzero(rules < len(triangles))
        return pd.DataFrame({"chain": int(key[0]), "objective": best, "start": start, "cp": cp, "pt": x.columns.to_numpy()[pt], "cls": rules[cp, pt]})

    return many.groupBy("chain").applyInPandas(run, "chain int, objective double, start double, cp int, pt long, cls int")
