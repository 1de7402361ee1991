"""Everyday selections, clamps, merges and set operations on long tables (stn, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_stations(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of obs whose station has coordinates."""
    return obs.join(stations.select("stn").distinct(), "stn", "left_semi")


def drop_stations(obs: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Rows of obs whose station isn't in unwanted (stn)."""
    return obs.join(unwanted.select("stn").distinct(), "stn", "left_anti")


def time_slice(obs: DataFrame, time: str, first, last) -> DataFrame:
    """Rows from first to last, both included; the filter reaches the scan."""
    return obs.where(F.col(time).between(F.lit(first), F.lit(last)))


def interval(obs: DataFrame, time: str, kind: str, dates: list | None = None) -> DataFrame:
    """Rows of an interval: 'slice' (from the first to the last of dates), 'indiv' (those dates alone) or 'all'."""
    if kind == "all":
        return obs
    if not dates:
        raise ValueError(f"an interval of type {kind!r} needs dates")
    if kind == "slice":
        return time_slice(obs, time, min(dates), max(dates))
    if kind == "indiv":
        return obs.where(F.col(time).isin(list(dates)))
    raise ValueError(f"unknown interval type {kind!r}")


def drop_empty(panel: DataFrame, time: str) -> DataFrame:
    """Rows of a panel, its absent values null, without times and stations that have no value at all."""
    some = lambda key: F.count("value").over(Window.partitionBy(key)) > 0
    return panel.withColumn("t_", some(time)).withColumn("s_", some("stn")).where("t_ and s_").drop("t_", "s_")


def complete_rows(obs: DataFrame, chosen: list, time: str) -> DataFrame:
    """Rows of the chosen stations at the times at which each of them has a value."""
    rows = obs.where(F.col("stn").isin(chosen) & F.col("value").isNotNull())
    full = rows.groupBy(time).agg(F.count_distinct("stn").alias("n_")).where(F.col("n_") == len(set(chosen))).select(time)
    return rows.join(full, time, "left_semi")


def bounding_box(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points within a box, its edges included."""
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def below_to_null(value: Column, limit: float = 0.0) -> Column:
    return F.when(value >= limit, value)


def below_to_zero(value: Column, limit: float = 0.1) -> Column:
    return F.when(value < limit, 0.0).otherwise(value)


def clamp_interpolated(value: Column, limit: float = 0.1, digits: int = 2) -> Column:
    """Interpolated precipitation: zero below the limit, else rounded."""
    return F.when(value < limit, 0.0).otherwise(F.round(value, digits))


def clamp_field(field: DataFrame, inputs: DataFrame, time: str, low: float | str | None, high: float | str | None) -> DataFrame:
    """field with values of each time held between low and high: numbers, 'min_in' or 'max_in' (of inputs at that time), or None."""
    value, bounds = F.col("value"), inputs.groupBy(time).agg(F.min("value").alias("min_in"), F.max("value").alias("max_in"))
    edge = lambda b: F.col(b) if isinstance(b, str) else F.lit(b)
    out = field.join(bounds, time, "left") if "min_in" == low or "max_in" == high else field
    if low is not None:
        value = F.when(value < edge(low), edge(low)).otherwise(value)
    if high is not None:
        value = F.when(value > edge(high), edge(high)).otherwise(value)
    return out.withColumn("value", value).drop("min_in", "max_in")


def fill_constant(panel: DataFrame, constant: float = 1e-6) -> DataFrame:
    return panel.withColumn("value", F.coalesce("value", F.lit(constant)))


def observed_or_infilled(observed: DataFrame, infilled: DataFrame, time: str) -> DataFrame:
    """Observed values, and infilled ones where there is none; infilled: whether it is of the latter."""
    both = observed.select("stn", time, F.col("value").alias("o_")).join(infilled.select("stn", time, F.col("value").alias("i_")), ["stn", time], "full")
    return both.select("stn", time, F.coalesce("o_", "i_").alias("value"), (F.col("o_").isNull() & F.col("i_").isNotNull()).alias("infilled"))


def in_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose keys have a value in each of the tables, with values v0, v1, ...: a full join without its nulls."""
    made = None
    for i, t in enumerate(tables):
        part = t.where("value is not null").select(*keys, F.col("value").alias(f"v{i}"))
        made = part if made is None else made.join(part, keys)
    return made


def station_union(tables: list[DataFrame], time: str) -> DataFrame:
    """(time, stns): the stations that any of the tables has at a time, in order."""
    rows = None
    for t in tables:
        part = t.where("value is not null").select(time, "stn")
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(time).agg(F.array_sort(F.collect_set("stn")).alias("stns"))


def with_model(obs: DataFrame, models: DataFrame, time: str) -> DataFrame:
    """obs with the model of its time; times without one have null. Models have a row a time."""
    return obs.join(models.select(time, "model"), time, "left")


def update(base: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """base with values of parts where these have one, and rows that only parts has."""
    return base.select(*keys, F.col("value").alias("b_")).join(parts.select(*keys, F.col("value").alias("p_")), keys, "full").select(*keys, F.coalesce("p_", "b_").alias("value"))


def set_operations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right): the union of both tables' keys; intersection and differences are filters on it."""
    a, b = left.select(key).distinct().withColumn("l_", F.lit(True)), right.select(key).distinct().withColumn("r_", F.lit(True))
    return a.join(b, key, "full").select(key, F.coalesce("l_", F.lit(False)).alias("in_left"), F.coalesce("r_", F.lit(False)).alias("in_right"))


def first_n(rows: DataFrame, n: int, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of each group in an order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def combinations(items: Column, most: int = 2000) -> Column:
    """Non-empty subsets of an array of at most some dozen items, the largest first, then in the order of
    the items; at most `most` of each size, as the search that uses them tries no more."""
    n = F.size(items)
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), n) - 1).cast("long"))
    bit = lambda m, i: F.getbit(m, i)
    made = F.transform(masks, lambda m: F.filter(items, lambda x, i: bit(m, i) == 1))
    sized = F.transform(made, lambda c: F.struct((-F.size(c)).alias("k"), c.alias("c")))
    ordered = F.array_sort(sized)
    ranked = F.transform(F.sequence(n, F.lit(1)), lambda k: F.slice(F.filter(ordered, lambda s: s["k"] == -k), 1, most))
    return F.transform(F.flatten(ranked), lambda s: s["c"])


def permutations(items: Column, size: int) -> Column:
    """All ordered choices of `size` different items of a short array, as arrays, in the order of the items."""
    made = F.transform(items, lambda x: F.array(x))
    for _ in range(size - 1):
        made = F.flatten(F.transform(made, lambda p: F.transform(F.filter(items, lambda x: ~F.array_contains(p, x)), lambda x: F.concat(p, F.array(x)))))  # noqa: B023
    return made


def differences(obs: DataFrame, time: str) -> DataFrame:
    """obs with the difference to the station's value before and whether it doesn't fall."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("stn").orderBy(time))
    return obs.withColumn("step", step).withColumn("rises", F.col("step") >= 0)


def monotonic(obs: DataFrame, time: str) -> DataFrame:
    """(stn, rising): whether a station's values never fall."""
    return differences(obs, time).groupBy("stn").agg(F.coalesce(F.bool_and("rises"), F.lit(True)).alias("rising"))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation in the points of two arrays (xs rising); beyond their ends the end's value."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda v: v <= x))
    i = F.greatest(F.lit(1), F.least(below, n - 1))
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, i + 1), F.element_at(ys, i), F.element_at(ys, i + 1)
    inside = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
    return F.when(n == 1, F.element_at(ys, 1)).when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inside)


def availability(panel: DataFrame, time: str) -> DataFrame:
    """Counts of each time: stations with a value, without one, with one out of those that ever have one by then, and all."""
    so_far = F.min(F.when(F.col("value").isNotNull(), F.col(time))).over(Window.partitionBy("stn"))
    rows = panel.withColumn("known_", F.coalesce(so_far <= F.col(time), F.lit(False)))
    has = F.col("value").isNotNull()
    return rows.groupBy(time).agg(F.count_if(has).alias("present"), F.count_if(~has).alias("missing"), F.count_if(F.col("known_")).alias("started"), F.count(F.lit(1)).alias("stations"))
