"""Empirical copulas of paired probabilities (u, v) by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize


def density(pairs: DataFrame, by: str, bins: int) -> DataFrame:
    """(by, i, j, density) for all bins * bins cells; u = 1 belongs to the last bin."""
    place = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    counts = pairs.groupBy(by, place("u").alias("i"), place("v").alias("j")).agg(F.count(F.lit(1)).alias("k"))
    axis = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(by, "n", F.explode(axis).alias("i")).select("*", F.explode(axis).alias("j"))
    return grid.join(counts, [by, "i", "j"], "left").select(by, "i", "j", (F.coalesce("k", F.lit(0)) * float(bins * bins) / F.col("n")).alias("density"))


def cumulative(grid: DataFrame, by: str, bins: int) -> DataFrame:
    """grid with cum, the copula at each cell's upper corner: two running sums."""
    rows = F.sum("density").over(Window.partitionBy(by, "i").orderBy("j")) / float(bins * bins)
    inner = grid.withColumn("along", rows)
    return inner.withColumn("cum", F.sum("along").over(Window.partitionBy(by, "j").orderBy("i"))).drop("along")


def rho_tau(grid: DataFrame, by: str, bins: int) -> DataFrame:
    """(by, rho, tau): Spearman's and Kendall's measures of a gridded copula."""
    du2 = 1.0 / (bins * bins)
    c = cumulative(grid, by, bins).withColumn("uv", (F.col("i") + 1) * (F.col("j") + 1) / float(bins * bins))
    return c.groupBy(by).agg((12 * F.sum(F.col("cum") - F.col("uv")) * du2).alias("rho"), (4 * F.sum(F.col("cum") * F.col("density")) * du2 - 1).alias("tau"))


def asymmetry_of_sample() -> tuple[Column, Column]:
    """Aggregates mean((u + v - 1)^3) and mean((u - v)^3)."""
    u, v, three = F.col("u"), F.col("v"), F.lit(3)
    return F.avg(F.pow(u + v - 1, three)), F.avg(F.pow(u - v, three))


def asymmetry_of_grid(bins: int) -> tuple[Column, Column]:
    """The same over a gridded density, at the middles of its cells."""
    u, v, three = (F.col("i") + 0.5) / bins, (F.col("j") + 0.5) / bins, F.lit(3)
    du2 = 1.0 / (bins * bins)
    return F.sum(F.col("density") * F.pow(u + v - 1, three)) * du2, F.sum(F.col("density") * F.pow(u - v, three)) * du2


def _inversions(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j]: those within halves, and those across by a search in the sorted left half."""
    if len(v) <= 64:
        return int(np.triu(v[:, None] > v, 1).sum())
    left, right = np.array_split(v, 2)
    across = len(left) * len(right) - int(np.searchsorted(np.sort(left), right, "right").sum())
    return _inversions(left) + _inversions(right) + across


#: Rows of a part of a long group.
PART = 100_000


def kendall_tau_b(pairs: DataFrame, by: str, part_rows: int = PART) -> DataFrame:
    """(by, tau_b) from the concordance of all pairs of rows (u, v) in a group; ties count in neither direction.

    Rows are dealt into ranges of (by, u, v), written out. Discordant pairs are counted within each range by halves, and
    for a group of several ranges between each two of them, as a task's work; ties are counted by grouping. A
    task holds two ranges, however long a group; NaN and null rows are left out.
    """
    rows = pairs.select(by, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    rows = rows.where("u is not null and v is not null and not isnan(u) and not isnan(v)")
    kind = dict(pairs.dtypes)[by]
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows))
    dealt = materialize(rows.repartitionByRange(parts, by, "u", "v").withColumn("part", F.spark_partition_id()), "ranges")
    # Values in the order of u and v: one row a group and range, in which it stands by itself.
    ranges = dealt.groupBy(by, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "v"))), lambda p: p["v"]).alias("vs"))

    def within(batches):
        for batch in batches:
            vs = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_inversions(vs[i].values.to_numpy()) for i in range(batch.num_rows)], pa.int64())], [by, "n"])

    def between(batches):
        for batch in batches:
            out = [len(a := batch.column(1)[i].values) * len(b := batch.column(2)[i].values) - int(np.searchsorted(np.sort(a.to_numpy()), b.to_numpy(), "right").sum()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], [by, "n"])

    several = dealt.select(by, "part").distinct().groupBy(by).agg(F.collect_list("part").alias("own")).where(F.size("own") > 1)
    held = ranges.join(several, by)
    # Each range meets the later ones of its group in a place of two ranges.
    left = held.select(by, F.col("part").alias("i"), F.col("vs").alias("a"), F.explode(F.filter("own", lambda q: q > F.col("part"))).alias("j"))
    right = held.select(by, F.col("part").alias("j"), F.col("vs").alias("b"), F.explode(F.filter("own", lambda q: q < F.col("part"))).alias("i"))
    met = left.join(right, [by, "i", "j"]).select(by, "a", "b")
    discordant = ranges.select(by, "vs").mapInArrow(within, f"{by} {kind}, n long").union(met.mapInArrow(between, f"{by} {kind}, n long"))
    discordant = discordant.groupBy(by).agg(F.sum("n").alias("discordant"))

    def tied(*columns: str) -> DataFrame:
        n = dealt.groupBy(by, *columns).agg(F.count(F.lit(1)).alias("k"))
        return n.groupBy(by).agg((F.sum(F.col("k") * (F.col("k") - 1)) / 2).alias("_".join(("t", *columns))))

    every = dealt.groupBy(by).agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("total"))
    for t in (tied("u"), tied("v"), tied("u", "v"), discordant):
        every = every.join(t, by)
    c = F.col
    below = F.sqrt((c("total") - c("t_u")) * (c("total") - c("t_v")))
    return every.select(by, F.try_divide(c("total") - c("t_u") - c("t_v") + c("t_u_v") - 2 * c("discordant"), F.nullif(below, F.lit(0.0))).alias("tau_b"))
