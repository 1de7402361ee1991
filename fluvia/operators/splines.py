"""Spline zooming of rasters: orders 2 to 5, on tiles with halos.

A spline's coefficients come from a recursion along rows and columns, forward and back. It forgets what lies k cells
away like the k-th power of a number below a half, so that a tile with HALO cells around it has the coefficients of
the whole raster to the last digits, and nothing has to pass a whole row through one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side, and around it: 0.4306 to the 48th power is below 1e-17.
TILE, HALO = 256, 52

#: Poles of the recursions by order.
POLES = {
    2: (math.sqrt(8) - 3,),
    3: (math.sqrt(3) - 2,),
    4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19),
    5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5),
}


def coefficients(values: np.ndarray, order: int) -> np.ndarray:
    """Of the spline through values along the first axis, mirrored at both ends."""
    n = len(values)
    if n < 2:
        return values.copy()
    out = values.astype(float)
    for z in POLES[order]:
        out *= (1 - z) * (1 - 1 / z)
    for z in POLES[order]:
        # The sum over the mirrored past, which ends where it no longer counts.
        powers = z ** np.arange(n)
        out[0] = (out[0] + z ** (n - 1) * out[-1] + np.tensordot(powers[1 : n - 1] + z ** (2 * n - 2) / powers[1 : n - 1], out[1 : n - 1], 1)) / (1 - z ** (2 * n - 2)) if n < 100 else np.tensordot(powers[:100], out[:100], 1)
        for i in range(1, n):
            out[i] += z * out[i - 1]
        out[-1] = z / (z * z - 1) * (z * out[-2] + out[-1])
        for i in range(n - 2, -1, -1):
            out[i] = z * (out[i + 1] - out[i])
    return out


def basis(x: np.ndarray, order: int) -> np.ndarray:
    """The centred spline of an order at distances x."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for k in range(order + 2):
        out += (-1) ** k * math.comb(order + 1, k) * np.maximum(0.0, x + (order + 1) / 2 - k) ** order
    return out / math.factorial(order)


def weights(at: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place its order + 1 coefficients' numbers, mirrored into 0..n-1, and their weights."""
    first = np.floor(at).astype(np.int64) - order // 2 if order % 2 else np.floor(at + 0.5).astype(np.int64) - order // 2
    near = first[:, None] + np.arange(order + 1)
    w = basis(at[:, None] - near, order)
    if n == 1:
        return np.zeros_like(near), w
    near = np.abs(near) % (2 * n - 2)
    return np.where(near >= n, 2 * n - 2 - near, near), w


def spline_zoom(cells: DataFrame, rows: int, cols: int, factor: float, order: int = 3, low: float | None = None, high: float | None = None) -> DataFrame:
    """(r, c, value) on a grid of round(rows * factor) by round(cols * factor): the spline of the order through the cells' values.

    The outer cells' centres stay where they are: cell i of n stands at i * (rows - 1) / (n - 1). Values beyond low or
    high, by default the least and largest of the input, become null, as splines overshoot. A cell without a
    value counts as the mean of the others for the spline, and what lies next to it (its order + 1 cells along
    either axis) is null. Orders 2 to 5. A task holds a tile and its halo.
    """
    if order not in POLES:
        raise ValueError("orders 2 to 5")
    high_rows, high_cols = max(1, round(rows * factor)), max(1, round(cols * factor))
    known = cells.where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols) & F.col("value").isNotNull()).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("value").cast("double").alias("value"))
    facts = known.agg(F.avg("value").alias("m"), F.min("value").alias("a"), F.max("value").alias("b")).first()
    if facts["m"] is None:
        return known
    mean, low, high = facts["m"], facts["a"] if low is None else low, facts["b"] if high is None else high
    tile, halo = TILE, HALO
    span = lambda k, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(k) - halo) / tile)), F.least(F.lit((n - 1) // tile), F.floor((F.col(k) + halo) / tile)))
    dealt = known.withColumn("i", F.explode(span("r", rows))).withColumn("j", F.explode(span("c", cols)))

    def places(k: int, n: int, fine: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the fine cells that stand in a tile, and where."""
        at = np.arange(fine) * ((n - 1) / (fine - 1)) if fine > 1 else np.zeros(1)
        own = np.flatnonzero(np.minimum(np.floor(at / tile), (n - 1) // tile) == k)
        return own, at[own]

    def fill(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        (r0, r1), (c0, c1) = ((max(0, k * tile - halo), min(n, (k + 1) * tile + halo + 1)) for k, n in ((i, rows), (j, cols)))
        block, gone = np.full((r1 - r0, c1 - c0), mean), np.ones((r1 - r0, c1 - c0), bool)
        r, c = (table.column(k).to_numpy() for k in ("r", "c"))
        inside = (r >= r0) & (r < r1) & (c >= c0) & (c < c1)
        block[r[inside] - r0, c[inside] - c0] = table.column("value").to_numpy()[inside]
        gone[r[inside] - r0, c[inside] - c0] = False
        (fine_r, at_r), (fine_c, at_c) = places(i, rows, high_rows), places(j, cols, high_cols)
        made, lost = coefficients(coefficients(block, order).T, order).T, gone.astype(float)
        for axis, (at, n, start) in enumerate(((at_r, rows, r0), (at_c, cols, c0))):
            near, w = weights(at, order, n)
            near = near - start
            made = np.einsum("pk,pk...->p...", w, made[near]) if axis == 0 else np.einsum("pk,qpk->qp", w, made[:, near])
            used = np.abs(w) > 0
            lost = np.einsum("pk,pk...->p...", used, lost[near]) if axis == 0 else np.einsum("pk,qpk->qp", used, lost[:, near])
        values = made.ravel()
        bad = (lost.ravel() > 0) | (values < low) | (values > high)
        return pa.table({"r": pa.array(np.repeat(fine_r, len(fine_c)).astype(np.int32)), "c": pa.array(np.tile(fine_c, len(fine_r)).astype(np.int32)), "value": pa.array(values, mask=bad)})

    return dealt.groupBy("i", "j").applyInArrow(fill, "r int, c int, value double")
