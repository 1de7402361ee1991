"""Polygons: rows with an id and rings, array<array<struct<x, y>>>: closed or not, holes told by the even-odd rule.

Points, cells and polygons meet on tiles or on the numbers of cells that an envelope touches, which are
equality joins; what is exact follows on the pairs that met.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluvia.operators.fields import MOST_TASKS
from fluvia.operators.outlines import RINGS, union  # noqa: F401


def _next(ring: Column) -> Column:
    """The points of a ring moved by one: the last is followed by the first."""
    n = F.size(ring)
    return F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.least(n, F.lit(1))))


def ring_area(ring: Column) -> Column:
    """Signed area: positive where the ring runs against the clock."""
    cross = F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within: an odd number of edges crosses the ray to its right. Lower and left edges belong to a polygon."""

    def crossings(ring: Column) -> Column:
        crossed = F.zip_with(ring, _next(ring), lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
        return F.aggregate(crossed, F.lit(0), lambda a, v: a + v)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, v: a + v) % 2 == 1


def _is_hole(rings: Column, ring: Column, i: Column) -> Column:
    """Whether an odd number of the other rings holds the middle of a ring's first side."""
    p, q = ring[0], F.get(ring, F.lit(1))
    x, y = (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2
    around = F.transform(rings, lambda other, j: F.when((i != j) & contains(F.array(other), x, y), 1).otherwise(0))
    return F.aggregate(around, F.lit(0), lambda a, v: a + v) % 2 == 1


def area(rings: Column) -> Column:
    """Area of a polygon of any number of parts and holes, told by the even-odd rule: rings in an odd number of others are holes."""
    each = F.transform(rings, lambda r, i: F.when(F.size(r) < 3, 0.0).when(_is_hole(rings, r, i), -F.abs(ring_area(r))).otherwise(F.abs(ring_area(r))))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def extents(polygons: DataFrame) -> DataFrame:
    """polygons with x0, x1, y0, y1."""
    points = F.flatten("rings")
    axis = lambda c: F.transform(points, lambda p: p[c])
    return polygons.withColumns({"x0": F.array_min(axis("x")), "x1": F.array_max(axis("x")), "y0": F.array_min(axis("y")), "y1": F.array_max(axis("y"))})


def _tiles(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes exploded into the tiles that they touch, as i_ and j_."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return boxes.withColumn("i_", F.explode(span("x0", "x1"))).withColumn("j_", F.explode(span("y0", "y1")))


#: Points of a piece, sides and numbers of an array of both that are met at a time, and rows that come out at a time.
POINTS, SIDES, NUMBERS, ROWS = 2048, 384, 1 << 17, 1 << 16


def _sides(rings: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(first, x0, y0, x1, y1): the sides of the rings of polygons that have some, and where each polygon's begin."""
    count = lambda lists: lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ring = rings.flatten()
    n = count(ring)
    x, y = (ring.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    ends, after = np.cumsum(n), np.arange(1, len(x) + 1)
    after[ends[n > 0] - 1] = (ends - n)[n > 0]
    own = np.repeat(np.repeat(np.arange(len(rings)), count(rings)), n)
    return np.searchsorted(own, np.arange(len(rings))), x, y, x[after], y[after]


def _held(px: np.ndarray, py: np.ndarray, first: np.ndarray, x0, y0, x1, y1):
    """(point, polygon): numbers of points and of polygons that hold them, as contains() has it, some pairs at a time."""
    ends, low = np.r_[first[1:], len(x0)], 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(ends, first[low] + SIDES, "right")))
        part = slice(first[low], ends[high - 1])
        ax, ay, bx, by = (v[part, None] for v in (x0, y0, x1, y1))
        wide = max(1, NUMBERS // (ends[high - 1] - first[low]))
        for start in range(0, len(px), wide):
            x, y = px[start : start + wide], py[start : start + wide]
            at = y - ay
            at *= bx - ax
            with np.errstate(divide="ignore", invalid="ignore"):
                at /= by - ay
            at += ax
            crossed = ((ay > y) != (by > y)) & (x < at)
            polygon, point = np.nonzero(np.bitwise_xor.reduceat(crossed, first[low:high] - first[low], axis=0))
            yield point + start, polygon + low
        low = high


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float) -> DataFrame:
    """points (x, y, ...) with the zone of each polygon (zone, rings) that they lie in; tile: side of the tiles on which both meet.

    A tile's points come in pieces of some POINTS, and its polygons stream past each piece: a task holds a piece, however many
    polygons touch its tile, and tiles with many points are the work of as many tasks as they have pieces.
    """
    columns = points.columns
    near = points.withColumn("i_", F.floor(F.col("x") / tile)).withColumn("j_", F.floor(F.col("y") / tile)).where("i_ is not null and j_ is not null")
    pieces = near.groupBy("i_", "j_").agg(F.count(F.lit(1)).alias("m_")).withColumn("n_", F.ceil(F.col("m_") / POINTS))
    size = pieces.agg(F.sum("n_").alias("units"), F.sum("m_").alias("points")).first()
    dealt = near.join(pieces.hint("shuffle_hash"), ["i_", "j_"]).withColumn("k_", F.pmod(F.xxhash64(*columns), "n_"))
    shapes = _tiles(extents(polygons.select("zone", "rings")), tile).join(pieces.hint("shuffle_hash"), ["i_", "j_"]).withColumn("k_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)))
    keys = ["i_", "j_", "k_"]
    point = F.struct(*columns)
    first = dealt.select(*keys, F.lit(0).alias("o_"), F.col("x").cast("double").alias("px_"), F.col("y").cast("double").alias("py_"), point.alias("p_"))
    sent = shapes.select(*keys, F.lit(1).alias("o_"), "zone", F.col("rings").cast(RINGS).alias("rings"))
    # Rows are few beside their pairs, hence partitions of their own.
    n = min(size["units"] or 1, max(4 * points.sparkSession.sparkContext.defaultParallelism, (size["points"] or 0) // 256), MOST_TASKS)
    units = first.unionByName(sent, allowMissingColumns=True).repartition(n, *keys).sortWithinPartitions(*keys, "o_")

    def meet(batches):
        key, given, px, py = None, [], None, None
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            marks = np.stack([get(c).to_numpy() for c in (*keys, "o_")], 1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)][: len(marks)])
            for low, high in zip(starts, np.r_[starts[1:], len(marks)], strict=True):
                part = slice(low, high)
                if key != (key := tuple(marks[low, :3])):
                    given, px, py = [], np.zeros(0), np.zeros(0)
                take = lambda c: get(c)[part]  # noqa: B023, E731
                if not marks[low, 3]:
                    given.append(take("p_"))
                    px, py = (np.r_[v, take(c).to_numpy(zero_copy_only=False)] for v, c in ((px, "px_"), (py, "py_")))
                    continue
                if len(given) > 1:
                    given = [pa.concat_arrays(given)]
                zones, found, rows = take("zone"), [], 0
                for pair in _held(px, py, *_sides(take("rings"))) if given else ():
                    found.append(pair)
                    rows += len(pair[0])
                    if rows >= ROWS:
                        yield _joined(given[0], zones, found)
                        found, rows = [], 0
                if rows:
                    yield _joined(given[0], zones, found)

    def _joined(given, zones, found):
        who, where = (pa.array(np.concatenate(side)) for side in zip(*found, strict=True))
        held = given.take(who)
        return pa.RecordBatch.from_arrays([*(held.field(c) for c in range(len(columns))), zones.take(where)], [*columns, "zone"])

    return units.mapInArrow(meet, StructType([*points.schema.fields, polygons.schema["zone"]]))


def rasterise(polygons: DataFrame, size: float, touched: bool = False) -> DataFrame:
    """(r, c, zone): square cells, with corners at size * (c, r), whose centre lies in a polygon, or of which any part does."""
    if touched:
        return cell_weights(polygons, size).where("weight > 0").select("r", "c", "zone")
    cells = _tiles(extents(polygons), size).withColumnsRenamed({"i_": "c", "j_": "r"})
    return cells.where(contains(F.col("rings"), (F.col("c") + 0.5) * size, (F.col("r") + 0.5) * size)).select("r", "c", "zone")


def burn(cells: DataFrame, polygons: DataFrame, value: Column, size: float, touched: bool = False) -> DataFrame:
    """cells (r, c, value) with a polygon's value where one lies (of several, the largest zone's)."""
    marks = rasterise(polygons.select("zone", "rings"), size, touched).join(polygons.select("zone", value.alias("v_")), "zone")
    best = marks.groupBy("r", "c").agg(F.max_by("v_", "zone").alias("v_"), F.lit(True).alias("hit_"))
    return cells.join(best, ["r", "c"], "left").withColumn("value", F.when(F.col("hit_"), F.col("v_")).otherwise(F.col("value"))).drop("v_", "hit_")


def mask(cells: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """cells (r, c, value) without the values of those whose centre lies in no polygon."""
    inside = rasterise(polygons, size).select("r", "c").distinct().withColumn("in_", F.lit(True))
    return cells.join(inside, ["r", "c"], "left").withColumn("value", F.when(F.col("in_"), F.col("value"))).drop("in_")


def dissolve(polygons: DataFrame, grain: float = 1e-6) -> DataFrame:
    """(zone, rings, parts, outlines): the union of all polygons of an id (see outlines.union), of how many it is made, and how
    many parts it has. An id without any area has no row."""
    made = union(polygons, grain)
    return made.join(polygons.groupBy("zone").agg(F.count(F.lit(1)).alias("parts")), "zone").select("zone", "rings", "parts", "outlines")


def _area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points.T
    return 0.5 * float(x @ np.roll(y, -1) - y @ np.roll(x, -1))


def _holds(points: np.ndarray, x: float, y: float) -> bool:
    """Whether a ring holds a point, as contains() has it."""
    if len(points) < 3:
        return False
    after = np.roll(points, -1, 0)
    crossed = (points[:, 1] > y) != (after[:, 1] > y)
    with np.errstate(all="ignore"):
        at = (after[:, 0] - points[:, 0]) * (y - points[:, 1]) / (after[:, 1] - points[:, 1]) + points[:, 0]
    return bool((crossed & (x < at)).sum() % 2)


def _cut_lines(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (x0, y0, x1, y1) of sides from p to q, cut at all whole numbers of either axis, and the number of each piece's side."""
    side = [np.repeat(np.arange(len(p)), 2)]
    at = [np.tile([0.0, 1.0], len(p))]
    for k in (0, 1):
        low, high = np.minimum(p[:, k], q[:, k]), np.maximum(p[:, k], q[:, k])
        first = np.floor(low) + 1
        n = np.maximum(0, np.ceil(high) - first).astype(np.int64)
        own = np.repeat(np.arange(len(p)), n)
        line = first[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        side.append(own)
        at.append((line - p[own, k]) / (q[own, k] - p[own, k]))
    side, at = np.concatenate(side), np.concatenate(at)
    order = np.lexsort((at, side))
    side, at = side[order], at[order]
    points = p[side] + (q - p)[side] * at[:, None]
    same = side[1:] == side[:-1]
    return np.concatenate([points[:-1], points[1:]], 1)[same], side[:-1][same]


def covered_each(polygon: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Polygons, rows, columns and shares of the unit cells that each polygon covers, from its sides p to q; outlines run against the clock and
    holes with it.

    What a piece of boundary has to its right is summed along each row of cells: cells on the boundary get their own
    pieces' parts, and those between them what has added up.
    """
    pieces, side = _cut_lines(p, q)
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    c, r = np.floor(mid).astype(np.int64).T
    rise, own = pieces[:, 3] - pieces[:, 1], polygon[side]
    order = np.lexsort((c, r, own))
    keys = np.stack([own, r, c], 1)[order]
    new = np.r_[True, (keys[1:] != keys[:-1]).any(1)][: len(keys)]
    where = np.cumsum(new) - 1
    keys = keys[new]
    part, full = np.bincount(where, (rise * (1 - (mid[:, 0] - c)))[order]), np.bincount(where, rise[order])
    fresh = np.r_[True, (keys[1:, :2] != keys[:-1, :2]).any(1)][: len(keys)]
    total = np.cumsum(full)
    start = np.flatnonzero(fresh)
    base = np.repeat(total[start] - full[start], np.diff(np.r_[start, len(keys)]))
    after = total - base
    share = -(part + after - full)
    # Cells between two of a row's boundary cells.
    gap = np.where(np.r_[fresh[1:], True], 0, np.r_[keys[1:, 2], 0] - keys[:, 2] - 1)
    gap = np.where(np.abs(after) > 1e-12, gap, 0)
    own = np.repeat(np.arange(len(keys)), gap)
    between = keys[own, 2] + 1 + np.arange(gap.sum()) - np.repeat(np.cumsum(gap) - gap, gap)
    return np.r_[keys[:, 0], keys[own, 0]], np.r_[keys[:, 1], keys[own, 1]], np.r_[keys[:, 2], between], np.r_[share, -after[own]]


def covered(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and shares of the unit cells that one polygon covers; outlines run against the clock and holes with it."""
    p = np.concatenate(rings)
    return covered_each(np.zeros(len(p), np.int64), p, np.concatenate([np.roll(ring, -1, 0) for ring in rings]))[1:]


#: Sides and cells of the envelopes of polygons that are cut at a time.
CUT = 1 << 18


def _cut_single(rings: pa.ListArray, size: float):
    """(polygon, r, c, weight) of polygons of one ring each, many at a time."""
    first, x0, y0, x1, y1 = _sides(rings)
    n = np.diff(np.r_[first, len(x0)])
    own = np.repeat(np.arange(len(n)), n)
    # From a corner of its own, so that a polygon's place doesn't show in its area.
    ax, ay = np.repeat(x0[first], n), np.repeat(y0[first], n)
    whole = np.bincount(own, (x0 - ax) * (y1 - ay) - (x1 - ax) * (y0 - ay), len(n)) / 2
    p, q = np.stack([x0, y0], 1) / size, np.stack([x1, y1], 1) / size
    turn = (whole < 0)[own, None]
    p, q = np.where(turn, q, p), np.where(turn, p, q)
    spans = (np.maximum.reduceat(p, first) - np.minimum.reduceat(p, first) + 1).prod(1)
    place = np.cumsum(spans + n) // CUT
    for low, high in itertools.pairwise(np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(n)]):
        sides = np.flatnonzero((whole != 0)[own[first[low] : first[low] + n[low:high].sum()]]) + first[low]
        if len(sides):
            polygon, r, c, share = covered_each(own[sides], p[sides], q[sides])
            share = share * size * size / np.abs(whole)[polygon]
            some = share > 1e-12
            yield polygon[some], r[some], c[some], share[some]


def cell_weights(polygons: DataFrame, size: float) -> DataFrame:
    """(zone, r, c, weight): share of each polygon's area that lies in a square cell, exact for any simple rings.

    Rings in an odd number of others are holes and count against the rest. Polygons of one ring are cut many at a time,
    others each by itself, along the cells of their boundaries. Polygons without area have no row.
    """

    def cut(batches):
        for batch in batches:
            n = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            single = np.flatnonzero(n == 1)
            # Of those with one ring, rings of some points.
            points = batch.column(1).take(pa.array(single)).flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            single = single[points > 2]
            if len(single):
                for i, r, c, share in _cut_single(batch.column(1).take(pa.array(single)), size):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(single[i])), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(share)], ["zone", "r", "c", "weight"])
            for i in np.flatnonzero(n > 1).tolist():
                shapes = batch.column(1)[i]
                shapes = [np.stack([ring.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype(float) for ring in shapes if ring.is_valid] if shapes.is_valid else []
                shapes = [p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p for p in shapes]
                turned, whole = [], 0.0
                for k, p in enumerate(shapes):
                    a = _area(p)
                    if a:
                        hole = sum(_holds(q, *p[:2].mean(0)) for j, q in enumerate(shapes) if j != k) % 2 == 1
                        whole += -abs(a) if hole else abs(a)
                        turned.append((p if (a < 0) == hole else p[::-1]) / size)
                if whole <= 0:
                    continue
                r, c, share = covered(turned)
                share = share * size * size / whole
                some = share > 1e-12
                n = int(some.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), pa.array(r[some].astype(np.int32)), pa.array(c[some].astype(np.int32)), pa.array(share[some])], ["zone", "r", "c", "weight"])

    kind = dict(polygons.dtypes)["zone"]
    return polygons.select("zone", "rings").mapInArrow(cut, f"zone {kind}, r int, c int, weight double")


def to_wkt(rings: Column) -> Column:
    """Well-known text of a polygon, its rings closed."""
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    text = F.transform(rings, lambda ring: F.concat(F.lit("("), F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(text, ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Rings of a polygon's well-known text; null where it is none."""
    body = F.regexp_extract(text, r"(?i)^\s*POLYGON\s*\(\s*(\(.*\))\s*\)\s*$", 1)
    rings = F.split(F.regexp_replace(body, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\(")
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y"))
    return F.when(body != "", F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point)))
