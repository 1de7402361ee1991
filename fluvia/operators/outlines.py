"""Unions of polygons and outlines of patches, by edges.

Coordinates are put on a lattice of whole numbers, so that equal points are equal. Edges of one zone meet on
tiles, but for those tiles that a single polygon covers, within which no boundary runs. They are cut where they cross
or touch, and equal pieces become one; a piece stays if exactly one of its sides lies within some polygon of the
zone: on a covered tile, or with an odd number of pieces of a polygon of its tile to its right in that row of tiles. All
of that is joins and aggregates. What is left is walked, a zone a task, into closed rings with the inside on their
left: outlines run against the clock, holes with it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.operators.fields import spread, whole_groups
from fluvia.session import materialize

RINGS = "array<array<struct<x:double,y:double>>>"


def _turn(back: tuple[int, int], way: tuple[int, int]) -> float:
    """Angle from the way back to a way on, against the clock: the largest is the sharpest turn to the left."""
    a = math.atan2(back[0] * way[1] - back[1] * way[0], back[0] * way[0] + back[1] * way[1])
    return a if a > 0 else a + 2 * math.pi


def walk(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings from directed edges (x0, y0, x1, y1), corners only; where rings touch, each keeps to its own inside.

    Edges that lead nowhere are left out. Rings start at their smallest corner and are sorted by it.
    """
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sorted(edges):
        ways.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(ways):
        while ways.get(start):
            ring, here = [start], ways[start].pop(0)
            while here != start:
                out = ways.get(here)
                if not out:
                    break
                back = (ring[-1][0] - here[0], ring[-1][1] - here[1])
                # The inside is on the left: of several ways on, the one that turns most to the left.
                nxt = max(out, key=lambda p: _turn(back, (p[0] - here[0], p[1] - here[1]))) if len(out) > 1 else out[0]
                out.remove(nxt)
                ring.append(here)
                here = nxt
            else:
                n = len(ring)
                bent = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - p[0])]
                if len(bent) > 2:
                    least = bent.index(min(bent))
                    rings.append(bent[least:] + bent[:least])
    return sorted(rings)


def assemble(edges: DataFrame, key: str, grain: float = 1.0) -> DataFrame:
    """(key, rings, outlines): rings walked from directed edges (key, x0, y0, x1, y1) on the lattice, times grain; outlines: those
    that aren't holes. Collinear corners go. The edges of a key fit in a task, as their rings have to fit in a row."""

    def run(batches):
        for batch, starts in whole_groups(batches):
            corners = np.stack([batch.column(c).to_numpy() for c in range(1, 5)], 1)
            points, rings, shapes, outlines = [], [0], [0], []
            for low, high in itertools.pairwise(starts):
                made = walk(list(map(tuple, corners[low:high].tolist())))
                for ring in made:
                    points += ring
                    rings.append(len(points))
                shapes.append(len(rings) - 1)
                outlines.append(sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) > 0 for r in made))
            at = np.array(points, np.int64).reshape(-1, 2) * grain
            flat = pa.StructArray.from_arrays([pa.array(at[:, 0].astype(float)), pa.array(at[:, 1].astype(float))], ["x", "y"])
            nested = pa.ListArray.from_arrays(pa.array(shapes, pa.int32()), pa.ListArray.from_arrays(pa.array(rings, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts[:-1])), nested, pa.array(outlines, pa.int32())], [key, "rings", "outlines"])

    rows = spread(edges.select(key, *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1"))), key)
    return rows.mapInArrow(run, f"{key} {dict(edges.dtypes)[key]}, rings {RINGS}, outlines int")


def _lattice_edges(polygons: DataFrame, grain: float) -> DataFrame:
    """(e, part, zone, x0, y0, x1, y1): the edges of all rings on the lattice, numbered; part tells polygons apart."""
    rows = polygons.select("zone", "rings").withColumn("part", F.monotonically_increasing_id())
    rings = rows.select("zone", "part", F.explode("rings").alias("ring"))
    on = F.transform("ring", lambda p: F.struct(F.round(p["x"] / grain).cast("long").alias("x"), F.round(p["y"] / grain).cast("long").alias("y")))
    rings = rings.select("zone", "part", on.alias("r")).where(F.size("r") > 2)
    after = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", 1, 1))
    sides = rings.select("zone", "part", F.explode(F.arrays_zip(F.col("r").alias("a"), after.alias("b"))).alias("s"))
    sides = sides.select("zone", "part", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))
    return materialize(sides.where("x0 <> x1 or y0 <> y1").withColumn("e", F.monotonically_increasing_id()), "edges")


#: Lattice units around a tile whose edges count as the tile's: rounding moves pieces by less.
NEAR = 2
#: Edges that a task deals to tiles at a time.
PART_EDGES = 65536


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n[i] items for each i, and the items' numbers."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def touched(x0, y0, x1, y1, tile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, i, j): the tiles, in columns i and rows j, within NEAR of each edge k."""
    low, high = np.minimum(x0, x1), np.maximum(x0, x1)
    first = np.floor((low - NEAR) / tile).astype(np.int64)
    k, step = _repeat(np.floor((high + NEAR) / tile).astype(np.int64) - first + 1)
    i = first[k] + step
    a, b = np.maximum(low[k], i * tile - NEAR), np.minimum(high[k], (i + 1) * tile + NEAR)
    with np.errstate(all="ignore"):
        slope = np.where(x1 != x0, (y1 - y0) / (x1 - x0), 0.0)[k]
    ya, yb = (np.where(x0[k] == x1[k], y, y0[k] + (x - x0[k]) * slope) for x, y in ((a, y0[k]), (b, y1[k])))
    row = np.floor((np.minimum(ya, yb) - NEAR) / tile).astype(np.int64)
    m, step = _repeat(np.floor((np.maximum(ya, yb) + NEAR) / tile).astype(np.int64) - row + 1)
    return k[m], i[m], row[m] + step


def covered_runs(part, x0, y0, x1, y1, met, tile: float) -> tuple[np.ndarray, ...]:
    """(part, j, i0, i1): runs of tiles i0 to i1 - 1 of row j that lie within a polygon, away from all of its edges.

    met: what touched() gave for the edges. Between two touched tiles of a row all is within or without, as
    the number of edges tells that cross the row's middle to the left.
    """
    k, i, j = met
    empty = (np.zeros(0, np.int64),) * 4
    if not len(k):
        return empty
    tiles = np.unique(np.stack([part[k], j, i], 1), axis=0)
    same = (tiles[1:, 0] == tiles[:-1, 0]) & (tiles[1:, 1] == tiles[:-1, 1])
    row = np.r_[0, np.cumsum(~same)]
    gap = np.flatnonzero(same & (tiles[1:, 2] - tiles[:-1, 2] > 1))
    if not len(gap):
        return empty
    # Edges across the middle of each row, by row and place.
    _, heads = np.unique(row, return_index=True)
    names = np.unique(np.stack([part[k], j], 1), axis=0, return_inverse=True)[1].ravel()
    once = np.unique(np.stack([names, k], 1), axis=0)
    own, e = once.T
    mid = (tiles[heads, 1][own] + 0.5) * tile
    across = (y0[e] > mid) != (y1[e] > mid)
    own, e, mid = own[across], e[across], mid[across]
    at = x0[e] + (mid - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    place = (tiles[gap, 2] + 1.5) * tile
    # Of crossings and gaps sorted together, the crossings of its row before each gap.
    rows, kind = np.r_[own, row[gap]], np.r_[np.zeros(len(own), int), np.ones(len(gap), int)]
    order = np.lexsort((kind, np.r_[at, place], rows))
    before = np.cumsum(kind[order] == 0)
    count = np.empty(len(order), np.int64)
    count[order] = before
    left = count[len(own) :] - np.searchsorted(own, row[gap])
    g = gap[left % 2 == 1]
    return tiles[g, 0], tiles[g, 1], tiles[g, 2] + 1, tiles[g + 1, 2]


def _dyadic(low: np.ndarray, high: np.ndarray):
    """Runs of whole numbers low to high - 1 as blocks of 2**level with numbers n: (level, run, n)."""
    low, high, level = low.copy(), high.copy(), 0
    while (low < high).any():
        for end, step in ((low, 1), (high, -1)):
            odd = np.flatnonzero((low < high) & (end % 2 == 1))
            yield level, odd, end[odd] - (step < 0)
            end[odd] += step
        low, high, level = low // 2, high // 2, level + 1


def _deal(edges: DataFrame, tile: float) -> DataFrame:
    """(zone, part, e, x0, y0, x1, y1, i, j, level): edges on the tiles that they touch, level 0; and, without an edge, the blocks of 2**level tiles of
    a row that a polygon covers."""
    kind = dict(edges.dtypes)["zone"]
    shapes = edges.groupBy("zone", "part").agg(F.collect_list(F.struct("e", "x0", "y0", "x1", "y1")).alias("sides"))
    names = ["zone", "part", "e", "x0", "y0", "x1", "y1", "i", "j", "level"]

    def work(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("sides"))
            ends = np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64)
            flat, start = column.flatten(), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PART_EDGES, "right")) - 1)
                piece = flat.slice(ends[start], ends[stop] - ends[start])
                e, *corners = (piece.field(n).to_numpy(zero_copy_only=False) for n in range(5))
                x0, y0, x1, y1 = (c.astype(float) for c in corners)
                own = np.repeat(np.arange(start, stop), np.diff(ends[start : stop + 1]))
                met = touched(x0, y0, x1, y1, tile)
                take = lambda rows, c: batch.column(c).take(pa.array(rows))  # noqa: B023, E731
                k, i, j = met
                yield pa.RecordBatch.from_arrays([take(own[k], 0), take(own[k], 1), *(pa.array(c[k]) for c in (e, *corners)), pa.array(i), pa.array(j), pa.array(np.zeros(len(k), np.int32))], names)
                part, rows, low, high = covered_runs(own, x0, y0, x1, y1, met, tile)
                for level, run, n in _dyadic(low, high):
                    none = pa.nulls(len(run), pa.int64())
                    yield pa.RecordBatch.from_arrays([take(part[run], 0), take(part[run], 1), *[none] * 5, pa.array(n), pa.array(rows[run]), pa.array(np.full(len(run), level, np.int32))], names)
                start = stop

    made = shapes.mapInArrow(work, f"zone {kind}, part long, e long, x0 long, y0 long, x1 long, y1 long, i long, j long, level int")
    return materialize(made, "tiles")


def _open(dealt: DataFrame) -> DataFrame:
    """(zone, i, j): tiles with edges that no polygon covers by itself."""
    full = dealt.where("e is null").select("zone", "j", "level", F.col("i").alias("n")).distinct()
    levels = [r["level"] for r in full.select("level").distinct().collect()]
    tiles = dealt.where("e is not null").select("zone", "i", "j").distinct()
    if not levels:
        return tiles
    above = tiles.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("n", F.expr("shiftright(i, level)"))
    return tiles.join(above.join(full, ["zone", "j", "level", "n"]).select("zone", "i", "j"), ["zone", "i", "j"], "left_anti")


def _cut(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges cut where others of their zone cross or touch them on the tiles where both are placed: (zone, part, x0, y0, x1, y1)."""
    other = placed.select("zone", "i", "j", *(F.col(c).alias(f"{c}_") for c in ("e", "x0", "y0", "x1", "y1")))
    met = placed.join(other, ["zone", "i", "j"]).where("e <> e_")
    meets = lambda a: (F.least(f"{a}0", f"{a}1") - 1 <= F.greatest(f"{a}0_", f"{a}1_")) & (F.greatest(f"{a}0", f"{a}1") + 1 >= F.least(f"{a}0_", f"{a}1_"))
    met = met.where(meets("x") & meets("y")).drop("i", "j").distinct()
    c = {k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1", "x0_", "y0_", "x1_", "y1_")}
    rx, ry, sx, sy = c["x1"] - c["x0"], c["y1"] - c["y0"], c["x1_"] - c["x0_"], c["y1_"] - c["y0_"]
    length = F.sqrt(rx * rx + ry * ry)

    def touching(x, y):
        """The other edge's end, where it stands within a step of this edge and between its ends."""
        along, off = (c[x] - c["x0"]) * rx + (c[y] - c["y0"]) * ry, (c[x] - c["x0"]) * ry - (c[y] - c["y0"]) * rx
        return F.when((along > 0) & (along < length * length) & (F.abs(off) <= length), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))

    # Both edges of a crossing take the point from the one with the smaller number, so that it is the same.
    first = F.col("e") < F.col("e_")
    ax, ay, vx, vy = (F.when(first, a).otherwise(b) for a, b in ((c["x0"], c["x0_"]), (c["y0"], c["y0_"]), (rx, sx), (ry, sy)))
    bx, by, wx, wy = (F.when(first, b).otherwise(a) for a, b in ((c["x0"], c["x0_"]), (c["y0"], c["y0_"]), (rx, sx), (ry, sy)))
    d = F.nullif(vx * wy - vy * wx, F.lit(0.0))
    t, u = ((bx - ax) * wy - (by - ay) * wx) / d, ((bx - ax) * vy - (by - ay) * vx) / d
    crossing = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct(F.round(ax + t * vx).cast("long").alias("x"), F.round(ay + t * vy).cast("long").alias("y")))
    points = met.select("e", F.explode(F.filter(F.array(crossing, touching("x0_", "y0_"), touching("x1_", "y1_")), lambda p: p.isNotNull())).alias("p"))
    cuts = points.groupBy("e").agg(F.collect_set("p").alias("cuts"))
    own = edges.join(cuts, "e", "left")
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    every = F.concat(F.array(end("x0", "y0"), end("x1", "y1")), F.coalesce("cuts", F.array().cast("array<struct<x:bigint,y:bigint>>")))
    far = lambda p: (p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))
    line = F.array_sort(F.transform(every, lambda p: F.struct(far(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    pieces = own.select("zone", "part", line.alias("l")).select("zone", "part", F.explode(F.arrays_zip(F.col("l").alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))).alias("s"))
    flat = pieces.where("s.b is not null").select("zone", "part", *(F.col(f"s.{p}.{k}").alias(f"{k}{n}") for p, n in (("a", 0), ("b", 1)) for k in ("x", "y")))
    return flat.where("x0 <> x1 or y0 <> y1")


def _boundary(pieces: DataFrame, placed: DataFrame, tiles: DataFrame, tile: float) -> DataFrame:
    """Pieces with exactly one side within a polygon of their zone, directed with it on the left."""
    low = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    turned = pieces.select("zone", "part", *(F.when(low, F.col(f"{k}{a}")).otherwise(F.col(f"{k}{1 - a}")).alias(f"{k}{a}") for a in (0, 1) for k in ("x", "y")))
    # Of a polygon's own pieces, those that lie on each other an even number of times have the same on both sides.
    turned = materialize(turned.groupBy("zone", "part", "x0", "y0", "x1", "y1").count().where("count % 2 = 1").drop("count"), "pieces")
    named = materialize(turned.select("zone", "x0", "y0", "x1", "y1").distinct().withColumn("s", F.monotonically_increasing_id()), "sides")
    # Points just beside the middle of a piece: on its left, and on its right.
    dx, dy = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    step = 1e-3 / F.sqrt(dx * dx + dy * dy)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    sides = named.select("zone", "s", (mx - dy * step).alias("lx"), (my + dx * step).alias("ly"), (mx + dy * step).alias("rx"), (my - dx * step).alias("ry"))
    points = sides.select("zone", "s", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("lx").alias("px"), F.col("ly").alias("py")), F.struct(F.lit(False).alias("left"), F.col("rx").alias("px"), F.col("ry").alias("py")))).alias("p")).select("zone", "s", "p.*")
    points = points.withColumns({"i": F.floor(F.col("px") / tile), "j": F.floor(F.col("py") / tile)})
    points = points.join(tiles.withColumn("open", F.lit(True)), ["zone", "i", "j"], "left")
    # A polygon that holds a point of an open tile has an edge there.
    asked = points.where("open").join(placed.select("zone", "i", "j", "part").distinct(), ["zone", "i", "j"]).select("s", "left", "px", "py", "part", "j")
    strips = turned.where("y0 <> y1").withColumn("j", F.explode(F.sequence(F.floor(F.least("y0", "y1") / tile), F.floor(F.greatest("y0", "y1") / tile))))
    across = (F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))
    beyond = F.col("px") < F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    hit = asked.join(strips.drop("zone"), ["part", "j"]).where(across & beyond).groupBy("s", "left", "part").count().where("count % 2 = 1")
    within = hit.select("s", "left").union(points.where("open is null").select("s", "left")).groupBy("s").agg(F.bool_or("left").alias("l"), F.bool_or(~F.col("left")).alias("r"))
    kept = named.join(within, "s").where("l <> r")
    return kept.select("zone", *(F.when(F.col("l"), F.col(f"{k}{a}")).otherwise(F.col(f"{k}{1 - a}")).alias(f"{k}{a}") for a in (0, 1) for k in ("x", "y")))


def union(polygons: DataFrame, grain: float = 1e-6) -> DataFrame:
    """(zone, rings, outlines): the union of all polygons (zone, rings; even-odd) of a zone.

    Disjoint parts are outlines of their own, counted; what no polygon covers within is a hole. Coordinates are rounded
    to multiples of grain, and ends within one of another edge become points of it. Polygons without area go; a
    zone without any has no row.
    """
    edges = _lattice_edges(polygons, grain)
    longer = lambda a, b: F.greatest(a("x1") - b("x0"), a("y1") - b("y0"))
    edge = edges.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0]
    shape = edges.groupBy("part").agg(longer(F.max, F.min).alias("s")).agg(F.avg("s")).first()[0]
    # Small beside an edge, so that polygons cover tiles; a polygon of many edges has some 16 by 16.
    tile = max(64.0, (edge or 0.0) / 8, (shape or 0.0) / 16)
    dealt = _deal(edges, tile)
    tiles = materialize(_open(dealt), "open")
    placed = dealt.where("e is not null").drop("level").join(tiles, ["zone", "i", "j"], "left_semi")
    return assemble(_boundary(_cut(edges, placed), placed, tiles, tile), "zone", grain)


def patch_edges(patches: DataFrame) -> DataFrame:
    """(patch, x0, y0, x1, y1): outlines of patches of cells (r, c, patch), x along columns and y along rows, straight runs in one, the
    patch on their left."""
    inside = patches.select("r", "c", "patch")
    # Directed sides of a cell with the cell on the left, y growing with r: to the right along its first row's edge, and so on.
    sides = ((0, 0, 1, 0, -1, 0), (1, 0, 1, 1, 0, 1), (1, 1, 0, 1, 1, 0), (0, 1, 0, 0, 0, -1))
    each = inside.withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("a", "b", "d", "e", "i", "j"), s, strict=True))) for s in sides))))
    each = each.select("patch", (F.col("c") + F.col("s.a")).alias("x0"), (F.col("r") + F.col("s.b")).alias("y0"), (F.col("c") + F.col("s.d")).alias("x1"), (F.col("r") + F.col("s.e")).alias("y1"), (F.col("r") + F.col("s.i")).alias("nr"), (F.col("c") + F.col("s.j")).alias("nc"))
    across = inside.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("patch").alias("other"))
    edge = each.join(across, ["nr", "nc"], "left").where("other is null or other <> patch").select("patch", "x0", "y0", "x1", "y1")
    # Runs: sides of one patch and line and direction that follow each other, unless another of the patch turns off between.
    flat = F.col("y0") == F.col("y1")
    line, at = F.when(flat, F.col("y0")).otherwise(F.col("x0")), F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1"))
    way = F.when(flat, F.signum(F.col("x1") - F.col("x0"))).otherwise(2 * F.signum(F.col("y1") - F.col("y0"))).cast("int")
    lined = edge.withColumns({"line": line, "at": at, "way": way})
    corners = lined.select("patch", F.col("x0").alias("x"), F.col("y0").alias("y")).groupBy("patch", "x", "y").count().where("count > 1")
    start = F.when(F.col("way") > 0, F.struct("x0", "y0")).otherwise(F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0")))
    lined = lined.withColumn("p", start).join(corners.select("patch", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0")).alias("p"), F.lit(1).alias("knot")), ["patch", "p"], "left")
    order = Window.partitionBy("patch", "way", "line").orderBy("at")
    fresh = F.when((F.col("at") - F.lag("at").over(order) == 1) & F.col("knot").isNull(), 0).otherwise(1)
    runs = lined.withColumn("new", fresh).withColumn("run", F.sum("new").over(order)).groupBy("patch", "way", "line", "run")
    ends = runs.agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    a, b = F.when(F.col("way") > 0, F.col("low")).otherwise(F.col("high")), F.when(F.col("way") > 0, F.col("high")).otherwise(F.col("low"))
    along = F.abs("way") == 1
    pick = lambda v: (F.when(along, v).otherwise(F.col("line")), F.when(along, F.col("line")).otherwise(v))
    (x0, y0), (x1, y1) = pick(a), pick(b)
    return ends.select("patch", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
