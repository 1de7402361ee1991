"""Raster algebra on cells (r, c, value); a missing value is null or has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.operators.outlines import assemble, patch_edges


def set_null(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Values outside [low, high] become null."""
    return cells.withColumn("value", F.when(F.col("value").between(low, high), F.col("value")))


def mask_snapped(cells: DataFrame, x0: float, y0: float, size: float, other: DataFrame, other_x0: float, other_y0: float, other_size: float) -> DataFrame:
    """Values stay where the other raster, of its own corner and cell size, has a value in the cell that a cell's centre snaps to."""
    at = lambda k, start, begin: F.floor(((F.col(k) + 0.5) * size + start - begin) / other_size).cast("int")
    placed = cells.withColumn("i_", at("r", y0, other_y0)).withColumn("j_", at("c", x0, other_x0))
    shape = other.where("value is not null").select(F.col("r").alias("i_"), F.col("c").alias("j_"), F.lit(True).alias("in_"))
    return placed.join(shape, ["i_", "j_"], "left").withColumn("value", F.when(F.col("in_"), F.col("value"))).drop("i_", "j_", "in_")


def clip(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells within the given rows and columns, both ends included."""
    return cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def mask(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Values stay where the other raster, aligned with this one, has a value."""
    shape = other.where("value is not null").select("r", "c", F.lit(True).alias("inside"))
    return cells.join(shape, ["r", "c"], "left").withColumn("value", F.when(F.col("inside"), F.col("value"))).drop("inside")


def mosaic(rasters: DataFrame, mode: str) -> DataFrame:
    """One value per cell of stacked rasters (order, r, c, value): 'first', 'last', 'min', 'max' or 'average'."""
    v, o = F.col("value"), F.col("order")
    how = {"first": F.min_by(v, o), "last": F.max_by(v, o), "min": F.min(v), "max": F.max(v), "average": F.avg(v)}
    return rasters.where("value is not null").groupBy("r", "c").agg(how[mode].alias("value"))


def resample(cells: DataFrame, factor: int, how: str = "average") -> DataFrame:
    """Cells of factor times the size: mean, most frequent (ties: smallest) or upper left value."""
    coarse = lambda k: F.floor(F.col(k) / factor).cast("int").alias(k)
    v = F.col("value")
    made = {"average": F.avg(v), "mode": F.mode(v, True), "near": F.min_by(v, F.struct("r", "c"))}
    return cells.groupBy(coarse("r"), coarse("c")).agg(made[how].alias("value"))


def properties(cells: DataFrame) -> DataFrame:
    """One row: extent, numbers of rows, columns and values, least and largest value."""
    size = lambda k: (F.max(k) - F.min(k) + 1)
    return cells.agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"), size("c").alias("cols"), size("r").alias("rows"), F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def nearest_index(at: Column, first: float, size: float, low: int, high: int) -> Column:
    """Index of the nearest of evenly spaced centres (that of index 0 at first), from low to high; ties to the smaller."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.ceil((at - first) / size - 0.5).cast("int")))


def to_ndv(cells: DataFrame, ndv: float) -> DataFrame:
    """Missing values written as a no-data value."""
    return cells.withColumn("value", F.coalesce(F.col("value"), F.lit(ndv)))


def from_ndv(cells: DataFrame, *ndv: float) -> DataFrame:
    """Any of the given no-data values, and NaN, read as missing."""
    return cells.withColumn("value", F.when(~F.col("value").isin(*ndv) & ~F.isnan(F.col("value").cast("double")), F.col("value")))


def change_ndv(cells: DataFrame, old: float, new: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("value") == old, F.lit(new)).otherwise(F.col("value")))


#: Names of cell types in rasters and the Spark types that hold them, with their bytes.
TYPES = {"byte": ("short", 1), "uint16": ("int", 2), "int16": ("short", 2), "uint32": ("long", 4), "int32": ("int", 4), "float32": ("float", 4), "float64": ("double", 8)}
#: The least and largest number of the types of whole numbers.
BOUNDS = {"byte": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647)}


def change_type(cells: DataFrame, kind: str, ndv: float | None = None) -> DataFrame:
    """Values as another cell type; whole numbers cut fractions, and what doesn't fit becomes missing (or ndv)."""
    v = F.col("value")
    if kind in BOUNDS:
        low, high = BOUNDS[kind]
        whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
        v = F.when(whole.between(low, high), whole)
    v = v if ndv is None else F.coalesce(v, F.lit(ndv))
    return cells.withColumn("value", v.cast(TYPES[kind][0]))


def same_grid(rasters: DataFrame, digits: int = 6) -> DataFrame:
    """One row: whether all rasters (raster, x0, y0, size, crs) agree in extent and cell size, and in their reference system."""
    place = F.struct(*(F.round(c, digits) for c in ("x0", "y0", "x1", "y1", "size")))
    return rasters.agg((F.count_distinct(place) == 1).alias("same_extents"), (F.count_distinct("crs") == 1).alias("same_crs"))


def flip(cells: DataFrame, rows: int) -> DataFrame:
    """cells with rows counted from the other end."""
    return cells.withColumn("r", F.lit(rows - 1) - F.col("r"))


def falls(axis: DataFrame, place: str, at: str) -> DataFrame:
    """One row: whether coordinates fall along an axis (place: their number from 0), so that the field has to be flipped."""
    return axis.agg((F.max_by(at, place) < F.min_by(at, place)).alias("flipped"))


def corner(at: Column, size: float) -> Column:
    """Lower corner of a cell from its centre."""
    return at - size / 2


def window(cells: DataFrame, first: Column, last: Column, size: float, start: float, key: str) -> DataFrame:
    """Cells whose number along an axis lies between those of two coordinates, truncated: an index slice."""
    number = lambda at: F.floor((at - start) / size)
    return cells.where(F.col(key).between(number(first), number(last)))


def sample(cells: DataFrame, points: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """points (x, y, ...) with the value of the cell in which each lies; null outside or where it is missing."""
    number = lambda c, start: F.floor((F.col(c) - start) / size).cast("int")
    placed = points.withColumn("c", number("x", x0)).withColumn("r", number("y", y0))
    return placed.join(cells.select("r", "c", "value"), ["r", "c"], "left").drop("r", "c")


def nearest_of_curved(points: DataFrame, cells: DataFrame, reach: float | None = None) -> DataFrame:
    """(stn, r, c, dist): the nearest centre (r, c, x, y) of a grid whose rows and columns are curved; ties to the smaller r, then c.

    Both meet on tiles of side reach; points with nobody within reach have no row. Without a reach every point has
    one: those that find nobody look again twice as far, from the mean spacing of the centres around them on.
    """
    from fluvia.operators.spatial import tiled_pairs
    from fluvia.session import materialize

    left = points.select("stn", F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = cells.select("r", "c", F.col("x").alias("bx"), F.col("y").alias("by"))
    best = F.min(F.struct("dist", "r", "c"))
    find = lambda some, far: tiled_pairs(some, right, far).groupBy("stn").agg(best.alias("b")).select("stn", "b.r", "b.c", "b.dist")
    if reach is not None:
        return find(left, reach)
    box = right.agg(F.count(F.lit(1)).alias("n"), F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1")).first()
    if not box["n"]:
        return find(left.limit(0), 1.0)
    now = max(2 * ((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) / box["n"]) ** 0.5, 1e-9 * max(1.0, abs(box["x1"]), abs(box["y1"])))
    # Where points fill but a part of the grid, the spacing there: tiles that suit the whole would hold too many of them.
    part = left.agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1")).first()
    if part["x0"] is not None:
        near = right.where(F.col("bx").between(part["x0"], part["x1"]) & F.col("by").between(part["y0"], part["y1"])).count()
        spacing = ((part["x1"] - part["x0"]) * (part["y1"] - part["y0"]) / near) ** 0.5 if near else 0.0
        now = min(now, max(spacing, now / 1024)) if spacing > 0 else now
    found = None
    while True:
        made = materialize(find(left, now), "nearest-cells")
        found = made if found is None else found.union(made)
        left = materialize(left.join(made, "stn", "left_anti"), "far-points")
        if not left.limit(1).count():
            return found
        now *= 2


def bilinear(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (.., fr, fc: places in units of cells, whole numbers at centres) with the value between the four centres
    around each; null where one of those that count has none. Also spline zooming of order 1."""
    corners = targets.withColumn("k_", F.monotonically_increasing_id())
    corners = corners.withColumn("r0_", F.floor("fr")).withColumn("c0_", F.floor("fc"))
    four = corners.withColumn("o_", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    weight = (F.when(F.col("o_.i") == 0, F.col("r0_") + 1 - F.col("fr")).otherwise(F.col("fr") - F.col("r0_"))) * (F.when(F.col("o_.j") == 0, F.col("c0_") + 1 - F.col("fc")).otherwise(F.col("fc") - F.col("c0_")))
    four = four.withColumn("w_", weight).where("w_ > 0").withColumn("r", (F.col("r0_") + F.col("o_.i")).cast("int")).withColumn("c", (F.col("c0_") + F.col("o_.j")).cast("int"))
    met = four.join(cells.select("r", "c", "value"), ["r", "c"], "left")
    each = met.groupBy("k_", *targets.columns).agg(F.sum(F.col("value") * F.col("w_")).alias("v_"), F.count_if(F.col("value").isNull()).alias("n_"))
    return each.select(*targets.columns, F.when(F.col("n_") == 0, F.col("v_")).alias("value"))


def zoom(cells: DataFrame, rows: int, cols: int, factor: int, order: int = 1) -> DataFrame:
    """(r, c, value) on a grid factor times as fine: of order 0 (the nearest cell) or 1 (linear between centres).

    Values outside the range of the input would become missing; orders 0 and 1 make none. Beyond the outer
    centres the edge's value holds.
    """
    place = lambda k, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(k) + 0.5) / factor - 0.5))
    fine = cells.sparkSession.range(rows * factor).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols * factor - 1))).alias("c"))
    if order == 0:
        coarse = fine.select("r", "c", F.floor(F.col("r") / factor).cast("int").alias("i"), F.floor(F.col("c") / factor).cast("int").alias("j"))
        return coarse.join(cells.select(F.col("r").alias("i"), F.col("c").alias("j"), "value"), ["i", "j"], "left").select("r", "c", "value")
    if order != 1:
        raise ValueError("orders 0 and 1; for 2 to 5 see splines.spline_zoom")
    made = bilinear(cells, fine.select(F.col("r").alias("i"), F.col("c").alias("j"), place("r", rows).alias("fr"), place("c", cols).alias("fc")))
    return made.select(F.col("i").alias("r"), F.col("j").alias("c"), "value")


def reproject(cells: DataFrame, targets: DataFrame, back, x0: float, y0: float, size: float, method: str = "nearest", width: float | None = None, steps: int = 4) -> DataFrame:
    """targets (r, c, x, y of centres in the new system) with values of cells (corners at x0 + size * c) at back(x, y), the point in the
    old system.

    nearest: of the cell in which the point lies. bilinear: between the four centres around it; null where one that
    counts has no value. average: of all cells by the share of the target cell, of the given width, that lies in each; its
    footprint is cut out in the old system, with so many steps a side. Null outside, and where no cell has a value.
    """
    if method == "average":
        from fluvia.operators.fields import spread
        from fluvia.operators.polygons import cell_weights

        if width is None:
            raise ValueError("an average needs the width of the target cells")
        around = [(k / steps - 0.5, -0.5) for k in range(steps)] + [(0.5, k / steps - 0.5) for k in range(steps)] + [(0.5 - k / steps, 0.5) for k in range(steps)] + [(-0.5, 0.5 - k / steps) for k in range(steps)]
        corners = (back(F.col("x") + u * width, F.col("y") + v * width) for u, v in around)
        ring = F.array(*(F.struct(((x - x0) / size).alias("x"), ((y - y0) / size).alias("y")) for x, y in corners))
        named = targets.select("r", "c", (F.col("r").cast("long") * (1 << 32) + F.col("c")).alias("zone"), F.array(ring).alias("rings"))
        shares = cell_weights(spread(named, "zone"), 1.0).join(cells.where("value is not null").select("r", "c", "value"), ["r", "c"]).groupBy("zone")
        means = shares.agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
        return named.select("r", "c", "zone").join(means, "zone", "left").select("r", "c", "value")
    x, y = back(F.col("x"), F.col("y"))
    moved = targets.select(F.col("r").alias("i"), F.col("c").alias("j"), x.alias("x"), y.alias("y"))
    if method == "bilinear":
        placed = moved.select("i", "j", ((F.col("y") - y0) / size - 0.5).alias("fr"), ((F.col("x") - x0) / size - 0.5).alias("fc"))
        return bilinear(cells, placed).select(F.col("i").alias("r"), F.col("j").alias("c"), "value")
    if method != "nearest":
        raise ValueError("method is 'nearest', 'bilinear' or 'average'")
    return sample(cells, moved, x0, y0, size).select(F.col("i").alias("r"), F.col("j").alias("c"), "value")


def patches(cells: DataFrame) -> DataFrame:
    """(r, c, value, patch): connected cells of equal value share a patch, the smallest number r * 2^32 + c in it.

    Runs along rows are one node each at first, so rounds of taking the smallest number among neighbours, then
    that of the number taken, are few; each round is written out. The driver only learns whether anything changed.
    """
    from pyspark.sql import Window

    from fluvia.session import materialize

    known = cells.where("value is not null").select("r", "c", "value")
    row = Window.partitionBy("r").orderBy("c")
    new = F.coalesce((F.lag("value").over(row) != F.col("value")) | (F.lag("c").over(row) != F.col("c") - 1), F.lit(True))
    runs = known.withColumn("run_", F.sum(new.cast("int")).over(row))
    number = F.min(F.col("r").cast("long") * (1 << 32) + F.col("c")).over(Window.partitionBy("r", "run_"))
    named = materialize(runs.select("r", "c", "value", number.alias("node")), "patch-runs")
    above = named.select((F.col("r") + 1).alias("r"), "c", "value", F.col("node").alias("other"))
    edges = materialize(named.join(above, ["r", "c", "value"]).select("node", "other").distinct(), "patch-edges")
    both = materialize(edges.union(edges.select("other", "node")), "patch-links")
    labels = materialize(named.select("node", F.col("node").alias("patch")).distinct(), "patch-labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        taken = labels.join(near, "node", "left").select("node", F.least("patch", F.coalesce("near", "patch")).alias("mid"), "patch")
        jumped = taken.join(labels.toDF("mid", "far"), "mid").select("node", F.least("mid", "far").alias("patch"), (F.least("mid", "far") < F.col("patch")).alias("moved"))
        jumped = materialize(jumped, "patch-labels")
        labels = jumped.select("node", "patch")
        if jumped.where("moved").isEmpty():
            return named.join(labels, "node").select("r", "c", "value", "patch")


def polygonise(cells: DataFrame) -> DataFrame:
    """(patch, value, cells, edges): each patch of equal cells with its outline, array<struct<r0, c0, r1, c1>> of unit edges between corners."""
    made = patches(cells)
    sides = ((0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0), (0, 0, 1, 0, 0, -1), (0, 1, 1, 1, 0, 1))
    each = made.withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("a", "b", "d", "e", "i", "j"), s, strict=True))) for s in sides))))
    each = each.select("patch", "value", "r", "c", "s", (F.col("r") + F.col("s.i")).alias("nr"), (F.col("c") + F.col("s.j")).alias("nc"))
    across = made.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("patch").alias("other"))
    edge = F.struct((F.col("r") + F.col("s.a")).alias("r0"), (F.col("c") + F.col("s.b")).alias("c0"), (F.col("r") + F.col("s.d")).alias("r1"), (F.col("c") + F.col("s.e")).alias("c1"))
    outline = each.join(across, ["nr", "nc"], "left").where("other is null or other <> patch").groupBy("patch").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return made.groupBy("patch").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("cells")).join(outline, "patch")


def patch_polygons(cells: DataFrame) -> DataFrame:
    """(patch, value, cells, rings, outlines): each patch of equal cells as a polygon: closed rings of its corners, x along columns
    and y along rows, its outline against the clock and its holes with it."""
    made = patches(cells)
    facts = made.groupBy("patch").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("cells"))
    return facts.join(assemble(patch_edges(made), "patch"), "patch")


def compare_fields(observed: DataFrame, ensemble: DataFrame) -> DataFrame:
    """(t, low, high, inside, cells, n): for each time the range over a field and all members of an ensemble (t, member, r, c, value),
    the share of cells whose value lies within the members' range there, cells compared, and members that have them all."""
    members = ensemble.groupBy("t", "r", "c").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("k"))
    both = observed.select("t", "r", "c", "value").join(members, ["t", "r", "c"])
    inside = F.avg(F.when(F.col("value").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0))
    return both.groupBy("t").agg(F.least(F.min("lo"), F.min("value")).alias("low"), F.greatest(F.max("hi"), F.max("value")).alias("high"), inside.alias("inside"), F.count(F.lit(1)).alias("cells"), F.min("k").alias("n"))
