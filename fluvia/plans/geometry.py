"""Queries on rasters beyond simple algebra, polygons and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia import adapt
from fluvia.functions import normal, projection
from fluvia.operators import polygons, raster, spatial, splines
from fluvia.plans.registry import query, r6


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.cells(spark, sf_dir).select("r", "c", r6("value").alias("value"))


# Around each station a triangle, and for every third a square with a hole, which SQL can check by half-planes.
_TRI = "tr AS (SELECT stn AS zone, x AS ax, y AS ay, x+90e0 AS px, y+20e0 AS py, x+30e0 AS qx, y+110e0 AS qy FROM stations)"
_IN = "((px-ax)*({y}-ay)-(py-ay)*({x}-ax)>=0 AND (qx-px)*({y}-py)-(qy-py)*({x}-px)>0 AND (ax-qx)*({y}-qy)-(ay-qy)*({x}-qx)>0)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapt.stations(spark, sf_dir)
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return s.select(F.col("stn").alias("zone"), F.array(F.array(point(0.0, 0.0), point(90.0, 20.0), point(30.0, 110.0))).alias("rings"))


@query("stations", f"{_TRI}, p AS (SELECT stn, x+4137e-2 AS x, y+3359e-2 AS y FROM stations) SELECT p.stn, zone FROM p JOIN tr ON {_IN.format(x='p.x', y='p.y')}")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapt.stations(spark, sf_dir).select("stn", (F.col("x") + 41.37).alias("x"), (F.col("y") + 33.59).alias("y"))
    return polygons.points_in_polygons(points, triangles(spark, sf_dir), 100.0).select("stn", "zone")


@query("stations cells", f"{_TRI} SELECT DISTINCT k.r, k.c, zone FROM tr JOIN cells k ON {_IN.format(x='(k.c*20e0+10137e-3)', y='(k.r*20e0+10071e-3)')}")
def rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres lie a little off, so that none falls on an edge."""
    moved = projection.transform_rings(F.col("rings"), lambda x, y: (x - 0.137, y - 0.071))
    marks = polygons.rasterise(triangles(spark, sf_dir).select("zone", moved.alias("rings")), 20.0)
    return marks.join(adapt.cells(spark, sf_dir).select("r", "c"), ["r", "c"], "left_semi").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "zone").distinct()


@query("stations cells", f"{_TRI}, i AS (SELECT DISTINCT k.r, k.c FROM tr JOIN cells k ON {_IN.format(x='(k.c*20e0+10137e-3)', y='(k.r*20e0+10071e-3)')}) SELECT k.r, k.c, CASE WHEN i.r IS NOT NULL THEN round(k.value,6) END AS value FROM cells k LEFT JOIN i ON i.r=k.r AND i.c=k.c")
def mask_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = projection.transform_rings(F.col("rings"), lambda x, y: (x - 0.137, y - 0.071))
    return polygons.mask(cells(spark, sf_dir), triangles(spark, sf_dir).select("zone", moved.alias("rings")), 20.0)


@query("stations", f"{_TRI} SELECT zone, 1e0 AS whole, round(((px-ax)*(qy-ay)-(py-ay)*(qx-ax))/2,4) AS area FROM tr")
def cell_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of a polygon's cells make up the whole, and its area is that of the formula."""
    made = polygons.cell_weights(triangles(spark, sf_dir), 20.0).groupBy("zone").agg(F.round(F.sum("weight"), 6).alias("whole"))
    return made.join(triangles(spark, sf_dir).select("zone", F.round(polygons.area(F.col("rings")), 4).alias("area")), "zone")


@query("stations", "d AS (SELECT stn % 3 AS zone, count(*) AS parts, round(min(x),6) AS x0, round(max(x+90),6) AS x1, round(min(y),6) AS y0, round(max(y+110),6) AS y1 FROM stations GROUP BY 1) SELECT * FROM d")
def dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = polygons.extents(polygons.dissolve(triangles(spark, sf_dir).withColumn("zone", F.col("zone") % 3)))
    return made.select("zone", "parts", *(r6(c).alias(c) for c in ("x0", "x1", "y0", "y1")))


_BOXES = "bx AS (SELECT stn % 3 AS zone, CAST(x AS BIGINT) AS x0, CAST(y AS BIGINT) AS y0 FROM stations)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of 45 by 35 around stations, those of every third under one id; some overlap, most are apart."""
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    corners = F.array(F.array(point(0.0, 0.0), point(45.0, 0.0), point(45.0, 35.0), point(0.0, 35.0)))
    return adapt.stations(spark, sf_dir).select((F.col("stn") % 3).alias("zone"), corners.alias("rings"))


@query("stations", f"{_BOXES}, u AS (SELECT DISTINCT zone, x0+i AS x, y0+j AS y FROM bx, (SELECT unnest(range(45)) AS i), (SELECT unnest(range(35)) AS j)) SELECT zone, (SELECT count(*) FROM bx WHERE bx.zone=u.zone) AS parts, round(count(*),4) AS area FROM u GROUP BY zone")
def dissolve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of unions, which SQL counts in unit squares."""
    return polygons.dissolve(boxes(spark, sf_dir)).select("zone", "parts", F.round(polygons.area(F.col("rings")), 4).alias("area"))


@query("stations cells", f"{_BOXES}, u AS (SELECT DISTINCT zone, x0+i AS x, y0+j AS y FROM bx, (SELECT unnest(range(45)) AS i), (SELECT unnest(range(35)) AS j)), t AS (SELECT zone, count(*) AS n FROM u GROUP BY zone), w AS (SELECT u.zone, y//20 AS r, x//20 AS c, count(*)/any_value(n) AS weight FROM u JOIN t ON t.zone=u.zone GROUP BY 1, 2, 3) SELECT zone, round(sum(value*weight),2) AS value FROM w JOIN cells k ON k.r=w.r AND k.c=w.c GROUP BY zone")
def zonal_mean_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted means over polygons of many parts."""
    return spatial.zonal_mean(adapt.cells(spark, sf_dir), polygons.cell_weights(polygons.dissolve(boxes(spark, sf_dir)), 20.0))


@query("stations cells", f"{_BOXES}, u AS (SELECT DISTINCT zone, x0+i AS x, y0+j AS y FROM bx, (SELECT unnest(range(45)) AS i), (SELECT unnest(range(35)) AS j)) SELECT zone, CAST(y//20 AS INT) AS r, CAST(x//20 AS INT) AS c, round(count(*)/(SELECT count(*) FROM u b WHERE b.zone=u.zone),6) AS weight FROM u GROUP BY zone, y//20, x//20")
def dissolved_cell_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each cell by itself."""
    made = polygons.cell_weights(polygons.dissolve(boxes(spark, sf_dir)), 20.0)
    return made.select("zone", "r", "c", r6("weight").alias("weight"))


@query("cells", "SELECT cls AS value, round(count(*),4) AS area FROM cells GROUP BY cls")
def polygonise_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the rings of all patches of a class, which SQL counts in cells."""
    patches = raster.patch_polygons(adapt.cells(spark, sf_dir).select("r", "c", F.col("cls").alias("value")))
    return patches.groupBy("value").agg(F.round(F.sum(polygons.area(F.col("rings"))), 4).alias("area"))


@query("stations", "SELECT stn, round(radians(x/20)*6378137e0,4) AS mx, round(ln(tan(pi()/4+radians(y/20)/2))*6378137e0,4) AS my FROM stations")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = projection.to_web_mercator(F.col("x") / 20, F.col("y") / 20)
    return adapt.stations(spark, sf_dir).select("stn", F.round(x, 4).alias("mx"), F.round(y, 4).alias("my"))


@query("cells", "t AS (SELECT (unnest(range(12))) AS i), g AS (SELECT a.i AS r, b.i AS c, degrees((b.i*1e5+5e4)/6378137e0) AS lon, degrees(2*atan(exp((a.i*1e5+5e4)/6378137e0))-pi()/2) AS lat FROM t a, t b) SELECT CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, round(k.value,6) AS value FROM g LEFT JOIN cells k ON k.r=CAST(floor(g.lat/3e-1) AS INT) AND k.c=CAST(floor(g.lon/3e-1) AS INT)")
def reproject_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of degrees, its cells 0.3 wide, on one of 100 km in the web map's system."""
    axis = F.sequence(F.lit(0), F.lit(11))
    grid = spark.range(1).select(F.explode(axis).alias("r")).select("r", F.explode(axis).alias("c"))
    targets = grid.select("r", "c", (F.col("c") * 1e5 + 5e4).alias("x"), (F.col("r") * 1e5 + 5e4).alias("y"))
    return raster.reproject(cells(spark, sf_dir), targets, projection.from_web_mercator, 0.0, 0.0, 0.3)


@query("cells stations", "SELECT s.stn, round(k.value,6) AS value FROM stations s LEFT JOIN cells k ON k.c=CAST(floor(s.x/20) AS INT) AND k.r=CAST(floor(s.y/20) AS INT)")
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sample(cells(spark, sf_dir), adapt.stations(spark, sf_dir).select("stn", "x", "y"), 0.0, 0.0, 20.0).select("stn", "value")


@query("cells stations", "g AS (SELECT r, c, c*20e0+10+r*5e-1 AS x, r*20e0+10+c*2e-1 AS y FROM cells), d AS (SELECT s.stn, g.r, g.c, sqrt((s.x-g.x)*(s.x-g.x)+(s.y-g.y)*(s.y-g.y)) AS dist FROM stations s JOIN g ON abs(s.x-g.x)<=60 AND abs(s.y-g.y)<=60) SELECT stn, arg_min(r,(dist,r,c)) AS r, arg_min(c,(dist,r,c)) AS c, round(min(dist),6) AS dist FROM d WHERE dist<=60 GROUP BY stn")
def nearest_cell_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapt.cells(spark, sf_dir).select("r", "c", (F.col("c") * 20.0 + 10 + F.col("r") * 0.5).alias("x"), (F.col("r") * 20.0 + 10 + F.col("c") * 0.2).alias("y"))
    return raster.nearest_of_curved(adapt.stations(spark, sf_dir), grid, 60.0).withColumn("dist", r6("dist"))


@query("cells stations", "g AS (SELECT r, c, c*20e0+10+r*5e-1 AS x, r*20e0+10+c*2e-1 AS y FROM cells), d AS (SELECT s.stn, g.r, g.c, sqrt((s.x-g.x)*(s.x-g.x)+(s.y-g.y)*(s.y-g.y)) AS dist FROM stations s, g) SELECT stn, arg_min(r,(dist,r,c)) AS r, arg_min(c,(dist,r,c)) AS c, round(min(dist),6) AS dist FROM d GROUP BY stn")
def nearest_cell_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station's, however far."""
    grid = adapt.cells(spark, sf_dir).select("r", "c", (F.col("c") * 20.0 + 10 + F.col("r") * 0.5).alias("x"), (F.col("r") * 20.0 + 10 + F.col("c") * 0.2).alias("y"))
    return raster.nearest_of_curved(adapt.stations(spark, sf_dir), grid).withColumn("dist", r6("dist"))


@query("cells stations", "b AS (SELECT r, c, r*4e1 AS y0, c*3e1 AS x0 FROM (SELECT DISTINCT r//2 AS r, (c*2)//3 AS c FROM cells)), o AS (SELECT b.r, b.c, k.value, (least(x0+30,(k.c+1)*20e0)-greatest(x0,k.c*20e0))*(least(y0+40,(k.r+1)*20e0)-greatest(y0,k.r*20e0)) AS a FROM b JOIN cells k ON k.c*20e0<x0+30 AND (k.c+1)*20e0>x0 AND k.r*20e0<y0+40 AND (k.r+1)*20e0>y0) SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(sum(value*a)/sum(a),6) AS value FROM o GROUP BY r, c")
def reproject_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted means on cells of another size and shape: a system whose axes are stretched."""
    given = cells(spark, sf_dir)
    targets = given.select(F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") * 2 / 3).cast("int").alias("c")).distinct()
    targets = targets.select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    made = raster.reproject(given, targets, lambda x, y: (x * 30.0, y * 40.0), 0.0, 0.0, 20.0, "average", 1.0)
    return made.select("r", "c", r6("value").alias("value"))


@query()
def spline_zoom_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the third order, over the whole raster, to twice its rows and columns; values beyond the input's range are missing."""
    given = adapt.cells(spark, sf_dir)
    rows = given.agg(F.max("r")).first()[0] + 1
    return splines.spline_zoom(given, rows, 50, 2.0, 3).select("r", "c", r6("value").alias("value"))


@query("cells", "SELECT r, c, CASE WHEN value>1500 THEN -9999e0 ELSE round(value,6) END AS value, CASE WHEN value<=1500 THEN CAST(floor(value) AS INT) ELSE -1 END AS whole, CASE WHEN value<=1000 THEN CAST(floor(value/4) AS INT) END AS small FROM cells")
def ndv_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values as a no-data value and back, and as other cell types."""
    holed = cells(spark, sf_dir).withColumn("value", F.when(F.col("value") <= 1500, F.col("value")))
    first = raster.change_ndv(raster.to_ndv(holed, -1.0), -1.0, -9999.0)
    whole = raster.change_type(raster.from_ndv(first, -9999.0, -1.0), "int32", -1).select("r", "c", F.col("value").alias("whole"))
    small = raster.change_type(cells(spark, sf_dir).withColumn("value", F.when(F.col("value") <= 1000, F.floor("value") / 4)), "byte").select("r", "c", F.col("value").cast("int").alias("small"))
    return first.join(whole, ["r", "c"]).join(small, ["r", "c"])


@query("cells", "m AS (SELECT max(r) AS top FROM cells), s AS (SELECT top-r AS r, c, round(value,6) AS value, (c*20e0+10)-10 AS corner FROM cells, m) SELECT CAST(r AS INT) AS r, c, value, corner, (SELECT top>0 FROM m) AS flipped FROM s")
def axis_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted from the other end, as their coordinates fall."""
    given = cells(spark, sf_dir)
    top = given.agg(F.max("r")).first()[0]
    axis = given.select("r", (-F.col("r") * 20.0).alias("y")).distinct()
    made = raster.flip(given, top + 1).crossJoin(F.broadcast(raster.falls(axis, "r", "y")))
    return made.select("r", "c", "value", raster.corner(F.col("c") * 20.0 + 10, 20.0).alias("corner"), "flipped")


@query("cells", "e AS (SELECT max(r)+1 AS n FROM cells), f AS (SELECT a.i AS r, b.i AS c, greatest(0e0,least(n-1e0,(a.i+5e-1)/3-5e-1)) AS fr, greatest(0e0,least(49e0,(b.i+5e-1)/3-5e-1)) AS fc FROM e, (SELECT unnest(range((SELECT max(r)+1 FROM cells)*3)) AS i) a, (SELECT unnest(range(150)) AS i) b), o AS (SELECT f.r, f.c, floor(fr)+i.i AS kr, floor(fc)+j.j AS kc, (CASE WHEN i.i=0 THEN floor(fr)+1-fr ELSE fr-floor(fr) END)*(CASE WHEN j.j=0 THEN floor(fc)+1-fc ELSE fc-floor(fc) END) AS w FROM f, (SELECT unnest(range(2)) AS i) i, (SELECT unnest(range(2)) AS j) j) SELECT CAST(o.r AS INT) AS r, CAST(o.c AS INT) AS c, CASE WHEN count(*)=count(g.value) THEN round(sum(g.value*w),5) END AS value FROM o LEFT JOIN cells g ON g.r=o.kr AND g.c=o.kc WHERE w>0 GROUP BY o.r, o.c")
def spline_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = adapt.cells(spark, sf_dir)
    rows = given.agg(F.max("r")).first()[0] + 1
    return raster.zoom(given, rows, 50, 3, 1).withColumn("value", F.round("value", 5))


@query("cells", "SELECT CAST(floor(r/4) AS INT) AS r, CAST(floor(c/4) AS INT) AS c, round(arg_min(value, (r,c)),6) AS near FROM cells GROUP BY 1, 2")
def raster_resample_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resample(cells(spark, sf_dir), 4, "near").withColumnRenamed("value", "near")


@query("cells", "st AS (SELECT 0 AS o, r, c, value FROM cells UNION ALL SELECT 1, r+3, c+2, value*2 FROM cells), k AS (SELECT * FROM st WHERE NOT (value BETWEEN 1200 AND 1300 OR value>2600)) SELECT r, c, round(arg_max(value,o),6) AS last FROM k GROUP BY r, c")
def mosaic_any_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of stacked rasters, where marked cells of either don't count."""
    given = adapt.cells(spark, sf_dir)
    both = given.select(F.lit(0).alias("order"), "r", "c", "value").union(given.select(F.lit(1), F.col("r") + 3, F.col("c") + 2, F.col("value") * 2))
    marked = both.withColumn("value", F.when(F.col("value").between(1200, 1300), -1.0).when(F.col("value") > 2600, -2.0).otherwise(F.col("value")))
    return raster.mosaic(raster.from_ndv(marked, -1.0, -2.0), "last").select("r", "c", r6("value").alias("last"))


@query("", "o AS (SELECT true AS same_extents, false AS same_crs) SELECT * FROM o")
def same_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 0.0, 0.0, 100.0, 80.0, 20.0, "EPSG:31467"), (2, 1e-8, 0.0, 100.0, 80.0, 20.0, "EPSG:32632")]
    return raster.same_grid(spark.createDataFrame(rows, "raster int, x0 double, y0 double, x1 double, y1 double, size double, crs string"))


@query()
def polygonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = adapt.cells(spark, sf_dir).select("r", "c", F.floor(F.col("cls") / 18).alias("value"))
    return raster.polygonise(bands).select("patch", "value", "cells", F.size("edges").alias("edges"))


@query("cells", "o AS (SELECT r % 3 AS t, r, c, value FROM cells), e AS (SELECT t, m, r, c, value*(9e-1+m*5e-2)+(c % 3-1)*40 AS value FROM o, (SELECT unnest(range(4)) AS m)), g AS (SELECT t, r, c, min(value) AS lo, max(value) AS hi, count(*) AS k FROM e GROUP BY t, r, c) SELECT CAST(o.t AS INT) AS t, round(least(min(lo),min(value)),5) AS low, round(greatest(max(hi),max(value)),5) AS high, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END),6) AS inside, count(*) AS cells, min(k) AS n FROM o JOIN g ON g.t=o.t AND g.r=o.r AND g.c=o.c GROUP BY o.t")
def compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = adapt.cells(spark, sf_dir).select((F.col("r") % 3).cast("int").alias("t"), "r", "c", "value")
    members = given.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("value", F.col("value") * (0.9 + F.col("member") * 0.05) + (F.col("c") % 3 - 1) * 40)
    made = raster.compare_fields(given, members)
    return made.select("t", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), r6("inside").alias("inside"), "cells", "n")


_VS = [(0.5 + 0.25 * i) for i in range(10)]


@query("", f"ax AS (SELECT (unnest(range(10)))/4e0+5e-1 AS s), g AS (SELECT a.s AS s, b.s AS t FROM ax a, ax b), w AS (SELECT s, t, pow(s/2,1/15e-1)+5e-1 AS xs, 5e-1-s AS ys, pow(s/2,1/15e-1-1)/(2*15e-1) AS ds, pow(t/2,1/15e-1)+5e-1 AS xt, 5e-1-t AS yt, pow(t/2,1/15e-1-1)/(2*15e-1) AS dt FROM g), f AS (SELECT s, t, ds*{normal.pdf_sql('xs')}+{normal.pdf_sql('ys')} AS fs, dt*{normal.pdf_sql('xt')}+{normal.pdf_sql('yt')} AS ft, ds*dt*exp(-(xs*xs+xt*xt-12e-1*xs*xt)/128e-2)/(2*pi()*8e-1)+ds*exp(-(xs*xs+yt*yt-12e-1*xs*yt)/128e-2)/(2*pi()*8e-1)+dt*exp(-(ys*ys+xt*xt-12e-1*ys*xt)/128e-2)/(2*pi()*8e-1)+exp(-(ys*ys+yt*yt-12e-1*ys*yt)/128e-2)/(2*pi()*8e-1) AS fb FROM w) SELECT s, t, round(fb/(fs*ft),6) AS density FROM f")
def v_copula_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.array(*map(F.lit, _VS))
    grid = spark.range(1).select(F.explode(axis).alias("s")).select("s", F.explode(axis).alias("t"))
    return grid.select("s", "t", r6(normal.v_copula(F.col("s"), F.col("t"), 0.6, 0.5, 2.0, 1.5)).alias("density"))


@query("", f"ax AS (SELECT (unnest(range(50))) AS i), z AS (SELECT i, {normal.ppf_sql('((i+1)/51e0)')} AS z FROM ax) SELECT round(sum(exp(-5e-1*(6e-1/64e-2)*(6e-1*(a.z*a.z+b.z*b.z)-2*a.z*b.z))/sqrt(64e-2))/2500e0,6) AS whole FROM z a, z b")
def copula_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over a grid of (i + 1) / (bins + 1), times its cells' area."""
    axis = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (i + 1) / 51.0)
    grid = spark.range(1).select(F.explode(axis).alias("u")).select("u", F.explode(axis).alias("v"))
    density = normal.gaussian_copula(normal.ppf(F.col("u")), normal.ppf(F.col("v")), 0.6)
    return grid.agg(r6(F.sum(density) / 2500).alias("whole"))
