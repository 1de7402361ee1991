"""Queries on distances, interpolation, variograms, kriging and rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia import adapt
from fluvia.functions import variogram
from fluvia.operators import geostat, raster, spatial
from fluvia.plans.registry import query, r6

#: Largest distance of the pairs of an empirical variogram: its cut. Nothing else has a reach.
REACH = 250.0
MODEL = "2.0 Nug(0) + 8.0 Sph(300) + 3.0 Exp(120)"
_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
_PAIRS = f"pr AS (SELECT a.stn AS a, b.stn AS b, {_D} AS dist, a.z AS az, b.z AS bz FROM stations a JOIN stations b ON a.stn<b.stn WHERE {_D}<=25e1)"
_EVERY = f"pr AS (SELECT a.stn AS a, b.stn AS b, {_D} AS dist FROM stations a JOIN stations b ON a.stn<b.stn)"
_BOTH = f"{_EVERY}, bo AS (SELECT a, b, dist FROM pr UNION ALL SELECT b, a, dist FROM pr)"
_VP = f"{_PAIRS}, vp AS (SELECT pr.*, va.m, va.value AS va, vb.value AS vb FROM pr JOIN obs_month va ON va.stn=pr.a JOIN obs_month vb ON vb.stn=pr.b AND vb.m=va.m)"
_BINNED = "round(avg(dist),6) AS dist, round(sum((va-vb)*(va-vb))/(2*count(*)),6) AS classic, round(pow(sum(sqrt(abs(va-vb)))/count(*),4)/(457e-3+494e-3/count(*))/2,6) AS robust, count(*) AS n"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.stations(spark, sf_dir)


@query("stations", f"{_EVERY} SELECT a, b, round(dist,6) AS dist FROM pr")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.station_pairs(stations(spark, sf_dir)).withColumn("dist", r6("dist"))


@query("stations", f"{_BOTH}, p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS place FROM bo) SELECT a, b, round(dist,6) AS dist, place FROM p WHERE place<=5")
def knn_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_stations(stations(spark, sf_dir), 5).withColumn("dist", r6("dist"))


@query("stations", f"{_EVERY} SELECT round(99e-2*sqrt(min(dist)*min(dist)/2),6) AS cell_size FROM pr WHERE dist>0")
def cell_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dist")
    return spatial.smallest_distance(stations(spark, sf_dir)).select(r6(0.99 * F.sqrt(d * d / 2)).alias("cell_size"))


@query("stations cells", "ax AS (SELECT DISTINCT c, c*20e0+10 AS x FROM cells), ay AS (SELECT DISTINCT r, r*20e0+10 AS y FROM cells) SELECT s.stn, (SELECT arg_min(c, (abs(ax.x-s.x), c)) FROM ax) AS c, (SELECT arg_min(r, (abs(ay.y-s.y), r)) FROM ay) AS r FROM stations s")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = adapt.cells(spark, sf_dir).agg(F.min("c"), F.max("c"), F.min("r"), F.max("r")).first()
    return stations(spark, sf_dir).select("stn", raster.nearest_index(F.col("x"), 10.0, 20.0, edges[0], edges[1]).alias("c"), raster.nearest_index(F.col("y"), 10.0, 20.0, edges[2], edges[3]).alias("r"))


@query("stations obs_month", f"{_VP} SELECT m, CAST(floor(dist/50e0) AS INT) AS bin, {_BINNED} FROM vp GROUP BY 1, 2")
def variogram_cnst(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = geostat.binned_blocks(adapt.obs_month(spark, sf_dir), stations(spark, sf_dir), REACH, "m", lambda d: np.floor(d / 50.0))
    return bins.select("m", "bin", *(r6(c).alias(c) for c in ("dist", "classic", "robust")), "n")


@query("stations obs_month", f"{_VP}, k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY m ORDER BY dist, a, b)-1)/50) AS INT) AS bin FROM vp) SELECT m, bin, {_BINNED} FROM k GROUP BY m, bin")
def variogram_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = geostat.equal_count_bins(adapt.obs_month(spark, sf_dir), stations(spark, sf_dir), REACH, 50, "m")
    return bins.select("m", "bin", *(r6(c).alias(c) for c in ("dist", "classic", "robust")), "n")


@query("stations", f"{_PAIRS} SELECT a, b, round(dist,6) AS dist, round((az-bz)*(az-bz)/2,6) AS gamma FROM pr")
def variogram_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    z = s.select(F.col("stn").alias("a"), F.col("z").alias("va")), s.select(F.col("stn").alias("b"), F.col("z").alias("vb"))
    pairs = spatial.station_pairs(s, REACH).join(z[0], "a").join(z[1], "b")
    return geostat.cloud(pairs).select("a", "b", r6("dist").alias("dist"), r6("gamma").alias("gamma"))


_GAMMA = "(CASE WHEN {h}=0 THEN 0e0 ELSE 2e0 + CASE WHEN {h}>=300 THEN 8e0 ELSE 8e0*(15e-1*{h}/300-{h}*{h}*{h}/(2*27e6)) END + 3e0*(1-exp(-{h}/120e0)) END)"


@query("stations", f"{_PAIRS} SELECT a, b, round({_GAMMA.format(h='dist')},6) AS gamma FROM pr")
def variogram_model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.station_pairs(stations(spark, sf_dir), REACH)
    return pairs.select("a", "b", r6(variogram.gamma(F.col("dist"), variogram.parse(MODEL))).alias("gamma"))


@query("", "t(sill, kind, reach) AS (VALUES (2e0,'Nug',0e0),(8e0,'Sph',300e0),(3e0,'Exp',120e0)) SELECT kind, round(sill*20/13,5) AS sill, round(reach*5e-1,5) AS reach FROM t")
def variogram_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = variogram.rescale(variogram.parse(MODEL), 20.0, 0.5)
    return spark.createDataFrame([(t, round(s, 5), round(r, 5)) for s, t, r in variogram.parse(variogram.format_model(made))], "kind string, sill double, reach double")


@query()
def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best nested models of each month with values of at least five stations."""
    made = geostat.fit_times(adapt.obs_month(spark, sf_dir), stations(spark, sf_dir), "m", 50.0, 600.0, 5, n_best=2)
    return made.select("m", "place", "model", r6("objective").alias("objective"), r6("aic").alias("aic"))


_CUT = "ft AS (SELECT max(dist)*35e-2 AS cut, min(dist) AS lo FROM pr), wd AS (SELECT k, (cut-lo)*pow(95e-2,k) AS w, cut, lo FROM ft, (SELECT unnest(range(1,101)) AS k)), ct AS (SELECT k, w, cut, lo, least(floor((dist-lo)/w), greatest(0, ceil((cut-lo)/w)-1)) AS b, count(*) AS n FROM wd, pr WHERE dist<=cut AND w>lo GROUP BY ALL), ok AS (SELECT w FROM ct GROUP BY k, w, cut, lo HAVING min(n)>=2 AND count(*)=greatest(1, ceil((cut-lo)/w)))"


@query("stations", f"{_EVERY}, {_CUT} SELECT round(max(cut),6) AS cut, (SELECT round(min(w),5) FROM ok) AS width FROM ft")
def lag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut at 0.35 of the largest distance, and the smallest width whose bins all hold two pairs."""
    s = stations(spark, sf_dir)
    low, far = geostat.extremes(s) or (0.0, 0.0)
    cut = far * 0.35
    width = geostat.search_lag_of(s, low, cut, 2)
    return spark.createDataFrame([(round(cut, 6), None if width is None else round(width, 5))], "cut double, width double")


@query("stations", f"{_EVERY}, e AS (SELECT *, least(CAST(floor((dist-15e0)/70) AS INT),5) AS bin FROM pr WHERE dist>=15 AND dist<=400) SELECT bin, 15e0+bin*70 AS low, least(400e0,15e0+(bin+1)*70) AS high, round(avg(dist),6) AS dist, count(*) AS n FROM e GROUP BY bin")
def lag_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geostat.lag_figures(stations(spark, sf_dir), 70.0, 400.0, 15.0).withColumn("dist", r6("dist"))


@query("", "m AS (SELECT 13e0 AS sill, 120e0 AS last) SELECT * FROM m")
def total_sill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([variogram.total_sill_last_range(variogram.parse(MODEL))], "sill double, last double")


@query("stations obs_month cells", "q AS (SELECT o.m, regr_slope(value, z) AS a, regr_intercept(value, z) AS b FROM obs_month o JOIN stations s ON s.stn=o.stn GROUP BY o.m HAVING count(DISTINCT z)>1) SELECT q.m, r, c, round(b+a*k.value,5) AS value FROM q, (SELECT r, c, value FROM cells) k")
def drift_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapt.cells(spark, sf_dir).select("r", "c", F.col("value").alias("z"))
    return geostat.drift_fields(adapt.obs_month(spark, sf_dir), stations(spark, sf_dir), "m", "z", 1, grid).withColumn("value", F.round("value", 5))


_RAW = "coalesce(avg(value) FILTER (WHERE dist=0), sum(value/(dist*dist)) FILTER (WHERE dist>0)/sum(1/(dist*dist)) FILTER (WHERE dist>0))"
_IDW = "round(coalesce(avg(value) FILTER (WHERE dist=0), sum(value/(dist*dist)) FILTER (WHERE dist>0)/sum(1/(dist*dist)) FILTER (WHERE dist>0)),6)"


def idw_rows(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    s = stations(spark, sf_dir)
    return spatial.idw_all(s, s, adapt.obs_month(spark, sf_dir), "m", 2, **more).where("value is not null")


@query("stations obs_month", f"{_BOTH} SELECT bo.a AS stn, o.m, {_IDW} AS value FROM bo JOIN obs_month o ON o.stn=bo.b GROUP BY bo.a, o.m")
def idw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idw_rows(spark, sf_dir).select("stn", "m", r6("value").alias("value"))


@query("stations cells", "t AS (SELECT r, c, c*20e0+10 AS x, r*20e0+10 AS y FROM cells), j AS (SELECT r, c, s.z AS value, sqrt((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y)) AS dist FROM t, stations s) SELECT r, c, " + _IDW + " AS value FROM j GROUP BY r, c")
def idw_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapt.cells(spark, sf_dir).select(F.struct("r", "c").alias("stn"), (F.col("c") * 20.0 + 10).alias("x"), (F.col("r") * 20.0 + 10).alias("y"))
    s = stations(spark, sf_dir)
    made = spatial.idw_all(grid.withColumn("stn", F.col("stn.r") * 1000 + F.col("stn.c")), s, s.select("stn", F.lit(0).alias("t"), F.col("z").alias("value")), "t", 2, itself=True)
    return made.select(F.floor(F.col("stn") / 1000).cast("int").alias("r"), (F.col("stn") % 1000).cast("int").alias("c"), r6("value").alias("value"))


@query("stations obs_month", f"{_BOTH}, e AS (SELECT bo.a AS stn, o.m, {_IDW} AS value FROM bo JOIN obs_month o ON o.stn=bo.b GROUP BY bo.a, o.m) SELECT e.stn, count(*) AS n, round(avg(o.value-e.value),6) AS bias, round(sqrt(avg((o.value-e.value)*(o.value-e.value))),6) AS rmse FROM e JOIN obs_month o ON o.stn=e.stn AND o.m=e.m GROUP BY e.stn")
def idw_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = idw_points(spark, sf_dir).withColumnRenamed("value", "estimate")
    e = F.col("value") - F.col("estimate")
    return made.join(adapt.obs_month(spark, sf_dir), ["stn", "m"]).groupBy("stn").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(e)).alias("bias"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))


@query("stations obs_month", f"{_BOTH}, ro AS (SELECT stn, m, value, CASE WHEN (stn+m) % 3=0 THEN 'valid' ELSE 'ctrl' END AS role FROM obs_month WHERE m % 7<>0), e AS (SELECT bo.a AS stn, o.m, {_IDW} AS estimate FROM bo JOIN ro o ON o.stn=bo.b AND o.role='ctrl' GROUP BY bo.a, o.m) SELECT v.stn, v.m, round(v.value,6) AS value, e.estimate FROM ro v JOIN e ON e.stn=v.stn AND e.m=v.m WHERE v.role='valid'")
def idw_validate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = adapt.obs_month(spark, sf_dir)
    roles = obs.where("m % 7 <> 0").select("stn", "m", F.when((F.col("stn") + F.col("m")) % 3 == 0, "valid").otherwise("ctrl").alias("role"))
    made = spatial.idw_validate(stations(spark, sf_dir), obs, roles, "m", 2)
    return made.where("estimate is not null").select("stn", "m", r6("value").alias("value"), r6("estimate").alias("estimate"))


@query("stations obs_month", f"{_BOTH}, j AS (SELECT bo.a, o.m, bo.dist, o.value, s.z FROM bo JOIN obs_month o ON o.stn=bo.b JOIN stations s ON s.stn=bo.b WHERE (o.stn+o.m) % 3<>0), e AS (SELECT a, m, {_RAW} AS value, {_RAW.replace('value', 'z').replace('dist*dist', 'dist')} AS zi FROM j GROUP BY a, m) SELECT e.a AS stn, m, round(e.value-64e-4*(s.z-e.zi),6) AS value FROM e JOIN stations s ON s.stn=e.a")
def idw_lapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights are interpolated, with a power of their own, from the stations that have a value at the time."""
    s = stations(spark, sf_dir)
    made = spatial.idw_all(s, s, adapt.obs_month(spark, sf_dir).where("(stn + m) % 3 <> 0"), "m", 2, heights=1)
    return made.where("value is not null").select("stn", "m", r6("value").alias("value"))


@query("stations", "b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM stations), i AS (SELECT unnest(generate_series(CAST(floor(x0/100) AS BIGINT)-2, CAST(floor(x1/100) AS BIGINT)+2)) AS i FROM b), j AS (SELECT unnest(generate_series(CAST(floor(y0/100) AS BIGINT)-2, CAST(floor(y1/100) AS BIGINT)+2)) AS j FROM b) SELECT CAST((SELECT max(j) FROM j)-j AS INT) AS r, CAST(i-(SELECT min(i) FROM i) AS INT) AS c, (i+5e-1)*100 AS x, (j+5e-1)*100 AS y FROM i, j")
def target_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mesh(stations(spark, sf_dir), 100.0)


@query("stations obs_month", "SELECT m, round(regr_slope(value, z),9) AS slope, round(regr_intercept(value, z),6) AS intercept, round(corr(value, z),6) AS rho, count(*) AS n FROM obs_month JOIN stations ON obs_month.stn=stations.stn GROUP BY m")
def drift_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.obs_month(spark, sf_dir).join(stations(spark, sf_dir), "stn")
    return rows.groupBy("m").agg(F.round(F.regr_slope("value", "z"), 9).alias("slope"), r6(F.regr_intercept("value", "z")).alias("intercept"), r6(F.corr("value", "z")).alias("rho"), F.count(F.lit(1)).alias("n"))


# With two neighbours the systems have closed forms, which SQL can check.
_TWO = f"{_BOTH}, nb AS (SELECT bo.a, o.m, bo.b, bo.dist, o.value, row_number() OVER (PARTITION BY bo.a, o.m ORDER BY bo.dist, bo.b) AS place FROM bo JOIN obs_month o ON o.stn=bo.b), tw AS (SELECT p.a, p.m, p.value AS v1, q.value AS v2, {_GAMMA.format(h='p.dist')} AS g1, {_GAMMA.format(h='q.dist')} AS g2, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)) AS h FROM nb p JOIN nb q ON p.a=q.a AND p.m=q.m AND p.place=1 AND q.place=2 JOIN stations s ON s.stn=p.b JOIN stations t ON t.stn=q.b), gg AS (SELECT *, {_GAMMA.format(h='h')} AS g FROM tw)"


@query("stations obs_month", f"{_TWO}, l AS (SELECT *, 5e-1+(g2-g1)/(2*g) AS w FROM gg) SELECT a AS stn, m, round(w*v1+(1-w)*v2,6) AS estimate, round(greatest(0,w*g1+(1-w)*g2+g1-(1-w)*g),6) AS variance FROM l")
def krige_ordinary_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_two(spark, sf_dir, "ordinary")


@query("stations obs_month", f"{_TWO}, l AS (SELECT *, ((13-g1)*13-(13-g2)*(13-g))/(169-(13-g)*(13-g)) AS w1, ((13-g2)*13-(13-g1)*(13-g))/(169-(13-g)*(13-g)) AS w2 FROM gg) SELECT a AS stn, m, round(w1*v1+w2*v2,6) AS estimate, round(greatest(0,13-w1*(13-g1)-w2*(13-g2)),6) AS variance FROM l")
def krige_simple_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_two(spark, sf_dir, "simple", sill=13.0)


@query("stations obs_month", f"{_TWO}, l AS (SELECT *, ((13-g1)*13-(13-g2)*(13-g))/(169-(13-g)*(13-g)) AS w1, ((13-g2)*13-(13-g1)*(13-g))/(169-(13-g)*(13-g)) AS w2 FROM gg), k AS (SELECT a, m, greatest(0e0,CASE WHEN v1<=25 THEN w1 ELSE 0e0 END+CASE WHEN v2<=25 THEN w2 ELSE 0e0 END) AS p FROM l) SELECT a AS stn, m, round(p,6) AS estimate, round(p*(1-p),6) AS variance FROM k")
def krige_indicator_simple_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_two(spark, sf_dir, "indicator_simple", sill=13.0, limit=25.0)


@query("stations obs_month", f"{_TWO}, l AS (SELECT *, 5e-1+(g2-g1)/(2*g) AS w FROM gg) SELECT a AS stn, m, round(g1-(1-w)*g,6) AS multiplier, round(greatest(0e0,CASE WHEN v1<=25 THEN w ELSE 0e0 END+CASE WHEN v2<=25 THEN 1-w ELSE 0e0 END),6) AS share FROM l")
def krige_multipliers_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers of the systems of the two nearest, and the share of values up to 25 by indicators."""
    s = stations(spark, sf_dir)
    made = geostat.krige_all(s, s, adapt.obs_month(spark, sf_dir), "m", variogram.parse(MODEL), "indicator", k=2, limit=25.0)
    return made.where("n = 2").select("stn", "m", r6(F.get("multipliers", F.lit(0))).alias("multiplier"), r6("estimate").alias("share"))


@query()
def krige_indicator_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "indicator_simple", limit=25.0)


@query("cells", "o AS (SELECT r, c FROM cells WHERE cls>25) SELECT k.r, k.c, CASE WHEN o.r IS NOT NULL THEN round(k.value,6) END AS value FROM cells k LEFT JOIN o ON o.r=CAST(floor(((k.r+5e-1)*20-7)/50) AS INT) AND o.c=CAST(floor(((k.c+5e-1)*20+3)/50) AS INT)")
def mask_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a coarser raster with a corner of its own."""
    cells = adapt.cells(spark, sf_dir)
    shape = cells.select("r", "c", F.when(F.col("cls") > 25, F.col("value")).alias("value"))
    return raster.mask_snapped(cells.select("r", "c", r6("value").alias("value")), 0.0, 0.0, 20.0, shape, -3.0, 7.0, 50.0)


@query("stations", f"{_EVERY} SELECT round(max(dist)*5e-1,6) AS half FROM pr WHERE dist<=600")
def cut_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the largest distance up to 600."""
    far = geostat.farthest(stations(spark, sf_dir), 600.0)
    return spark.createDataFrame([(round((far or 0.0) * 0.5, 6),)], "half double")


def kriged_from_two(spark: SparkSession, sf_dir: str, kind: str, **more) -> DataFrame:
    """From the two nearest, where there are two."""
    s = stations(spark, sf_dir)
    made = geostat.krige_all(s, s, adapt.obs_month(spark, sf_dir), "m", variogram.parse(MODEL), kind, k=2, **more)
    return made.where("n = 2").select("stn", "m", r6("estimate").alias("estimate"), r6("variance").alias("variance"))


def kriged_from_all(spark: SparkSession, sf_dir: str, kind: str, **more) -> DataFrame:
    s = stations(spark, sf_dir)
    made = geostat.krige_all(s, s, adapt.obs_month(spark, sf_dir), "m", variogram.parse(MODEL), kind, **more)
    return made.select("stn", "m", *(r6(c).alias(c) for c in ("estimate", "variance", "weights")), "status")


@query()
def krige_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "ordinary")


@query()
def krige_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "simple")


@query()
def krige_edk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "drift")


@query()
def krige_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "indicator", limit=25.0)


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster and itself moved by three rows and two columns, its values doubled."""
    cells = adapt.cells(spark, sf_dir)
    return cells.select(F.lit(0).alias("order"), "r", "c", "value").union(cells.select(F.lit(1), F.col("r") + 3, F.col("c") + 2, F.col("value") * 2))


@query("cells", "st AS (SELECT 0 AS o, r, c, value FROM cells UNION ALL SELECT 1, r+3, c+2, value*2 FROM cells) SELECT r, c, round(arg_min(value,o),6) AS first_value, round(arg_max(value,o),6) AS last_value, round(min(value),6) AS low, round(max(value),6) AS high, round(avg(value),6) AS mean FROM st GROUP BY r, c")
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stacked(spark, sf_dir)
    v = F.col("value")
    return both.groupBy("r", "c").agg(r6(F.min_by(v, "order")).alias("first_value"), r6(F.max_by(v, "order")).alias("last_value"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"), r6(F.avg(v)).alias("mean"))


@query("cells", "SELECT a.r, a.c, CASE WHEN b.cls>25 THEN round(a.value,6) END AS value FROM cells a LEFT JOIN cells b ON a.r=b.r+1 AND a.c=b.c")
def raster_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = adapt.cells(spark, sf_dir)
    shape = cells.select((F.col("r") + 1).alias("r"), "c", F.when(F.col("cls") > 25, F.col("value")).alias("value"))
    return raster.mask(cells.select("r", "c", r6("value").alias("value")), shape)


@query("cells", "SELECT r, c, CASE WHEN value BETWEEN 1000 AND 1500 THEN round(value,6) END AS value FROM cells")
def raster_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.set_null(adapt.cells(spark, sf_dir).select("r", "c", r6("value").alias("value")), 1000, 1500)


@query("cells", "SELECT CAST(floor(r/4) AS INT) AS r, CAST(floor(c/4) AS INT) AS c, round(avg(value),6) AS value FROM cells GROUP BY 1, 2")
def raster_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resample(adapt.cells(spark, sf_dir), 4).withColumn("value", r6("value"))


@query("cells", "SELECT r, c, round(value,6) AS value FROM cells WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 40")
def raster_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.clip(adapt.cells(spark, sf_dir).select("r", "c", r6("value").alias("value")), 5, 20, 10, 40)


@query("cells", "SELECT min(c) AS c0, max(c) AS c1, min(r) AS r0, max(r) AS r1, max(c)-min(c)+1 AS cols, max(r)-min(r)+1 AS rows, count(value) AS n, round(min(value),6) AS low, round(max(value),6) AS high FROM cells")
def raster_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.properties(adapt.cells(spark, sf_dir)).withColumns({c: r6(c) for c in ("low", "high")})


@query("cells", "st AS (SELECT 0 AS o, r, c FROM cells UNION ALL SELECT 1, r+3, c+2 FROM cells), e AS (SELECT o, min(r) AS a, max(r) AS b, min(c) AS x, max(c) AS y FROM st GROUP BY o) SELECT count(DISTINCT (a,b,x,y))=1 AS same FROM e")
def extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = stacked(spark, sf_dir).groupBy("order").agg(F.struct(F.min("r"), F.max("r"), F.min("c"), F.max("c")).alias("e"))
    return each.agg((F.count_distinct("e") == 1).alias("same"))


_ZONES = "zo AS (SELECT stn AS zone, x AS x0, x+45e0 AS x1, y AS y0, y+35e0 AS y1, 45e0*35e0 AS area FROM stations)"


@query("stations cells", f"{_ZONES} SELECT zone, round(sum(value*(least(x1,(c+1)*20e0)-greatest(x0,c*20e0))*(least(y1,(r+1)*20e0)-greatest(y0,r*20e0))/area),2) AS value FROM zo JOIN cells ON c*20e0<x1 AND (c+1)*20e0>x0 AND r*20e0<y1 AND (r+1)*20e0>y0 GROUP BY zone")
def zonal_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = adapt.cells(spark, sf_dir)
    zones = stations(spark, sf_dir).select(F.col("stn").alias("zone"), F.col("x").alias("x0"), (F.col("x") + 45).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 35).alias("y1"))
    return spatial.zonal_mean(cells, spatial.rectangle_weights(cells, zones, 20.0))


@query("field", "k AS (SELECT pt, t, value, row_number() OVER (PARTITION BY pt ORDER BY t) AS i FROM field), w AS (SELECT *, value-lag(value,8) OVER (PARTITION BY pt ORDER BY i) AS acc, avg(value) OVER (PARTITION BY pt ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS mean FROM k) SELECT pt, t, round(acc,6) AS acc, round(mean,6) AS mean FROM w WHERE i>8 AND (i-1)%8=0")
def block_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("pt").orderBy("t")
    rows = adapt.field(spark, sf_dir).withColumn("i", F.row_number().over(w)).withColumn("acc", F.col("value") - F.lag("value", 8).over(w)).withColumn("mean", F.avg("value").over(w.rowsBetween(-8, 0)))
    return rows.where((F.col("i") > 8) & ((F.col("i") - 1) % 8 == 0)).select("pt", "t", r6("acc").alias("acc"), r6("mean").alias("mean"))


@query()
def krige_edk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriged_from_all(spark, sf_dir, "drift", drifts=("z", "x"))


@query()
def krige_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields on a mesh with the model of each month, held within the month's values."""
    obs = adapt.obs_month(spark, sf_dir)
    models = obs.where("m % 5 <> 0").select("m").distinct().withColumn("model", F.when(F.col("m") % 2 == 0, MODEL).otherwise("4.0 Sph(500)"))
    cells = spatial.mesh(stations(spark, sf_dir), 100.0).withColumn("stn", F.col("r") * 1000 + F.col("c"))
    made = geostat.krige_fields(cells, stations(spark, sf_dir), obs, "m", models, itself=True, drifts=())
    return made.select("m", F.floor(F.col("stn") / 1000).cast("int").alias("r"), (F.col("stn") % 1000).cast("int").alias("c"), r6("estimate").alias("estimate"), r6("variance").alias("variance"), "status")
