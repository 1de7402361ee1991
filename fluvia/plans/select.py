"""Queries on selections, clamps, merges and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia import adapt
from fluvia.operators import select, series
from fluvia.plans.registry import query, r6
from fluvia.plans.series import _CALENDAR

_V = "round(value,6) AS value"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", r6("value"))


@query("obs_month stations", f"SELECT stn, m, {_V} FROM obs_month WHERE stn IN (SELECT stn FROM stations WHERE z>0)")
def station_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.common_stations(adapt.obs_month(spark, sf_dir), adapt.stations(spark, sf_dir).where("z > 0")))


@query("obs_month stations", f"SELECT stn, m, {_V} FROM obs_month WHERE stn NOT IN (SELECT stn FROM stations WHERE z<0)")
def drop_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.drop_stations(adapt.obs_month(spark, sf_dir), adapt.stations(spark, sf_dir).where("z < 0")))


@query("series", f"SELECT stn, d, {_V} FROM series WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.time_slice(adapt.series(spark, sf_dir), "d", datetime.date(2024, 1, 5), datetime.date(2024, 1, 12)))


@query("series", f"SELECT 'slice' AS kind, stn, d, {_V} FROM series WHERE d BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' UNION ALL SELECT 'indiv', stn, d, round(value,6) FROM series WHERE d IN (DATE '2024-01-03', DATE '2024-01-20') UNION ALL SELECT 'all', stn, d, round(value,6) FROM series")
def interval_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, dates = rounded(adapt.series(spark, sf_dir)), [datetime.date(2024, 1, 20), datetime.date(2024, 1, 3)]
    one, two, three = (select.interval(obs, "d", k, dates).select(F.lit(k).alias("kind"), "stn", "d", "value") for k in ("slice", "indiv", "all"))
    return one.union(two).union(three)


@query("series", f"{_CALENDAR}, w AS (SELECT stn, d, CASE WHEN stn % 7<>3 AND dayofmonth(d) % 5<>2 THEN value END AS value FROM panel) SELECT stn, d, {_V} FROM w WHERE d IN (SELECT d FROM w WHERE value IS NOT NULL) AND stn IN (SELECT stn FROM w WHERE value IS NOT NULL)")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = series.reindex(adapt.series(spark, sf_dir))
    holed = panel.withColumn("value", F.when((F.col("stn") % 7 != 3) & (F.dayofmonth("d") % 5 != 2), F.col("value")))
    return rounded(select.drop_empty(holed, "d"))


@query("series", f"SELECT stn, d, {_V} FROM series WHERE stn IN (1,2,3) AND d IN (SELECT d FROM series WHERE stn IN (1,2,3) GROUP BY d HAVING count(DISTINCT stn)=3)")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.complete_rows(adapt.series(spark, sf_dir), [1, 2, 3], "d"))


@query("stations", "SELECT stn, x, y FROM stations WHERE x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 800")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.bounding_box(adapt.stations(spark, sf_dir), 200, 700, 100, 800).select("stn", "x", "y")


@query("obs_month", "SELECT stn, m, CASE WHEN value-25>=0 THEN round(value-25,6) END AS no_negative, CASE WHEN value-25<1e-1 THEN 0e0 ELSE round(value-25,6) END AS no_trace, CASE WHEN value-25<1e-1 THEN 0e0 ELSE round(value-25,2) END AS interpolated FROM obs_month")
def threshold_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") - 25
    return adapt.obs_month(spark, sf_dir).select("stn", "m", r6(select.below_to_null(v)).alias("no_negative"), r6(select.below_to_zero(v)).alias("no_trace"), (select.clamp_interpolated(v) + 0.0).alias("interpolated"))


_CLAMP = "b AS (SELECT m, min(value) AS lo, max(value) AS hi FROM obs_month WHERE stn % 2=0 GROUP BY m)"


@query("obs_month", f"{_CLAMP} SELECT o.stn, o.m, round(CASE WHEN o.value<b.lo THEN b.lo ELSE o.value END,6) AS low_in, round(least(o.value,30e0),6) AS number, round(CASE WHEN o.value<b.lo THEN b.lo WHEN o.value>b.hi THEN b.hi ELSE o.value END,6) AS both FROM obs_month o LEFT JOIN b ON b.m=o.m")
def field_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = adapt.obs_month(spark, sf_dir)
    inputs = obs.where("stn % 2 = 0")
    made = lambda name, low, high: select.clamp_field(obs, inputs, "m", low, high).select("stn", "m", r6("value").alias(name))
    return made("low_in", "min_in", None).join(made("number", None, 30.0), ["stn", "m"]).join(made("both", "min_in", "max_in"), ["stn", "m"])


@query("series", f"{_CALENDAR} SELECT stn, d, coalesce(round(value,6), 1e-6) AS value FROM panel")
def fill_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.fill_constant(rounded(series.reindex(adapt.series(spark, sf_dir))))


@query("series", f"{_CALENDAR} SELECT stn, d, round(coalesce(value, stn*1e0),6) AS value, value IS NULL AS infilled FROM panel")
def coalesce_infilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = series.reindex(adapt.series(spark, sf_dir))
    return rounded(select.observed_or_infilled(panel, panel.withColumn("value", F.col("stn") * 1.0), "d"))


@query("obs_month stations", "a AS (SELECT stn, m, value FROM obs_month WHERE m % 2=0), b AS (SELECT stn, m, value*2 AS value FROM obs_month WHERE stn % 3<>0), c AS (SELECT o.stn, o.m, z AS value FROM obs_month o JOIN stations s ON s.stn=o.stn WHERE z>0) SELECT a.stn, a.m, round(a.value,6) AS v0, round(b.value,6) AS v1, round(c.value,6) AS v2 FROM a FULL JOIN b ON a.stn=b.stn AND a.m=b.m FULL JOIN c ON c.stn=a.stn AND c.m=a.m WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND c.value IS NOT NULL")
def outer_join_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = adapt.obs_month(spark, sf_dir)
    c = obs.join(adapt.stations(spark, sf_dir).where("z > 0"), "stn").select("stn", "m", F.col("z").alias("value"))
    made = select.in_all([obs.where("m % 2 = 0"), obs.where("stn % 3 <> 0").withColumn("value", F.col("value") * 2), c], ["stn", "m"])
    return made.select("stn", "m", *(r6(v).alias(v) for v in ("v0", "v1", "v2")))


@query("series", "SELECT d, array_to_string(list_sort(list(DISTINCT stn)), ',') AS stns FROM series WHERE value>40 OR stn % 2=0 GROUP BY d")
def station_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = adapt.series(spark, sf_dir)
    made = select.station_union([obs.where("value > 40"), obs.where("stn % 2 = 0")], "d")
    return made.select("d", F.array_join("stns", ",").alias("stns"))


@query("obs_month", "md AS (SELECT DISTINCT m, CASE WHEN m % 3=0 THEN '1.0 Sph(100)' ELSE '2.0 Exp(50)' END AS model FROM obs_month WHERE m % 4<>1) SELECT o.stn, o.m, round(o.value,6) AS value, md.model FROM obs_month o LEFT JOIN md ON md.m=o.m")
def model_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = rounded(adapt.obs_month(spark, sf_dir))
    models = obs.where("m % 4 <> 1").select("m").distinct().withColumn("model", F.when(F.col("m") % 3 == 0, "1.0 Sph(100)").otherwise("2.0 Exp(50)"))
    return select.with_model(obs, models, "m").select("stn", "m", "value", "model")


@query("obs_month", "a AS (SELECT stn, m, value FROM obs_month WHERE stn % 3<2), b AS (SELECT stn, m, value+100 AS value FROM obs_month WHERE stn % 3>0) SELECT coalesce(a.stn,b.stn) AS stn, coalesce(a.m,b.m) AS m, round(coalesce(b.value,a.value),6) AS value FROM a FULL JOIN b ON a.stn=b.stn AND a.m=b.m")
def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = adapt.obs_month(spark, sf_dir)
    return rounded(select.update(obs.where("stn % 3 < 2"), obs.where("stn % 3 > 0").withColumn("value", F.col("value") + 100), ["stn", "m"]))


@query("obs stations", "a AS (SELECT DISTINCT stn FROM obs WHERE value>45), b AS (SELECT stn FROM stations WHERE z>0) SELECT coalesce(a.stn,b.stn) AS stn, a.stn IS NOT NULL AS in_left, b.stn IS NOT NULL AS in_right FROM a FULL JOIN b ON a.stn=b.stn")
def index_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.set_operations(adapt.obs(spark, sf_dir).where("value > 45"), adapt.stations(spark, sf_dir).where("z > 0"), "stn")


@query("obs_month", "p AS (SELECT stn, m, value, row_number() OVER (PARTITION BY stn ORDER BY round(value,9) DESC, m) AS place FROM obs_month) SELECT stn, m, round(value,6) AS value, place FROM p WHERE place<=3")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.first_n(adapt.obs_month(spark, sf_dir), 3, F.desc(F.round("value", 9)), "m", by=("stn",)))


@query("", "s(k, chosen) AS (VALUES (4,'a,b,c,d'),(3,'a,b,c'),(3,'a,b,d'),(3,'a,c,d'),(3,'b,c,d'),(2,'a,b'),(2,'a,c'),(2,'a,d'),(2,'b,c'),(2,'b,d'),(2,'c,d'),(1,'a'),(1,'b'),(1,'c'),(1,'d')) SELECT k, chosen FROM s")
def neighbour_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(*map(F.lit, "abcd"))
    return spark.range(1).select(F.explode(select.combinations(items)).alias("c")).select(F.size("c").alias("k"), F.array_join("c", ",").alias("chosen"))


@query("", "t(i, kind) AS (VALUES (0,'Sph'),(1,'Exp'),(2,'Gau')) SELECT a.kind||'+'||b.kind AS model FROM t a, t b WHERE a.i<>b.i")
def model_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Sph", "Exp", "Gau")))
    return spark.range(1).select(F.explode(select.permutations(kinds, 2)).alias("p")).select(F.array_join("p", "+").alias("model"))


@query("series", "w AS (SELECT stn, d, value-lag(value) OVER (PARTITION BY stn ORDER BY d) AS step FROM series) SELECT stn, d, round(step,6) AS step, step>=0 AS rises FROM w")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.differences(adapt.series(spark, sf_dir), "d").select("stn", "d", r6("step").alias("step"), "rises")


@query("series", "c AS (SELECT stn, d, sum(abs(value)*(CASE WHEN stn % 4=0 THEN -1 ELSE 1 END)) OVER (PARTITION BY stn ORDER BY d) AS value FROM series), w AS (SELECT stn, value-lag(value) OVER (PARTITION BY stn ORDER BY d) AS step FROM c) SELECT stn, coalesce(bool_and(step>=0), true) AS rising FROM w GROUP BY stn")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sign = F.when(F.col("stn") % 4 == 0, -1).otherwise(1)
    total = F.sum(F.abs("value") * sign).over(Window.partitionBy("stn").orderBy("d"))
    return select.monotonic(adapt.series(spark, sf_dir).withColumn("value", total), "d")


@query("", "x AS (SELECT (unnest(range(-4, 30)))/4e0 AS x) SELECT x, round(CASE WHEN x<=0 THEN 10e0 WHEN x>=5 THEN 40e0 WHEN x<=1 THEN 10+10*x WHEN x<=2 THEN 20-30*(x-1) ELSE -10+50*(x-2)/3 END,6) AS y FROM x")
def linear_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs, ys = (F.array(*(F.lit(float(v)) for v in values)) for values in ((0, 1, 2, 5), (10, 20, -10, 40)))
    x = F.col("id") / 4.0
    return spark.range(-4, 30).select(x.alias("x"), r6(select.interpolate(x, xs, ys)).alias("y"))


@query("series", f"{_CALENDAR}, k AS (SELECT stn, min(d) AS d0 FROM series GROUP BY stn) SELECT p.d, count(value) AS present, count(*)-count(value) AS missing, count(*) FILTER (WHERE d0<=p.d) AS started, count(*) AS stations FROM panel p JOIN k ON k.stn=p.stn GROUP BY p.d")
def availability_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.availability(series.reindex(adapt.series(spark, sf_dir)), "d")
