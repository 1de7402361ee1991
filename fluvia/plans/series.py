"""Queries on station series, ranks and copulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia import adapt
from fluvia.functions import normal, stats
from fluvia.operators import copula, infill, series, spatial
from fluvia.plans.registry import query, r6

BINS = 5
_CALENDAR = "cal AS (SELECT s.stn, CAST(g.d AS DATE) AS d FROM (SELECT DISTINCT stn FROM series) s, (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM series) g), panel AS (SELECT c.stn, c.d, v.value FROM cal c LEFT JOIN series v ON v.stn=c.stn AND v.d=c.d)"
_RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY stn ORDER BY value) + (count(*) OVER (PARTITION BY stn, value) - 1)/2e0 AS mr, count(*) OVER (PARTITION BY stn ORDER BY value RANGE UNBOUNDED PRECEDING) AS tr, count(*) OVER (PARTITION BY stn) AS n FROM {0})"


@query("series", f"{_CALENDAR} SELECT stn, d, round(coalesce(value, round(avg(value) OVER (PARTITION BY stn), 2)), 6) AS value FROM panel")
def resample_daily_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_with_mean(series.reindex(adapt.series(spark, sf_dir))).select("stn", "d", r6("value").alias("value"))


@query("series", f"{_CALENDAR} SELECT stn, d, round(value, 6) AS value, value IS NULL AS missing FROM panel")
def calendar_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.reindex(adapt.series(spark, sf_dir)).select("stn", "d", r6("value").alias("value"), F.isnull("value").alias("missing"))


@query("obs_month", "SELECT m, round(avg(value) FILTER (WHERE stn % 4 = 0), 6) AS g0, round(avg(value) FILTER (WHERE stn % 4 = 1), 6) AS g1, round(avg(value) FILTER (WHERE stn % 4 = 2), 6) AS g2, round(avg(value) FILTER (WHERE stn % 4 = 3), 6) AS g3 FROM obs_month GROUP BY m")
def unpivot_pivot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = adapt.obs_month(spark, sf_dir).withColumn("g", F.col("stn") % 4).groupBy("m").pivot("g", [0, 1, 2, 3]).agg(F.avg("value")).toDF("m", "g0", "g1", "g2", "g3")
    long = wide.unpivot("m", ["g0", "g1", "g2", "g3"], "g", "value")
    again = long.groupBy("m").pivot("g", ["g0", "g1", "g2", "g3"]).agg(F.first("value"))
    return again.select("m", *(r6(c).alias(c) for c in ("g0", "g1", "g2", "g3")))


@query("series", "SELECT stn, d, round(value, 6) AS value FROM series WHERE stn IN (SELECT stn FROM series GROUP BY stn HAVING count(value) >= 27)")
def min_valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_enough_values(adapt.series(spark, sf_dir), 27).select("stn", "d", r6("value").alias("value"))


@query("series", "SELECT a.stn AS a, b.stn AS b, count(*) AS n FROM series a JOIN series b ON a.d=b.d AND a.stn<b.stn GROUP BY a.stn, b.stn")
def complete_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlations(adapt.series(spark, sf_dir), "d").select("a", "b", "n")


@query("obs", "SELECT stn, round(min(value),6) AS low, round(max(value),6) AS high, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS sd, round(stddev_samp(value)/avg(value),6) AS cov, round(skewness(value),6) AS skew, count(value) AS n FROM obs GROUP BY stn")
def station_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    made = {"low": F.min(v), "high": F.max(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "cov": stats.variation(v), "skew": stats.sample_skewness(v)}
    return adapt.obs(spark, sf_dir).groupBy("stn").agg(*(r6(c).alias(k) for k, c in made.items()), F.count(v).alias("n"))


@query("series", f"{_CALENDAR} SELECT d, count(value) AS present, count(*) - count(value) AS missing, count(*) AS stations, round(count(value)/CAST(count(*) AS DOUBLE), 6) AS share FROM panel GROUP BY d")
def availability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count("value")
    return series.reindex(adapt.series(spark, sf_dir)).groupBy("d").agg(k.alias("present"), (n - k).alias("missing"), n.alias("stations"), r6(k / n).alias("share"))


@query("obs_month", f"{_RANKED.format('obs_month')} SELECT stn, m, round(mr, 6) AS mean_rank, tr AS top_rank, round(mr/(n+1), 6) AS p FROM ranked")
def plotting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.plotting_positions(adapt.obs_month(spark, sf_dir)).select("stn", "m", r6("mean_rank").alias("mean_rank"), "top_rank", r6("p").alias("p"))


@query("obs", "q AS (SELECT *, avg(CASE WHEN value<=15 THEN 1e0 ELSE 0e0 END) OVER w AS p0, avg(CASE WHEN value<=25 THEN 1e0 ELSE 0e0 END) OVER w AS p1, count(*) FILTER (WHERE value>25) OVER w AS m, rank() OVER (PARTITION BY stn, value>25 ORDER BY value)+(count(*) OVER (PARTITION BY stn, value)-1)/2e0 AS r FROM obs WINDOW w AS (PARTITION BY stn)) SELECT stn, d, round(CASE WHEN value>25 THEN p1+(1-p1)*r/(m+1) WHEN value<=15 THEN p0/2 ELSE (p0+p1)/2 END, 6) AS p FROM q")
def precip_mixed_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mixed_probabilities(adapt.obs(spark, sf_dir, by_station=True), 15, 25).select("stn", "d", r6("p").alias("p"))


@query("obs_month", f"{_RANKED.format('obs_month')} SELECT stn, m, round({normal.ppf_sql('(mr/(n+1))')}, 6) AS score FROM ranked")
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.plotting_positions(adapt.obs_month(spark, sf_dir)).select("stn", "m", r6(normal.ppf(F.col("p"))).alias("score"))


@query("obs_month", "SELECT a.stn AS a, b.stn AS b, round(corr(a.value, b.value), 6) AS rho, count(*) AS n FROM obs_month a JOIN obs_month b ON a.m=b.m AND a.stn<b.stn GROUP BY a.stn, b.stn")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlations(adapt.obs_month(spark, sf_dir), "m").select("a", "b", r6("rho").alias("rho"), "n")


@query("obs_month", "j AS (SELECT a.stn AS a, b.stn AS b, a.value AS va, b.value AS vb FROM obs_month a JOIN obs_month b ON a.m=b.m AND a.stn<b.stn), k AS (SELECT a, b, rank() OVER (PARTITION BY a,b ORDER BY va)+(count(*) OVER (PARTITION BY a,b,va)-1)/2e0 AS ra, rank() OVER (PARTITION BY a,b ORDER BY vb)+(count(*) OVER (PARTITION BY a,b,vb)-1)/2e0 AS rb FROM j), c AS (SELECT a, b, corr(ra,rb) AS rho, count(*) AS n FROM k GROUP BY a,b HAVING count(*)>20), u AS (SELECT a AS stn, b AS neighbour, rho, n FROM c WHERE abs(rho)>=0.05 UNION ALL SELECT b, a, rho, n FROM c WHERE abs(rho)>=0.05), p AS (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY round(abs(rho),9) DESC, neighbour) AS place FROM u) SELECT stn, neighbour, round(rho,6) AS rho, n, place FROM p WHERE place<=5")
def rank_corr_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlated_neighbours(adapt.obs_month(spark, sf_dir), "m", 5, 0.05, 20).withColumn("rho", r6("rho"))


def pairs_with_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stn, m, u, v): positions of a station's values and of the mean over all stations in the same months."""
    obs = adapt.obs_month(spark, sf_dir)
    mean = obs.groupBy("m").agg(F.avg("value").alias("mean"))
    both = obs.join(mean, "m")
    n = F.count(F.lit(1)).over(Window.partitionBy("stn")) + 1
    return both.select("stn", "m", (series.average_rank(F.col("value"), "stn") / n).alias("u"), (series.average_rank(F.col("mean"), "stn") / n).alias("v"))


_UV = "mm AS (SELECT m, avg(value) AS mean FROM obs_month GROUP BY m), jj AS (SELECT o.stn, o.m, o.value, mm.mean FROM obs_month o JOIN mm ON o.m=mm.m), uv AS (SELECT stn, m, (rank() OVER (PARTITION BY stn ORDER BY value)+(count(*) OVER (PARTITION BY stn,value)-1)/2e0)/(count(*) OVER (PARTITION BY stn)+1) AS u, (rank() OVER (PARTITION BY stn ORDER BY mean)+(count(*) OVER (PARTITION BY stn,mean)-1)/2e0)/(count(*) OVER (PARTITION BY stn)+1) AS v FROM jj)"
_GRID = f"{_UV}, ax AS (SELECT unnest(range({BINS})) AS i), kk AS (SELECT stn, least(CAST(floor(u*{BINS}) AS INT),{BINS - 1}) AS i, least(CAST(floor(v*{BINS}) AS INT),{BINS - 1}) AS j, count(*) AS k FROM uv GROUP BY 1,2,3), nn AS (SELECT stn, count(*) AS n FROM uv GROUP BY stn), grid AS (SELECT nn.stn, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, coalesce(kk.k,0)*{BINS * BINS}e0/nn.n AS density FROM nn, ax a, ax b LEFT JOIN kk ON kk.stn=nn.stn AND kk.i=a.i AND kk.j=b.i)"
_CUM = f"{_GRID}, al AS (SELECT *, sum(density) OVER (PARTITION BY stn,i ORDER BY j)/{BINS * BINS}e0 AS along FROM grid), cu AS (SELECT *, sum(along) OVER (PARTITION BY stn,j ORDER BY i) AS cum FROM al)"


@query("obs_month", f"{_GRID} SELECT stn, i, j, round(density, 6) AS density FROM grid")
def empirical_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copula.density(pairs_with_mean(spark, sf_dir), "stn", BINS).withColumn("density", r6("density"))


@query("obs_month", f"{_CUM} SELECT stn, round(12*sum(cum-(i+1)*(j+1)/{BINS * BINS}e0)/{BINS * BINS}e0,6)+0e0 AS rho, round(4*sum(cum*density)/{BINS * BINS}e0-1,6)+0e0 AS tau FROM cu GROUP BY stn")
def copula_rho_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = copula.density(pairs_with_mean(spark, sf_dir), "stn", BINS)
    return copula.rho_tau(grid, "stn", BINS).select("stn", r6("rho").alias("rho"), r6("tau").alias("tau"))


@query("obs_month", f"{_UV} SELECT stn, round(avg(pow(u+v-1,3)),6) AS a1, round(avg(pow(u-v,3)),6) AS a2 FROM uv GROUP BY stn")
def asymmetry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = copula.asymmetry_of_sample()
    return pairs_with_mean(spark, sf_dir).groupBy("stn").agg(r6(a).alias("a1"), r6(b).alias("a2"))


@query("obs_month", f"{_GRID} SELECT stn, round(sum(density*pow((i+5e-1)/{BINS}+(j+5e-1)/{BINS}-1,3))/{BINS * BINS}e0,9)+0e0 AS a1, round(sum(density*pow((i+5e-1)/{BINS}-(j+5e-1)/{BINS},3))/{BINS * BINS}e0,9)+0e0 AS a2 FROM grid GROUP BY stn")
def asymmetry_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = copula.asymmetry_of_grid(BINS)
    grid = copula.density(pairs_with_mean(spark, sf_dir), "stn", BINS)
    return grid.groupBy("stn").agg((F.round(a, 9) + 0.0).alias("a1"), (F.round(b, 9) + 0.0).alias("a2"))


@query("obs_month", f"{_GRID} SELECT stn, 'u' AS side, i AS k, round(sum(density)/{BINS}e0,6) AS p FROM grid GROUP BY stn, i UNION ALL SELECT stn, 'v', j, round(sum(density)/{BINS}e0,6) FROM grid GROUP BY stn, j")
def cond_cumm_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = copula.density(pairs_with_mean(spark, sf_dir), "stn", BINS)
    side = lambda name, key: grid.groupBy("stn", F.col(key).alias("k")).agg(r6(F.sum("density") / BINS).alias("p")).select("stn", F.lit(name).alias("side"), "k", "p")
    return side("u", "i").union(side("v", "j"))


@query("obs_month", f"{_UV} SELECT a.stn, round(sum(sign(a.u-b.u)*sign(a.v-b.v))/sqrt(sum(abs(sign(a.u-b.u)))*sum(abs(sign(a.v-b.v)))),6) AS tau_b FROM uv a JOIN uv b ON a.stn=b.stn AND a.m<b.m GROUP BY a.stn")
def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copula.kendall_tau_b(pairs_with_mean(spark, sf_dir), "stn").select("stn", r6("tau_b").alias("tau_b"))


_AXIS = "ax AS (SELECT (unnest(range(1, 20)))/20e0 AS p)"


@query("", f"{_AXIS}, s AS (SELECT p, {normal.ppf_sql('p')} AS z FROM ax) SELECT a.p AS u, b.p AS v, round(exp(-5e-1*(6e-1/64e-2)*(6e-1*(a.z*a.z+b.z*b.z)-2*a.z*b.z))/sqrt(64e-2), 6) AS density FROM s a, s b")
def gaussian_copula_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: k / 20.0)
    grid = spark.range(1).select(F.explode(axis).alias("u")).select("u", F.explode(axis).alias("v"))
    return grid.select("u", "v", r6(normal.gaussian_copula(normal.ppf(F.col("u")), normal.ppf(F.col("v")), 0.6)).alias("density"))


@query("", "ax AS (SELECT (unnest(range(-8, 9)))/4e0 AS x) SELECT x, round(CASE WHEN x>=5e-1 THEN 2e0*pow(x-5e-1, 15e-1) ELSE 5e-1-x END, 6) AS y FROM ax")
def vt_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(-8, 9).select((F.col("id") / 4.0).alias("x"))
    return rows.select("x", r6(normal.v_transform(F.col("x"), 0.5, 2.0, 1.5)).alias("y"))


@query("forcing", "c AS (SELECT basin, d, q_obs AS o, prec*0.1e0 AS s FROM forcing) SELECT basin, round(1-sum((o-s)*(o-s))/(count(o)*var_pop(o)),6) AS ns, round(1-sum((ln(o)-ln(s))*(ln(o)-ln(s))) FILTER (WHERE o>0 AND s>0)/((count(*) FILTER (WHERE o>0 AND s>0))*var_pop(ln(o)) FILTER (WHERE o>0 AND s>0)),6) AS ln_ns, round(1-sqrt(pow(corr(o,s)-1,2)+pow(avg(s)/avg(o)-1,2)+pow((stddev_pop(s)/avg(s))/(stddev_pop(o)/avg(o))-1,2)),6) AS kge FROM c GROUP BY basin")
def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = F.col("q_obs"), F.col("prec") * 0.1
    return adapt.forcing(spark, sf_dir).groupBy("basin").agg(r6(stats.nash_sutcliffe(o, s)).alias("ns"), r6(stats.log_nash_sutcliffe(o, s)).alias("ln_ns"), r6(stats.kling_gupta(o, s)).alias("kge"))


@query("obs", "j AS (SELECT stn, d, value AS o, 9e-1*value+2+(stn % 3) AS s, avg(value) OVER (PARTITION BY stn, dayofyear(d)) AS c, avg(ln(value)) OVER (PARTITION BY stn, dayofyear(d)) AS lc FROM obs) SELECT stn, round(1-sum((o-s)*(o-s))/sum((o-c)*(o-c)),5) AS ns_cycle, round(1-sum((ln(o)-ln(s))*(ln(o)-ln(s)))/sum((ln(o)-lc)*(ln(o)-lc)),5) AS ln_ns_cycle FROM j GROUP BY stn")
def skill_vs_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the mean of each day of the year, of values and of logarithms."""
    day = Window.partitionBy("stn", F.dayofyear("d"))
    o = F.col("value")
    rows = adapt.obs(spark, sf_dir).withColumn("value", o.cast("double")).withColumn("s", 0.9 * o + 2 + F.col("stn") % 3).withColumn("c", F.avg("value").over(day)).withColumn("lc", F.avg(F.ln("value")).over(day))
    plain, logs = stats.skill_against(o, F.col("s"), F.col("c")), stats.skill_against(F.ln(o), F.ln("s"), F.col("lc"))
    return rows.groupBy("stn").agg((F.round(plain, 5) + 0.0).alias("ns_cycle"), (F.round(logs, 5) + 0.0).alias("ln_ns_cycle"))


@query("forcing", "c AS (SELECT basin, q_obs AS o, prec*0.1e0 AS s FROM forcing) SELECT basin, round(avg(o-s),6) AS bias, round(avg(abs(o-s)),6) AS mae, round(sqrt(avg((o-s)*(o-s))),6) AS rmse, round(avg(o),6) AS mean_obs, round(var_pop(o),6) AS var_obs, round(avg(s),6) AS mean_sim, round(var_pop(s),6) AS var_sim, round(corr(o,s),6) AS pearson FROM c GROUP BY basin")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = F.col("q_obs"), F.col("prec") * 0.1
    made = {"bias": stats.bias(o, s), "mae": stats.mean_absolute_error(o, s), "rmse": stats.root_mean_square_error(o, s), "mean_obs": F.avg(o), "var_obs": F.var_pop(o), "mean_sim": F.avg(s), "var_sim": F.var_pop(s), "pearson": F.corr(o, s)}
    return adapt.forcing(spark, sf_dir).groupBy("basin").agg(*(r6(c).alias(k) for k, c in made.items()))


@query("obs_month", "p AS (SELECT stn, m, (rank() OVER (PARTITION BY m ORDER BY value)+(count(*) OVER (PARTITION BY m, value)-1)/2e0)/(count(*) OVER (PARTITION BY m)+1) AS p FROM obs_month), k AS (SELECT stn, p, row_number() OVER (PARTITION BY stn ORDER BY p)/(count(*) OVER (PARTITION BY stn)+1e0) AS t, sqrt(-5e-1*ln(25e-3)/count(*) OVER (PARTITION BY stn)) AS b FROM p) SELECT stn, round(100*avg(CASE WHEN p BETWEEN greatest(0,t-b) AND least(1,t+b) THEN 1e0 ELSE 0e0 END),6) AS inside FROM k GROUP BY stn")
def ks_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the positions of a station's values among all stations of the month."""
    n = F.count(F.lit(1)).over(Window.partitionBy("m")) + 1
    rows = adapt.obs_month(spark, sf_dir).withColumn("p", series.average_rank(F.col("value"), "m") / n)
    return infill.ks_share(rows, "stn", "p").withColumn("inside", r6("inside"))


# One neighbour has a closed form, which SQL can check.
_ONE = "nn AS (SELECT a.stn, b.stn AS nb, row_number() OVER (PARTITION BY a.stn ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.stn) AS k FROM stations a JOIN stations b ON a.stn<>b.stn), jn AS (SELECT nn.stn, o.m, o.value AS v, p.value AS w FROM nn JOIN obs_month o ON o.stn=nn.stn JOIN obs_month p ON p.stn=nn.nb AND p.m=o.m WHERE k=1), rk AS (SELECT stn, m, v, count(*) OVER (PARTITION BY stn) AS n, rank() OVER (PARTITION BY stn ORDER BY v)+(count(*) OVER (PARTITION BY stn,v)-1)/2e0 AS rv, rank() OVER (PARTITION BY stn ORDER BY w)+(count(*) OVER (PARTITION BY stn,w)-1)/2e0 AS rw FROM jn), sc AS (SELECT stn, m, v, n, {0} AS zv, {1} AS zw FROM rk), rh AS (SELECT stn, corr(zv,zw) AS rho FROM sc GROUP BY stn)".format(normal.ppf_sql("(rv/(n+1))"), normal.ppf_sql("(rw/(n+1))"))


def nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return spatial.nearest_stations(adapt.stations(spark, sf_dir), k).select(F.col("a").alias("stn"), F.col("b").alias("neighbour"), "place")


@query("stations obs_month", "nn AS (SELECT a.stn, b.stn AS nb, row_number() OVER (PARTITION BY a.stn ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.stn) AS k FROM stations a JOIN stations b ON a.stn<>b.stn), c AS (SELECT nn.stn, nb, k, count(o.stn) AS n, count(*)-count(o.stn) AS free FROM nn JOIN obs_month p ON p.stn=nn.nb LEFT JOIN obs_month o ON o.stn=nn.stn AND o.m=p.m WHERE k<=8 GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY k, nb) AS place FROM c WHERE n>30 AND free>0) SELECT stn, nb AS neighbour, CAST(place AS INT) AS place, n FROM v WHERE place<=4")
def nearest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the eight nearest the four first with enough common months and with some value where the station has none."""
    return series.valid_neighbours(adapt.obs_month(spark, sf_dir), nearest(spark, sf_dir, 8), "m", 4, 30, gaps=True)


@query("obs", "SELECT stn, round(avg(value),2) AS value FROM obs GROUP BY stn")
def station_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mean_values(adapt.obs(spark, sf_dir), "stn")


@query("stations obs_month", f"{_ONE} SELECT sc.stn, m, CAST(n AS INT) AS n_recs, round(rho*zw,6)+0e0 AS mu, round(sqrt(1-rho*rho),6) AS sigma FROM sc JOIN rh ON rh.stn=sc.stn WHERE n>=20 AND rho*rho<1")
def infill_one_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(adapt.obs_month(spark, sf_dir), nearest(spark, sf_dir, 1), "m", infill.Settings(quantiles=False), everywhere=True)
    return made.where("mu is not null and observed is not null").select("stn", "m", "n_recs", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


def discharge(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    obs = adapt.obs_month(spark, sf_dir)
    return infill.infill(obs, series.correlated_neighbours(obs, "m", 4, 0.0, 20).select("stn", "neighbour", "place"), "m", infill.Settings(**more), everywhere=True)


@query()
def infill_discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discharge(spark, sf_dir).drop("density", "draws")


@query()
def infill_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discharge(spark, sf_dir, draws=5).select("stn", "m", "status", "draws")


@query()
def infill_precip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = adapt.series(spark, sf_dir).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - 45))
    near = series.correlated_neighbours(rain, "d", 4, 0.0, 15).select("stn", "neighbour", "place")
    return infill.infill(rain, near, "d", infill.Settings(kind="precipitation", min_valid=15, dry=0.0, damp=1.0)).drop("density", "draws")


@query("series", f"{_CALENDAR}, rain AS (SELECT stn, d, greatest(0e0, value-45) AS value FROM series), j AS (SELECT a.stn AS a, b.stn AS b, a.value AS va, b.value AS vb FROM rain a JOIN rain b ON a.d=b.d AND a.stn<b.stn), k AS (SELECT a, b, rank() OVER (PARTITION BY a,b ORDER BY va)+(count(*) OVER (PARTITION BY a,b,va)-1)/2e0 AS ra, rank() OVER (PARTITION BY a,b ORDER BY vb)+(count(*) OVER (PARTITION BY a,b,vb)-1)/2e0 AS rb FROM j), c AS (SELECT a, b, corr(ra,rb) AS rho FROM k GROUP BY a,b HAVING count(*)>15 AND min(ra)<max(ra) AND min(rb)<max(rb)), u AS (SELECT a AS stn, b AS neighbour, rho FROM c UNION ALL SELECT b, a, rho FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY round(abs(rho),9) DESC, neighbour) AS place FROM u) SELECT g.stn, g.d, CAST(count(r.value) AS INT) AS n_raw, count(r.value)>0 AND coalesce(max(r.value)<=0, false) AS dry FROM panel g LEFT JOIN p ON p.stn=g.stn AND place<=4 LEFT JOIN rain r ON r.stn=p.neighbour AND r.d=g.d WHERE g.value IS NULL GROUP BY g.stn, g.d")
def infill_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with the number of neighbours that have a value, and whether these are all dry."""
    return infill_precip(spark, sf_dir).select("stn", "d", "n_raw", (F.col("status") == "dry").alias("dry"))


@query()
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed values against the conditional quantiles of their neighbours."""
    made = infill.flags(discharge(spark, sf_dir)).where("flag is not null").select("stn", "m", "flag")
    return made.withColumn("flagged", r6(100 * F.avg(F.abs("flag")).over(Window.partitionBy("stn"))))


@query()
def infill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.summary(discharge(spark, sf_dir))


@query()
def copula_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each station's nearest three."""
    obs = adapt.obs_month(spark, sf_dir)
    near = nearest(spark, sf_dir, 3).select(F.col("stn").alias("a"), F.col("neighbour").alias("b"))
    rows = near.join(obs.select(F.col("stn").alias("a"), "m", F.col("value").alias("va")), "a").join(obs.select(F.col("stn").alias("b"), "m", F.col("value").alias("vb")), ["b", "m"])
    return infill.symmetric_pairs(rows.select("a", "b", "va", "vb"))


@query("forcing", "c AS (SELECT basin, q_obs AS o, prec*0.1e0 AS s FROM forcing), k AS (SELECT basin, rank() OVER (PARTITION BY basin ORDER BY o)+(count(*) OVER (PARTITION BY basin,o)-1)/2e0 AS a, rank() OVER (PARTITION BY basin ORDER BY s)+(count(*) OVER (PARTITION BY basin,s)-1)/2e0 AS b FROM c) SELECT basin, round(corr(a,b),6) AS spearman FROM k GROUP BY basin")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.forcing(spark, sf_dir).select("basin", F.col("q_obs").alias("o"), (F.col("prec") * 0.1).alias("s"))
    return infill.spearman(rows, "basin", "o", "s").withColumn("spearman", r6("spearman"))
