"""Queries on circulation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia import adapt
from fluvia.operators import patterns
from fluvia.plans.registry import query, r6

CPS, CLASSES, NONE = 6, 4, 99
# Triangles of the fuzzy numbers.
NUMBERS = [(0, 0.0, 0.0, 0.4), (1, 0.2, 0.4, 0.6), (2, 0.4, 0.6, 0.8), (3, 0.6, 1.0, 1.0)]

_RULES = f"rules AS (SELECT CAST(cp AS INT) AS cp, CAST(pt AS INT) AS pt, CAST((cp*7+pt*3)%5 AS INT) AS cls FROM range({CPS}) a(cp), range(20) b(pt) WHERE (cp*7+pt*3)%5<4), nums(cls,a,b,c) AS (VALUES {','.join(f'({k},{a}e0,{b}e0,{c}e0)' for k, a, b, c in NUMBERS)})"
_ANOM = f"{_RULES}, an AS (SELECT t, pt, (value-min(value) OVER (PARTITION BY t))/(max(value) OVER (PARTITION BY t)-min(value) OVER (PARTITION BY t)) AS v FROM field)"
_MU = f"{_ANOM}, mu AS (SELECT t, cp, an.pt, r.cls, CASE WHEN v=b THEN 1e0 WHEN v>a AND v<b THEN (v-a)/(b-a) WHEN v>b AND v<c THEN (c-v)/(c-b) ELSE 0e0 END AS mu FROM an JOIN rules r ON r.pt=an.pt JOIN nums n ON n.cls=r.cls)"
_DOF = f"{_MU}, part AS (SELECT t, cp, cls, sqrt(avg(mu*mu)) AS part FROM mu GROUP BY t, cp, cls), dof AS (SELECT t, cp, CASE WHEN count(*)={CLASSES} THEN product(part) ELSE 0e0 END AS dof FROM part GROUP BY t, cp)"
_SEL = f"{_DOF}, sel AS (SELECT t, CASE WHEN max(dof)>1e-5 THEN arg_max(cp, (round(dof,12), -cp)) ELSE {NONE} END AS cp FROM dof GROUP BY t)"
_COND = f"{_SEL}, rain AS (SELECT stn, d AS t, value FROM series), j AS (SELECT rain.*, cp FROM rain JOIN sel ON sel.t=rain.t), ins AS (SELECT stn, cp, count(*) AS n, avg(value) AS mean, avg(CASE WHEN value>=4e1 THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN value>=6e1 THEN 1e0 ELSE 0e0 END) AS p1 FROM j GROUP BY stn, cp), al AS (SELECT stn, count(*) AS total, avg(value) AS overall, avg(CASE WHEN value>4e1 THEN 1e0 ELSE 0e0 END) AS q0, avg(CASE WHEN value>6e1 THEN 1e0 ELSE 0e0 END) AS q1 FROM j GROUP BY stn), co AS (SELECT ins.*, total, overall, q0, q1, greatest(1e-100, mean/overall) AS wet FROM ins JOIN al ON al.stn=ins.stn)"


def settings(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    grid = spark.range(CPS).select(F.col("id").cast("int").alias("cp"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pt"))
    cls = (F.col("cp") * 7 + F.col("pt") * 3) % 5
    return grid.select("cp", "pt", cls.alias("cls")).where(F.col("cls") < CLASSES), spark.createDataFrame(NUMBERS, "cls int, a double, b double, c double")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.anomaly(adapt.field(spark, sf_dir))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.fulfilment(patterns.memberships(scaled(spark, sf_dir), *settings(spark)), CLASSES, 2)


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.select_pattern(degrees(spark, sf_dir), NONE)


def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.conditional(chosen(spark, sf_dir), adapt.series(spark, sf_dir).withColumnRenamed("d", "t"), [40.0, 60.0])


@query("field", f"{_ANOM} SELECT t, pt, round(v,6) AS value FROM an")
def cp_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).withColumn("value", r6("value"))


@query("field", f"{_MU} SELECT t, cp, pt, cls, round(mu,6) AS mu FROM mu")
def cp_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.memberships(scaled(spark, sf_dir), *settings(spark)).withColumn("mu", r6("mu"))


@query("field", f"{_DOF} SELECT t, cp, round(dof,6) AS dof FROM dof")
def cp_dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(spark, sf_dir).withColumn("dof", r6("dof"))


@query("field", f"{_SEL} SELECT t, cp FROM sel")
def cp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir)


@query("field", f"{_SEL} SELECT cp, count(*) AS n, round(100e0*count(*)/(SELECT count(*) FROM sel),2) AS share FROM sel GROUP BY cp")
def cp_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.frequency(chosen(spark, sf_dir))


@query("field", f"{_SEL} SELECT cp, pt, round(avg(v),6) AS value FROM an JOIN sel ON sel.t=an.t GROUP BY cp, pt")
def cp_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.composite(chosen(spark, sf_dir), scaled(spark, sf_dir)).withColumn("value", r6("value"))


@query("field series", f"{_COND} SELECT stn, cp, n, round(wet,6) AS wet FROM co")
def cp_wetness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.wetness(conditional(spark, sf_dir)).select("stn", "cp", "n", r6("wet").alias("wet"))


@query("field series", f"{_COND} SELECT stn, round(sqrt(sum(n*(p0-q0)*(p0-q0))/first(total)),6) AS i1, round(sqrt(sum(n*(p1-q1)*(p1-q1))/first(total)),6) AS i2, round(sum(abs(wet-1)*n)/first(total),6) AS i3, round(sum(abs(ln(wet))*n)/first(total),6) AS i4 FROM co GROUP BY stn")
def cp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = patterns.quality(conditional(spark, sf_dir))
    return made.select("stn", *(r6(c).alias(c) for c in ("i1", "i2", "i3", "i4")))


@query("field series", f"{_COND}, ob AS (SELECT stn, sqrt(sum(n*(p0-q0)*(p0-q0))/first(total))+sqrt(sum(n*(p1-q1)*(p1-q1))/first(total)) AS o1, sum(n*abs(mean/overall-1))/first(total) AS o3, sum(n*(mean-overall)*(mean-overall))/first(total) AS o6 FROM co GROUP BY stn) SELECT round(sum(o1),5) AS o1, round(sum(o3),5) AS o3, round(sum(o6),4) AS o6 FROM ob")
def cp_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = patterns.objectives(conditional(spark, sf_dir), 2)
    return made.select(F.round("shares", 5).alias("o1"), F.round("ratios", 5).alias("o3"), F.round("squares", 4).alias("o6"))


def _sql_conditional(name: str, first: float, second: float) -> str:
    """Common table expressions like those of _COND for the values of another table, their names ending in its own."""
    j = f"j_{name} AS (SELECT w.*, cp FROM {name} w JOIN sel ON sel.t=w.t)"
    ins = f"ins_{name} AS (SELECT stn, cp, count(*) AS n, avg(value) AS mean, avg(CASE WHEN value>={first} THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN value>={second} THEN 1e0 ELSE 0e0 END) AS p1 FROM j_{name} GROUP BY stn, cp)"
    al = f"al_{name} AS (SELECT stn, count(*) AS total, avg(value) AS overall, avg(CASE WHEN value>{first} THEN 1e0 ELSE 0e0 END) AS q0, avg(CASE WHEN value>{second} THEN 1e0 ELSE 0e0 END) AS q1 FROM j_{name} GROUP BY stn)"
    ob = f"ob_{name} AS (SELECT sum(a) AS shares, sum(b) AS ratios, sum(c) AS squares FROM (SELECT i.stn, sqrt(sum(n*(p0-q0)*(p0-q0))/first(total))+sqrt(sum(n*(p1-q1)*(p1-q1))/first(total)) AS a, sum(n*abs(mean/overall-1))/first(total) AS b, sum(n*(mean-overall)*(mean-overall))/first(total) AS c FROM ins_{name} i JOIN al_{name} a ON a.stn=i.stn GROUP BY i.stn))"
    return ", ".join((j, ins, al, ob))


_OTHERS = f"""{_SEL}, rain AS (SELECT stn, d AS t, value FROM series), cats AS (SELECT stn % 4 AS stn, t, avg(value) AS value FROM rain GROUP BY 1, 2),
wet AS (SELECT stn % 3 AS stn, t, avg(CASE WHEN value>4e1 THEN 1e0 ELSE 0e0 END) AS value FROM rain GROUP BY 1, 2),
ww AS (SELECT t, max(value) FILTER (WHERE stn=0) AS a, max(value) FILTER (WHERE stn=1) AS b, max(value) FILTER (WHERE stn=2) AS c FROM wet GROUP BY t),
two AS (SELECT 0 AS stn, t, CASE WHEN a+b-2*a*b<45e-2 THEN 0e0 ELSE a+b-2*a*b END AS value FROM ww), three AS (SELECT 0 AS stn, t, a+b+c+(a+b-c+1)+(b+c-a+1)+(a+c-b+1) AS value FROM ww),
lor AS (SELECT stn, t, sum(value) OVER (PARTITION BY t ORDER BY stn)/sum(value) OVER (PARTITION BY t) AS value FROM cats),
{_sql_conditional('rain', 40.0, 60.0)}, {_sql_conditional('cats', 45.0, 55.0)}, {_sql_conditional('wet', 0.5, 0.7)}, {_sql_conditional('two', 0.5, 0.7)}, {_sql_conditional('three', 0.5, 0.7)}, {_sql_conditional('lor', 0.5, 0.7)},
pt AS (SELECT a.shares AS o1, b.shares AS o2, a.ratios AS o3, c.shares AS o4, b.ratios AS o5, d.squares AS o6, e.squares AS o7, f.ratios AS o8 FROM ob_rain a, ob_cats b, ob_wet c, ob_two d, ob_three e, ob_lor f), fr AS (SELECT cp, count(*)/(SELECT count(*) FROM sel)::DOUBLE AS share FROM sel WHERE cp<{CPS} GROUP BY cp), la AS (SELECT sum(greatest(0e0,15e-2-share))+({CPS}-count(*))*15e-2 AS lack FROM fr)"""


def wetness_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The series that the eight objectives read."""
    from pyspark.sql import Window

    rain = adapt.series(spark, sf_dir).withColumnRenamed("d", "t")
    cats = rain.groupBy((F.col("stn") % 4).alias("stn"), "t").agg(F.avg("value").alias("value"))
    wet = rain.groupBy((F.col("stn") % 3).alias("stn"), "t").agg(F.avg(F.when(F.col("value") > 40, 1.0).otherwise(0.0)).alias("value"))
    wide = wet.groupBy("t").pivot("stn", [0, 1, 2]).agg(F.max("value")).toDF("t", "a", "b", "c")
    two = wide.select(F.lit(0).alias("stn"), "t", patterns.wet_pair(F.col("a"), F.col("b"), 0.45).alias("value"))
    three = wide.select(F.lit(0).alias("stn"), "t", patterns.wet_three(*map(F.col, "abc")).alias("value"))
    step = Window.partitionBy("t")
    lorenz = cats.select("stn", "t", (F.sum("value").over(step.orderBy("stn")) / F.sum("value").over(step)).alias("value"))
    return {"rain": rain, "cats": cats, "wet": wet, "two": two, "three": three, "lor": lorenz}


@query("field series", f"{_OTHERS} SELECT round(o2,5) AS o2, round(o4,5) AS o4, round(o5,5) AS o5, round(o6,5) AS o6, round(o7,5) AS o7, round(o8,5) AS o8, round(o1+o2+o3+o4+o5+o6+o7+o8,4) AS total, round((o1+o2+o3+o4+o5+o6+o7+o8)*(1-2*lack),4) AS objective FROM pt, la")
def cp_objectives_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight, their sum, and the sum less the penalty for rare patterns."""
    sel, limits = chosen(spark, sf_dir), {"rain": [40.0, 60.0], "cats": [45.0, 55.0]}
    one = None
    for name, table in wetness_tables(spark, sf_dir).items():
        part = patterns.objectives(patterns.conditional(sel, table, limits.get(name, [0.5, 0.7])), 2).toDF(*(f"{name}_{c}" for c in ("shares", "ratios", "squares")))
        one = part if one is None else one.crossJoin(F.broadcast(part))  # one row each
    names = {"o1": "rain_shares", "o2": "cats_shares", "o3": "rain_ratios", "o4": "wet_shares", "o5": "cats_ratios", "o6": "two_squares", "o7": "three_squares", "o8": "lor_ratios"}
    one = one.select(*(F.col(c).alias(k) for k, c in names.items())).withColumn("total", sum((F.col(k) for k in list(names)[1:]), F.col("o1")))
    counts = patterns.frequency(sel).select("cp", "n").crossJoin(F.broadcast(one))
    final = patterns.penalised(F.col("total"), counts, CPS, 0.15, 2.0)
    return one.crossJoin(F.broadcast(final)).select(*(F.round(k, 5).alias(k) for k in names if k not in ("o1", "o3")), F.round("total", 4).alias("total"), F.round("objective", 4).alias("objective"))


@query("field series", f"{_SEL}, gen AS (SELECT g.g AS gen, t, CASE WHEN cp={NONE} THEN {NONE} ELSE (cp+g.g*(1+dayofmonth(t) % 2)) % {CPS} END AS cp FROM sel, (SELECT unnest(range(4)) AS g) g), j AS (SELECT gen, s.stn, s.value, cp FROM series s JOIN gen ON gen.t=s.d), ins AS (SELECT gen, stn, cp, count(*) AS n, avg(value) AS mean, avg(CASE WHEN value>=4e1 THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN value>=6e1 THEN 1e0 ELSE 0e0 END) AS p1 FROM j GROUP BY ALL), al AS (SELECT gen, stn, count(*) AS total, avg(value) AS overall, avg(CASE WHEN value>4e1 THEN 1e0 ELSE 0e0 END) AS q0, avg(CASE WHEN value>6e1 THEN 1e0 ELSE 0e0 END) AS q1 FROM j GROUP BY ALL), o AS (SELECT gen, i.stn, sqrt(sum(n*(p0-q0)*(p0-q0))/first(total))+sqrt(sum(n*(p1-q1)*(p1-q1))/first(total)) AS a, sum(n*abs(mean/overall-1))/first(total) AS b FROM ins i JOIN al USING (gen, stn) GROUP BY gen, i.stn) SELECT CAST(gen AS INT) AS gen, round(sum(a),5) AS o1, round(sum(b),5) AS o3 FROM o GROUP BY gen")
def cp_score_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of four classifications at once."""
    many = chosen(spark, sf_dir).withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(3))))
    turned = (F.col("cp") + F.col("gen") * (1 + F.dayofmonth("t") % 2)) % CPS
    many = many.select("gen", "t", F.when(F.col("cp") == NONE, NONE).otherwise(turned).alias("cp"))
    rows = patterns.conditional(many, adapt.series(spark, sf_dir).withColumnRenamed("d", "t"), [40.0, 60.0], ("gen",))
    return patterns.objectives(rows, 2, ("gen",)).select("gen", F.round("shares", 5).alias("o1"), F.round("ratios", 5).alias("o3"))


@query("field series", f"{_SEL}, j AS (SELECT CASE WHEN dayofmonth(s.d)<=20 THEN 'calibration' ELSE 'validation' END AS period, s.stn, s.value, cp FROM series s JOIN sel ON sel.t=s.d), ins AS (SELECT period, stn, cp, count(*) AS n, avg(value) AS mean, avg(CASE WHEN value>=4e1 THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN value>=6e1 THEN 1e0 ELSE 0e0 END) AS p1 FROM j GROUP BY ALL), al AS (SELECT period, stn, count(*) AS total, avg(value) AS overall, avg(CASE WHEN value>4e1 THEN 1e0 ELSE 0e0 END) AS q0, avg(CASE WHEN value>6e1 THEN 1e0 ELSE 0e0 END) AS q1 FROM j GROUP BY ALL) SELECT period, i.stn, round(sqrt(sum(n*(p0-q0)*(p0-q0))/first(total)),6) AS i1, round(sqrt(sum(n*(p1-q1)*(p1-q1))/first(total)),6) AS i2, round(sum(abs(greatest(1e-100,mean/overall)-1)*n)/first(total),6) AS i3 FROM ins i JOIN al USING (period, stn) GROUP BY period, i.stn")
def cp_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules judged on two periods."""
    periods = chosen(spark, sf_dir).withColumn("period", F.when(F.dayofmonth("t") <= 20, "calibration").otherwise("validation"))
    rows = patterns.conditional(periods, adapt.series(spark, sf_dir).withColumnRenamed("d", "t"), [40.0, 60.0], ("period",))
    return patterns.quality(rows, ("period",)).select("period", "stn", *(r6(c).alias(c) for c in ("i1", "i2", "i3")))


@query()
def cp_anneal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = adapt.series(spark, sf_dir).withColumnRenamed("d", "t")
    return patterns.anneal(scaled(spark, sf_dir), rain, NUMBERS, CPS, [40.0, 60.0], chains=2, iterations=600)
