"""Views that give the driver's tables the shapes of hydrological data, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.session import ship

#: SQL of each view; both engines agree on it. Literals like 1e0 are doubles in both.
VIEWS = {
    "stations": "SELECT s_suppkey AS stn, CAST((s_suppkey*7919) % 1009 AS DOUBLE) AS x, CAST((s_suppkey*104729) % 997 AS DOUBLE) AS y, s_acctbal AS z FROM supplier",
    "obs": "SELECT l_suppkey AS stn, CAST(l_shipdate AS DATE) AS d, SUM(l_quantity) AS value FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)",
    "obs_month": "SELECT l_suppkey AS stn, YEAR(l_shipdate)*12+MONTH(l_shipdate) AS m, AVG(l_quantity) AS value FROM lineitem GROUP BY l_suppkey, YEAR(l_shipdate)*12+MONTH(l_shipdate)",
    "series": "SELECT user_id AS stn, CAST(ts AS DATE) AS d, AVG(value) AS value FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "forcing": "SELECT user_id % 5 AS basin, CAST(ts AS DATE) AS d, AVG(value)/5-8 AS temp, SUM(value)/500 AS prec, 1e0+2e-1*(DAYOFYEAR(CAST(ts AS DATE)) % 7) AS pet, 5e-1+AVG(value)/100 AS q_obs FROM events GROUP BY user_id % 5, CAST(ts AS DATE)",
    "cells": "SELECT CAST(FLOOR(p_partkey/50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, p_retailprice AS value, p_size AS cls FROM part",
    "field": "SELECT CAST(ts AS DATE) AS t, user_id % 20 AS pt, AVG(value) AS value FROM events GROUP BY CAST(ts AS DATE), user_id % 20",
}


def sql(views: str, body: str) -> str:
    """body (a SELECT, or more common table expressions and a SELECT) with views in front."""
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    join = ", " if not body.lstrip().upper().startswith("SELECT") and heads else " "
    return f"WITH RECURSIVE {heads}{join}{body}" if heads else f"WITH RECURSIVE {body}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("stn"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 997).cast("double").alias("y"), F.col("s_acctbal").alias("z"))


def obs(spark: SparkSession, sf_dir: str, by_station: bool = False) -> DataFrame:
    """by_station: in partitions of whole stations, of a number that Spark keeps, so that sums and what follows by station need no other shuffle
    and a task holds little."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stn"), F.to_date("l_shipdate").alias("d"), "l_quantity")
    if by_station:
        rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "stn")
    return rows.groupBy("stn", "d").agg(F.sum("l_quantity").alias("value"))


def obs_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stn"), month.alias("m"), "l_quantity")
    return rows.groupBy("stn", "m").agg(F.avg("l_quantity").alias("value"))


def steady_mean(value: str) -> Column:
    """The mean of numbers with up to 18 decimals from their exact sum, so that equal means are equal however rows are dealt
    to tasks; the plain mean where some number isn't exact as a decimal."""
    exact = F.col(value).try_cast("decimal(38,18)")
    exact = F.when(exact.cast("double") == F.col(value), exact)
    total, n = F.try_sum(exact).cast("double"), F.count(value)
    return F.when((F.count(exact) == n) & total.isNotNull(), F.try_divide(total, n)).otherwise(F.avg(value))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("stn"), F.to_date("ts").alias("d"), "value")
    return rows.groupBy("stn", "d").agg(steady_mean("value").alias("value"))


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("basin"), F.to_date("ts").alias("d"), "value").groupBy("basin", "d")
    out = rows.agg((F.avg("value") / 5 - 8).alias("temp"), (F.sum("value") / 500).alias("prec"), (F.avg("value") / 100 + 0.5).alias("q_obs"))
    return out.select("basin", "d", "temp", "prec", (1.0 + 0.2 * (F.dayofyear("d") % 7)).alias("pet"), "q_obs")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("r"), (k % 50).cast("int").alias("c"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("cls"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.to_date("ts").alias("t"), (F.col("user_id") % 20).alias("pt"), "value")
    return rows.groupBy("t", "pt").agg(F.avg("value").alias("value"))
