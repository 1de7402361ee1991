"""Fixed values of single functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from fluvia.functions import evapo, normal, stats, variogram
from fluvia.operators import geostat, runoff, spatial
from fluvia.sources import tables
from fluvia.streaming import resample


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_normal(spark):
    got = one(spark, *(normal.ppf(F.lit(p)) for p in (0.975, 0.5, 0.1)), normal.cdf(F.lit(1.96)), normal.cdf(F.lit(-1.0)))
    assert got == pytest.approx((1.959964001, 1.5646e-8, -1.281551562, 0.975002107, 0.158655261), abs=1e-8)


def test_evapotranspiration(spark):
    t = evapo.hargreaves(F.lit(180), F.lit(48.5), F.lit(10.0), F.lit(24.0), F.lit(17.0))
    assert one(spark, t)[0] == pytest.approx(5.079763498, abs=1e-8)
    assert one(spark, evapo.oudin(F.lit(15.0), F.to_date(F.lit("2015-07-01")), F.lit(0.85)))[0] == pytest.approx(0.003672999, abs=1e-8)


def test_skill(spark):
    rows = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.2, 3.7, 5.4], strict=True)), "o double, s double")
    o, s = F.col("o"), F.col("s")
    assert tuple(rows.agg(stats.nash_sutcliffe(o, s), stats.log_nash_sutcliffe(o, s), stats.kling_gupta(o, s)).first()) == pytest.approx((0.969, 0.982741289, 0.959809612), abs=1e-8)


def test_inverse_distance(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 4.0, 4.0), (2, 3.0, 0.0), (2, 5.0, 0.0), (2, 9.0, 1.0)], "g int, value double, dist double")
    got = {r["g"]: r["value"] for r in spatial.idw(rows, ["g"], 2).collect()}
    assert got[1] == pytest.approx(4 / 3) and got[2] == 4.0


def test_kriging(spark):
    points = [(0, 0, 53.0), (0, 5, 62.0), (5, 5, 52.0), (5, 0, 23.5)]
    near = [(float(x), float(y), v, float(x + y)) for x, y, v in points]
    kind = "id int, x double, y double, drift double, near array<struct<x:double,y:double,value:double,drift:double>>"
    df = spark.createDataFrame([(1, 2.5, 2.5, 5.0, near), (2, 0.0, 0.0, 0.0, near), (3, 1.0, 1.0, 1.0, []), (4, 1.0, 1.0, 1.0, near[:1] * 2)], kind)
    model = variogram.parse("0.9 Sph(50)")
    rows = {r["id"]: r for r in geostat.krige(df, model).collect()}
    assert rows[1]["weights"] == pytest.approx(1) and rows[2]["estimate"] == pytest.approx(53) and rows[2]["variance"] == pytest.approx(0, abs=1e-9)
    assert rows[3]["status"] == "empty" and rows[4]["status"] == "singular"


def test_variogram_models(spark):
    model = variogram.parse("1.0 Nug(0) + 0.9 Sph(50) + 2 Exp(10) + 1 Gau(20) + 0.5 Lin(30) + 0.1 Pow(0.5) + 1 Hol(8)")
    h = [0.0, 1.0, 7.5, 30.0, 80.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in h], "h double").select(variogram.gamma(F.col("h"), model)).collect()]
    assert got == pytest.approx(list(variogram.gamma_array(__import__("numpy").array(h), model)))
    assert got[0] == 0 and variogram.parse(variogram.format_model(model)) == model
    with pytest.raises(ValueError):
        variogram.parse("1 Foo(2)")


def test_routing_and_bucket_model(spark):
    flows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 4, 9, 6, 3, 2, 1])], "b int, t int, q double")
    out = [r["outflow"] for r in runoff.muskingum(flows, "b", "t", "q", 2.0, 0.2).orderBy("t").collect()]
    assert out == pytest.approx([1, 1.142857, 2.741497, 5.578879, 5.636556, 4.333434, 3.174656], abs=1e-6)
    rows = [(1, i, float(t), float(p), float(e)) for i, (t, p, e) in enumerate(zip([-2, 1, 5, 8, 6], [5, 3, 0, 12, 4], [0.5, 0.8, 1.5, 2, 1.8], strict=True))]
    made = runoff.lumped(spark.createDataFrame(rows, "b int, t int, temp double, prec double, pet double"), "b", "t", runoff.Bucket()).orderBy("t").collect()
    assert [r["discharge"] for r in made] == pytest.approx([0.86, 0.7442, 0.7971376, 0.79378576, 1.131742463], abs=1e-8)
    assert (made[-1]["snow"], made[-1]["moisture"], made[-1]["upper"], made[-1]["lower"]) == pytest.approx((0, 55.929437167, 3.93465888, 8.752761671), abs=1e-8)


def test_tables(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date;a; b \n2020-01-01;1.5;\n2020-01-02;nan;2\n")
    rows = {(r["stn"], str(r["t"])[:10]): r["value"] for r in tables.read_wide(spark, f"file://{tmp_path}/w.csv").collect()}
    assert rows == {("a", "2020-01-01"): 1.5, ("b", "2020-01-01"): None, ("a", "2020-01-02"): None, ("b", "2020-01-02"): 2.0}
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "r int, c int, value double")
    lines = [r["text"] for r in tables.ascii_grid_lines(cells, 10.0, 20.0, 5.0).orderBy("line").collect()]
    (tmp_path / "g.asc").write_text("\n".join(lines) + "\n")
    back = {(r["r"], r["c"]): (r["x"], r["y"], r["value"]) for r in tables.read_ascii_grid(spark, f"file://{tmp_path}/g.asc").collect()}
    assert back == {(0, 0): (12.5, 27.5, 1.0), (0, 1): (17.5, 27.5, None), (1, 0): (12.5, 22.5, 3.0), (1, 1): (17.5, 22.5, 4.0)}


def test_daily_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01 03:00:00", 2.0), (1, "2020-01-01 09:00:00", 4.0), (2, "2020-01-02 00:00:00", 1.0)], "stn int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = resample.daily_means(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["stn"], str(r["d"]), r["value"], r["n"]) for r in spark.table("daily").collect())
    assert got == [(1, "2020-01-01", 3.0, 2), (2, "2020-01-02", 1.0, 1)] and not math.isnan(got[0][2])
