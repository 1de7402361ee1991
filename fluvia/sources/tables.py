"""Reading and writing wide station tables and ASCII grids with Spark's own readers and writers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.operators.polygons import RINGS


def read_wide(spark: SparkSession, path: str, time_format: str = "yyyy-MM-dd", sep: str = ";") -> DataFrame:
    """(stn, t, value) of a wide CSV: time in the first column, a column per station; NaN and blanks are null."""
    wide = spark.read.csv(path, sep=sep, header=True)
    time, names = wide.columns[0], wide.columns[1:]
    long = wide.unpivot(F.col(f"`{time}`"), [F.col(f"`{n}`") for n in names], "stn", "value")
    v = F.col("value").try_cast("double")
    return long.select(F.trim("stn").alias("stn"), F.to_timestamp(F.col(f"`{time}`"), time_format).alias("t"), F.when(~F.isnan(v), v).alias("value"))


def read_coordinates(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(stn, x, y, z): columns X, Y and, if there, Z; of repeated stations the last line, rows without X or Y dropped."""
    rows = spark.read.csv(path, sep=sep, header=True)
    stn = rows.columns[0]
    z = F.col("Z").try_cast("double") if "Z" in rows.columns else F.lit(None).cast("double")
    place = F.row_number().over(Window.partitionBy("stn").orderBy(F.desc("line")))
    named = rows.select(F.trim(F.col(f"`{stn}`")).alias("stn"), F.col("X").try_cast("double").alias("x"), F.col("Y").try_cast("double").alias("y"), z.alias("z"), F.monotonically_increasing_id().alias("line"))
    return named.where("x is not null and y is not null").withColumn("p", place).where("p = 1").drop("p", "line")


def write_wide(obs: DataFrame, path: str, stations: list[str], digits: int = 3, sep: str = ";", time_format: str = "yyyy-MM-dd") -> None:
    """A wide CSV of (stn, t, value) for the given stations, with so many decimals and times in a format; nulls are blank."""
    wide = obs.groupBy("t").pivot("stn", stations).agg(F.first("value"))
    number = lambda n: F.when(F.col(f"`{n}`").isNotNull(), F.format_string(f"%.{digits}f", F.col(f"`{n}`").cast("double"))).alias(n)
    wide.select(F.date_format("t", time_format).alias("t"), *map(number, stations)).write.mode("overwrite").csv(path, sep=sep, header=True)


#: Names of the six header lines of an ASCII grid.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, r, c, x, y, value) of ASCII grids; the no-data value becomes null.

    A file may hold many grids one after another, each with its six header lines; block counts them from
    0. Files are read as lines, split by split; lines are numbered within their split, and by what the splits
    before it in the file hold, a row a split. A task holds a split, however large a file.
    """
    text = spark.read.text(path, lineSep="\n")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k")).where("line <> ''")
    words = F.split("line", r"\s+")
    starts = (F.lower(words[0]) == HEADER[0]).cast("int")
    splits = lines.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(starts).alias("s"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_") for c in ("n", "s")))
    order = Window.partitionBy("file", "part").orderBy("k")
    numbered = lines.select("file", "part", F.row_number().over(order).alias("i"), F.sum(starts).over(order).alias("b"), words.alias("words"))
    placed = numbered.join(splits, ["file", "part"]).select("file", (F.col("b") + F.col("s_") - 1).alias("block"), (F.col("i") + F.col("n_")).alias("at"), "words")
    head = F.lower(F.col("words")[0]).isin(*HEADER)
    wide = placed.where(head).select("file", "block", "at", F.lower(F.col("words")[0]).alias("name"), F.col("words")[1].try_cast("double").alias("v")).groupBy("file", "block").agg(F.max("at").alias("last"), *(F.max(F.when(F.col("name") == h, F.col("v"))).alias(h) for h in HEADER))
    body = placed.where(~head).join(wide, ["file", "block"]).withColumn("r", (F.col("at") - F.col("last") - 1).cast("int"))
    cells = body.select("*", F.posexplode("words").alias("c", "v"))
    v, size = F.col("v").try_cast("double"), F.col("cellsize")
    x, y = F.col("xllcorner") + (F.col("c") + 0.5) * size, F.col("yllcorner") + (F.col("nrows") - F.col("r") - 0.5) * size
    return cells.select("file", F.col("block").cast("int").alias("block"), "r", "c", x.alias("x"), y.alias("y"), F.when(v != F.col("nodata_value"), v).alias("value"))


def write_ascii_grid(cells: DataFrame, path: str, x0: float, y0: float, size: float, none: float = -9999.0) -> None:
    """One text file of ascii_grid_lines: the format has one order of lines, so they end in one task; lines are short."""
    lines = ascii_grid_lines(cells, x0, y0, size, none)
    lines.orderBy("line").coalesce(1).select("text").write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(file, param, value) of model parameter files: names in the first column, numbers in the one named value."""
    rows = spark.read.csv(path, sep=sep, header=True)
    name = rows.columns[0]
    return rows.select(F.input_file_name().alias("file"), F.trim(F.col(f"`{name}`")).alias("param"), F.col("value").try_cast("double").alias("value"))


def write_parameters(params: DataFrame, by: str, path: str, sep: str = ";") -> None:
    """A folder of parameter files for each `by`, from a table with a column per parameter."""
    names = [c for c in params.columns if c != by]
    params.unpivot(by, names, "param", "value").write.mode("overwrite").partitionBy(by).csv(path, sep=sep, header=True)


def list_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(path, size, modified) of the files below a folder that end with an extension; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension.lstrip('.')}").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def date_catalogue(files: DataFrame, pattern: str, form: str) -> DataFrame:
    """files with the date that stands in their names: the first group of a pattern, read by a form; others are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    day = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(form)))
    return files.withColumn("d", day).where("d is not null")


def aligned(catalogues: dict[str, DataFrame]) -> DataFrame:
    """(d, a path for each name): the days on which all catalogues (path, d) have a file, with the first path of each by name."""
    made = None
    for name, files in catalogues.items():
        own = files.groupBy("d").agg(F.min("path").alias(name))
        made = own if made is None else made.join(own, "d")
    return made


def new_raster(spark: SparkSession, rows: int, cols: int, value: float | None = None) -> DataFrame:
    """(r, c, value) of a raster of one value, made where its rows are."""
    axis = F.sequence(F.lit(0), F.lit(cols - 1))
    made = spark.range(rows).select(F.col("id").cast("int").alias("r"), F.explode(axis).alias("c"))
    return made.withColumn("value", F.lit(value).cast("double"))


def raster_like(template: DataFrame, values: DataFrame) -> DataFrame:
    """The cells of a template with the values of another table (r, c, value), null where it has none."""
    return template.select("r", "c").join(values.select("r", "c", "value"), ["r", "c"], "left")


def write_cube(field: DataFrame, path: str, time: str, **about: str) -> None:
    """A cube (time, y, x, variables...) as Parquet, a folder per year, its columns' units and the like kept as metadata.

    about: a variable's description by its name; rows are sorted by time within a file, so that slabs of time skip the rest.
    """
    described = field.withMetadata(time, {"calendar": "standard"})
    for name, text in about.items():
        described = described.withMetadata(name, {"description": text})
    described.withColumn("year", F.year(time)).repartition("year").sortWithinPartitions(time).write.mode("overwrite").partitionBy("year").parquet(path)


def read_cube(spark: SparkSession, path: str, time: str, first=None, last=None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A slab of a cube: from first to last and within (x0, x1, y0, y1), ends included. Only the years and rows it needs are read."""
    cube = spark.read.parquet(path)
    if first is not None:
        cube = cube.where((F.col("year") >= F.year(F.lit(first))) & (F.col(time) >= F.lit(first)))
    if last is not None:
        cube = cube.where((F.col("year") <= F.year(F.lit(last))) & (F.col(time) <= F.lit(last)))
    if box is not None:
        cube = cube.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    return cube.drop("year")


def read_geojson(spark: SparkSession, path: str, key: str, lines: bool | None = None) -> DataFrame:
    """(zone, rings) of the polygons of GeoJSON feature collections, or of files with a feature a line (lines; by default what the first
    line says); the parts of a multi-polygon are rows of their own. Other shapes and features without one are left out."""
    point = "array<double>"
    feature = "type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>"
    if lines is None:
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.get_json_object("value", "$.type").alias("t")).first()
        lines = first is not None and first["t"] == "Feature"
    if lines:
        rows = spark.read.schema(feature.replace(": ", " ", 1).replace("properties: ", "properties ").replace("geometry: ", "geometry ")).json(path).where("type = 'Feature'").select(F.struct("properties", "geometry").alias("f"))
    else:
        rows = spark.read.schema(f"features array<struct<{feature}>>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    one, many = F.from_json("f.geometry.coordinates", f"array<array<{point}>>"), F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    made = rows.select(F.col("f.properties")[key].alias("zone"), F.explode(parts).alias("part"))
    return made.select("zone", F.transform("part", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def write_geojson(polygons: DataFrame, path: str, key: str) -> None:
    """Polygons (zone, rings) as files with a GeoJSON feature a line, rings closed; read_geojson reads them back."""
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    rings = F.transform(F.filter("rings", lambda ring: F.size(ring) > 0), lambda ring: F.transform(closed(ring), lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone").alias(key)).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    polygons.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(file, zone, rings) of the polygons in .shp files, zone the number of a record from 1.

    A file is parsed by one task, as its records have no index of their own; layers are small beside rasters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")

    def parse(frames):
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                at = 100
                while at + 12 <= len(data):
                    number, words = struct.unpack_from(">ii", data, at)
                    kind = struct.unpack_from("<i", data, at + 8)[0]
                    if kind in (5, 15, 25):
                        parts, points = struct.unpack_from("<ii", data, at + 44)
                        starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
                        xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
                        out.append((name, number, [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]))
                    at += 8 + 2 * words
            yield pd.DataFrame(out, columns=["file", "zone", "rings"])

    return files.mapInPandas(parse, f"file string, zone int, rings {RINGS}")


def ascii_grid_lines(cells: DataFrame, x0: float, y0: float, size: float, none: float = -9999.0) -> DataFrame:
    """(line, text) of one ASCII grid from cells (r, c, value) that fill a rectangle; nulls become the no-data value."""
    shape = cells.agg((F.max("c") + 1).alias("cols"), (F.max("r") + 1).alias("rows"))
    head = F.array(*(F.concat(F.lit(f"{k} "), v.cast("string")) for k, v in (("ncols", F.col("cols")), ("nrows", F.col("rows")), ("xllcorner", F.lit(x0)), ("yllcorner", F.lit(y0)), ("cellsize", F.lit(size)), ("NODATA_value", F.lit(none)))))
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("value", F.lit(none)).alias("v")))), lambda p: p["v"].cast("string")))
    body = cells.groupBy("r").agg(text.alias("text")).select((F.col("r") + 6).alias("line"), "text")
    return shape.select(F.posexplode(head).alias("line", "text")).union(body)
