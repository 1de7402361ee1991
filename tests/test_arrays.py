"""netCDF classic and GeoTIFF files that the tests write byte by byte, read whole, in slabs and in slices."""

import datetime
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from fluvia.sources import arrays


def text(s, size=">i"):
    b = s.encode()
    return struct.pack(size, len(b)) + b + b"\0" * (-len(b) % 4)


def attributes(items):
    if not items:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(items))
    for k, v in items.items():
        if isinstance(v, str):
            out += text(k) + struct.pack(">i", 2) + text(v)
        else:
            kind, code = {">f8": (6, "d"), ">i2": (3, "h")}[v.dtype.str]
            raw = v.tobytes()
            out += text(k) + struct.pack(">ii", kind, len(v)) + raw + b"\0" * (-len(raw) % 4)
    return out


def netcdf(path, dims, variables, records, version=1):
    """variables: name -> (dimension names, array, attributes); the first dimension named in dims with None is the records'."""
    kinds = {">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}
    names = list(dims)
    record = next((n for n in names if dims[n] is None), None)
    offset = ">i" if version == 1 else ">q"
    own = [k for k, (d, _, _) in variables.items() if d and d[0] == record]

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records) + struct.pack(">ii", 10, len(names))
        out += b"".join(text(n) + struct.pack(">i", dims[n] or 0) for n in names) + attributes({"title": "a test"}) + struct.pack(">ii", 11, len(variables))
        for k, (d, a, more) in variables.items():
            size = a[0].nbytes if k in own else a.nbytes
            out += text(k) + struct.pack(f">i{len(d)}i", len(d), *(names.index(x) for x in d)) + attributes(more) + struct.pack(">ii", kinds[a.dtype.str], size + -size % 4) + struct.pack(offset, begins.get(k, 0))
        return out

    at, begins = len(head({})), {}
    for k, (_, a, _) in variables.items():
        if k not in own:
            begins[k] = at
            at += a.nbytes + -a.nbytes % 4
    pad = (lambda n: n) if len(own) == 1 else (lambda n: n + -n % 4)
    for k in own:
        begins[k] = at
        at += pad(variables[k][1][0].nbytes)
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 4) for k, (_, a, _) in variables.items() if k not in own)
    for i in range(records):
        for k in own:
            raw = variables[k][1][i : i + 1].tobytes()
            body += raw + b"\0" * (pad(len(raw)) - len(raw))
    path.write_bytes(head(begins) + body)
    return str(path)


@pytest.fixture(scope="module", params=[1, 2])
def cube(request, tmp_path_factory):
    rng = np.random.default_rng(1)
    time, lat, lon = (np.arange(40) * 2.0 + 100).astype(">f8"), np.linspace(50, 48, 5).astype(">f8"), np.linspace(8, 9, 3).astype(">f4")
    rain = rng.integers(-50, 500, (40, 5, 3)).astype(">i2")
    rain[3, 2, 1] = -999
    variables = {
        "lat": (["lat"], lat, {}),
        "time": (["time"], time, {"units": "days since 1990-01-01"}),
        "rain": (["time", "lat", "lon"], rain, {"_FillValue": np.array([-999], ">i2"), "scale_factor": np.array([0.1], ">f8"), "add_offset": np.array([5.0], ">f8")}),
        "lon": (["lon"], lon, {}),
        "height": (["lat", "lon"], rng.normal(size=(5, 3)).astype(">f4"), {}),
    }
    path = netcdf(tmp_path_factory.mktemp("nc") / "cube.nc", {"time": None, "lat": 5, "lon": 3}, variables, 40, request.param)
    return path, time, lat, lon, rain, variables["height"][1]


def test_netcdf_header_and_whole_variables(spark, cube):
    path, time, lat, lon, rain, height = cube
    head = arrays.netcdf_info(path)
    assert head.dims == [("time", 0), ("lat", 5), ("lon", 3)] and head.records == 40 and head.attributes["title"] == "a test"
    assert head.variables["time"].attributes["units"] == "days since 1990-01-01"
    got = {(r["time"], r["lat"], r["lon"]): r["value"] for r in arrays.read_netcdf(spark, path, "rain").collect()}
    assert len(got) == 600
    for i, j, k in itertools.product(range(40), range(5), range(3)):
        want = None if rain[i, j, k] == -999 else pytest.approx(rain[i, j, k] * 0.1 + 5)
        assert got[float(time[i]), float(lat[j]), float(lon[k])] == want
    flat = {(r["lat"], r["lon"]): r["value"] for r in arrays.read_netcdf(spark, path, "height").collect()}
    assert flat == {(float(a), float(o)): float(height[j, k]) for j, a in enumerate(lat) for k, o in enumerate(lon)}
    with pytest.raises(Exception, match="no variable"):
        arrays.read_netcdf(spark, path, "snow").count()


def test_only_the_wanted_records_are_read(spark, cube, monkeypatch):
    path, time, lat, lon, rain, _ = cube
    monkeypatch.setattr(arrays, "VALUES", 60)  # four records a partition
    source = arrays.NetcdfSource({"path": path, "variable": "rain"})
    reader = source.reader(None)
    assert [(p.first, p.n) for p in reader.partitions()] == [(i, 4) for i in range(0, 40, 4)]
    left = list(reader.pushFilters([GreaterThan(("time",), 110.0), LessThanOrEqual(("time",), 130.0), EqualTo(("lat",), 49.0)]))
    assert len(left) == 3 and [(p.first, p.n) for p in reader.partitions()] == [(5, 4), (9, 4), (13, 3)]
    read = []
    plain = arrays._read
    monkeypatch.setattr(arrays, "_read", lambda file, at, n: read.append((at, n)) or plain(file, at, n))
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    begin, step = reader.v.begin, reader.head.record_bytes
    assert sorted(at for at, n in read if n == 30) == [begin + i * step for i in range(5, 16)]
    assert sum(b.num_rows for b in rows) == 11 * 3
    part = arrays.read_netcdf(spark, path, "rain", time=(110.0, 130.0), lon=(8.2, 8.8)).where("lat = 49")
    assert {r["time"] for r in part.collect()} == {110.0 + 2 * i for i in range(11)} and part.count() == 11
    assert arrays.read_netcdf(spark, path, "rain", time=(1.0, 2.0)).count() == 0


def test_times_of_units(spark):
    rows = spark.createDataFrame([(0.0,), (1.5,), (-1.0,)], "t double")
    got = [r["s"] for r in rows.select(arrays.cf_timestamp(F.col("t"), "days since 1990-01-01").cast("string").alias("s")).collect()]
    assert got == ["1990-01-01 00:00:00", "1990-01-02 12:00:00", "1989-12-31 00:00:00"]
    assert rows.select(arrays.cf_timestamp(F.col("t"), "hours since 2000-02-28T23:00:00").cast("string").alias("s")).collect()[1]["s"] == "2000-02-29 00:30:00"
    assert datetime.date(1990, 1, 2)
    with pytest.raises(ValueError):
        arrays.cf_timestamp(F.col("t"), "fortnights since 1990-01-01")


def test_no_netcdf(tmp_path):
    (tmp_path / "x.nc").write_bytes(b"HDF5....")
    (tmp_path / "y.nc").write_bytes(b"CDF\1\0\0")
    for name in ("x.nc", "y.nc"):
        with pytest.raises(ValueError):
            arrays.netcdf_info(str(tmp_path / name))


def pack_lzw(data):
    """A plain coder: the highest bit first, widths growing one entry early."""
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    n = 258
    put(256, 9)
    for c in data:
        b = bytes([c])
        if word + b in table:
            word += b
            continue
        put(table[word], width)
        table[word + b] = n
        n += 1
        width = max(9, min(12, n.bit_length()))
        if n == 4094:
            put(256, width)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = b
    if word:
        put(table[word], width)
        n += 1
        width = max(9, min(12, n.bit_length()))
    put(257, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def pack_bits(data):
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


def geotiff(path, image, block=None, tiled=False, compression=1, predictor=1, order="<", separate=False, none=None, big=False):
    """image: (rows, columns, bands)."""
    rows, cols, bands = image.shape
    image = image.astype(image.dtype.newbyteorder(order))
    th, tw = block if tiled else (block or rows, cols)
    pieces = []
    for band in range(bands if separate else 1):
        part = image[:, :, band : band + 1] if separate else image
        for r in range(0, rows, th):
            for c in range(0, cols, tw):
                tile = part[r : r + th, c : c + tw]
                if tiled:
                    tile = np.pad(tile, ((0, th - tile.shape[0]), (0, tw - tile.shape[1]), (0, 0)))
                if predictor == 2:
                    tile = np.concatenate([tile[:, :1], np.diff(tile.astype(image.dtype), axis=1)], 1).astype(image.dtype)
                raw = np.ascontiguousarray(tile).tobytes()
                pieces.append({1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}[compression](raw))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    at, offsets = 16 if big else 8, []
    for p in pieces:
        offsets.append(at)
        at += len(p) + len(p) % 2
    tags = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [image.dtype.itemsize * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [2 if separate else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    tags += [(322, "I", [tw]), (323, "I", [th]), (324, "I", offsets), (325, "I", [len(p) for p in pieces])] if tiled else [(273, "I", offsets), (278, "I", [th]), (279, "I", [len(p) for p in pieces])]
    tags += [(33550, "d", [20.0, 25.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 3000.0, 7000.0, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 31467])]
    if none is not None:
        tags.append((42113, "s", str(none).encode() + b"\0"))
    numbers = {"H": 3, "I": 4, "d": 12, "s": 2}
    tags.sort()
    start = at
    room, extra_at = (8, start + 8 + 20 * len(tags) + 8) if big else (4, start + 2 + 12 * len(tags) + 4)
    body, extra = struct.pack(f"{order}Q" if big else f"{order}H", len(tags)), b""
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        body += struct.pack(f"{order}HH" + ("Q" if big else "I"), tag, numbers[code], len(values))
        if len(raw) <= room:
            body += raw.ljust(room, b"\0")
        else:
            body += struct.pack(f"{order}Q" if big else f"{order}I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    body += b"\0" * (8 if big else 4)
    mark = b"II" if order == "<" else b"MM"
    first = mark + struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else mark + struct.pack(f"{order}HI", 42, start)
    path.write_bytes(first + b"".join(p + b"\0" * (len(p) % 2) for p in pieces) + body + extra)
    return str(path)


def cells(df):
    return {(r["r"], r["c"], r["band"]): r["value"] for r in df.collect()}


LAYOUTS = [
    dict(block=4), dict(block=4, compression=8, order=">"), dict(block=5, compression=5), dict(block=3, compression=32773, separate=True), dict(tiled=True, block=(16, 16)),
    dict(tiled=True, block=(16, 16), compression=8, predictor=2), dict(tiled=True, block=(16, 16), compression=5, separate=True, order=">", predictor=2), dict(big=True, block=4), dict(),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_tiff_whole_and_slices(spark, tmp_path, layout, kind):
    if kind == "f4" and layout.get("predictor") == 2:
        pytest.skip("whole numbers only")
    rng = np.random.default_rng(3)
    image = rng.integers(0, 100, (21, 35, 2)).astype(kind)
    image[4, 7, 1] = 77
    path = geotiff(tmp_path / "x.tif", image, none=77, **layout)
    info = arrays.geotiff_info(path)
    assert (info.rows, info.cols, info.bands, info.size, info.corner, info.epsg, info.none) == (21, 35, 2, (20.0, -25.0), (3000.0, 7000.0), 31467, 77.0)
    want = {(r, c, b): None if image[r, c, b] == 77 else float(image[r, c, b]) for r, c, b in itertools.product(range(21), range(35), range(2))}
    assert cells(arrays.read_geotiff(spark, path)) == want
    slice_ = {k: v for k, v in want.items() if 5 <= k[0] <= 17 and 3 <= k[1] <= 20 and k[2] == 1}
    assert cells(arrays.read_geotiff(spark, path, r=(5, 17), c=(3, 20), band=(1, 1))) == slice_


def test_only_the_wanted_blocks_are_read(tmp_path, monkeypatch):
    image = np.arange(64 * 64, dtype="<i4").reshape(64, 64, 1)
    path = geotiff(tmp_path / "x.tif", image, tiled=True, block=(16, 16))
    monkeypatch.setattr(arrays, "VALUES", 600)
    reader = arrays.GeotiffSource({"path": path}).reader(None)
    assert [p.numbers for p in reader.partitions()] == [[2 * i, 2 * i + 1] for i in range(8)]
    list(reader.pushFilters([GreaterThan(("r",), 15), LessThanOrEqual(("r",), 31), EqualTo(("c",), 40)]))
    assert [p.numbers for p in reader.partitions()] in ([[2, 6]], [[6]])
    got = [b for p in reader.partitions() for b in reader.read(p)]
    rows = sorted((r, v) for b in got for r, v in zip(b.column("r").to_pylist(), b.column("value").to_pylist(), strict=True) if r > 15)
    assert rows == [(r, float(image[r, 40, 0])) for r in range(16, 32)]


def test_long_lzw_codes(tmp_path):
    data = bytes(np.random.default_rng(2).integers(0, 7, 60000).astype("u1"))
    assert arrays.unpack_lzw(pack_lzw(data)) == data
    assert arrays.unpack_bits(b"\x02abc\xfed\x80") == b"abcddd"


def test_no_tiff(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"GIF89a--" * 4)
    with pytest.raises(ValueError):
        arrays.geotiff_info(str(tmp_path / "x.tif"))
