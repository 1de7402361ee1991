import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from fluvia.llm import gif_media

from .conftest import pairs


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_round_trip(request, name):
    df = request.getfixturevalue(name)
    got = {}
    for r in gif_media.media_digests(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, t in pairs(df):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        for r in got[d]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            frames = -(-len(padded) // (192 * gif_media.FRAME_ROWS))
            level = np.bincount(np.frombuffer(padded, np.uint8) // 64 * 21, minlength=64)
            assert r["feature"] == f"{frames};{frames * gif_media.DELAY};" + ",".join(map(str, level))


def test_code_streams():
    rng = random.Random(2)
    for data in (b"a", b"aaaaaaaa" * 3000, bytes(rng.randrange(256) for _ in range(30000)), bytes(rng.choice(b"abc") for _ in range(60000))):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data)).tobytes() == data


def plain_codes(samples, bits):
    """A code stream of literals only, with a clear code before the table would need wider codes."""
    clear, out = 1 << bits, []
    for i, s in enumerate(samples):
        if i % ((1 << bits) - 2) == 0:
            out.append(clear)
        out.append(s)
    out.append(clear + 1)
    value = sum(c << (i * (bits + 1)) for i, c in enumerate(out))
    return value.to_bytes((len(out) * (bits + 1) + 7) // 8, "little")


def frame(samples, box, control=None, palette=None, interlaced=False, bits=2):
    out = b""
    if control:
        disposal, delay, transparent = control
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    flags = (0x81 if palette else 0) | (0x40 if interlaced else 0)
    stream = plain_codes(samples, bits)
    return out + b"\x2c" + struct.pack("<HHHHB", *box, flags) + (palette or b"") + bytes((bits, len(stream))) + stream + b"\0"


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)


def gif(*frames, size=(2, 2)):
    return b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(RED + GREEN + BLUE + WHITE) + b"".join(frames) + b"\x3b"


def colours(f):
    return [[tuple(int(v) for v in p[:3]) if p[3] else None for p in row] for row in f.canvas]


def test_disposal_transparency_palettes():
    whole = frame([0, 0, 0, 0], (0, 0, 2, 2), (1, 5, None))
    dot = frame([1], (1, 1, 1, 1), (2, 7, None))
    hole = frame([2, 3, 3, 2], (0, 0, 2, 2), (3, 9, 3))
    own = frame([0], (0, 0, 1, 1), None, bytes(WHITE * 4))
    f = list(gif_media.decode_gif(gif(whole, dot, hole, own)))
    assert [(x.delay, x.disposal, x.transparent) for x in f] == [(5, 1, None), (7, 2, None), (9, 3, 3), (0, 0, None)]
    assert colours(f[0]) == [[RED, RED], [RED, RED]]
    assert colours(f[1]) == [[RED, RED], [RED, GREEN]]
    assert colours(f[2]) == [[BLUE, RED], [RED, BLUE]]  # its place was cleared, then drawn on
    assert colours(f[3]) == [[WHITE, RED], [RED, None]]  # restored to what stood before the third


def test_interlaced_rows():
    f = list(gif_media.decode_gif(gif(frame([0, 1, 2, 3, 0], (0, 0, 1, 5), interlaced=True), size=(1, 5))))
    assert [row[0] for row in colours(f[0])] == [RED, WHITE, BLUE, RED, GREEN]


def test_media_columns(spark, awkward, nothing):
    stored = gif_media.store_texts(awkward)
    rows = {r["doc_id"]: r for r in gif_media.decode_media(stored).collect()}
    assert bytes(rows[10]["frames"][0]["samples"]) == b"one".ljust(192)
    assert sum(len(f["samples"]) for f in rows[16]["frames"]) == -(-200000 // 192) * 192
    odd = spark.createDataFrame([(1, None), (2, b"no gif"), (3, b"")], "id long, media binary")
    assert [r["frames"] for r in gif_media.decode_media(odd).collect()] == [None] * 3
    assert gif_media.media_digests(nothing).count() == 0


def test_damaged_media(spark):
    """Every cut, and many flips of a byte, give frames or null; huge canvases and frames give null."""
    rng = random.Random(9)
    good = gif_media.encode_gif(gif_media.pad_payload("some text " * 90))
    blobs = [good[:n] for n in range(0, len(good), 7)] + [None, b"", b"GIF89a"]
    for _ in range(300):
        i = rng.randrange(len(good))
        blobs.append(good[:i] + bytes((rng.randrange(256),)) + good[i + 1 :])
    huge = [good[:6] + struct.pack("<HH", 65535, 65535) + good[10:], good.replace(struct.pack("<HHHH", 0, 0, 192, 5), struct.pack("<HHHH", 0, 0, 65535, 65535))]
    assert huge[1] != good
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs + huge + [good])], "i int, media binary")
    rows = {r["i"]: r["frames"] for r in gif_media.decode_media(df).collect()}
    assert len(rows) == len(blobs) + 3 and len(rows[len(blobs) + 2]) == 1
    assert rows[len(blobs)] is None and rows[len(blobs) + 1] is None


def test_histograms_tell_colours_apart(spark):
    """One stream of samples under three palettes: red and blue, green and white, and grey."""
    media = bytearray(gif_media.encode_gif(bytes([10] * 100 + [200] * 92)))
    frames = {}
    for name, (low, high) in {"a": ((255, 0, 0), (0, 0, 255)), "b": ((0, 200, 0), (255, 255, 255)), "c": ((10, 10, 10), (200, 200, 200))}.items():
        media[13 + 30 : 13 + 33], media[13 + 600 : 13 + 603] = bytes(low), bytes(high)
        frames[name] = bytes(media)
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in frames.items()], "name string, media binary")
    got = {r["name"]: {i: n for i, n in enumerate(r["frames"][0]["histogram"]) if n} for r in gif_media.decode_media(df).collect()}
    assert got == {"a": {3 << 4: 100, 3: 92}, "b": {3 << 2: 100, 63: 92}, "c": {0: 100, 63: 92}}


def test_clear_pixels_are_not_counted():
    pixels = np.zeros((2, 3, 4), np.uint8)
    pixels[0, :, 0], pixels[0, :2, 3] = 130, 255
    assert {i: n for i, n in enumerate(gif_media.histogram(pixels)) if n} == {2 << 4: 2}
