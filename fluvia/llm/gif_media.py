"""Media columns: GIF images in binary columns, decoded to timed frames with colour histograms.

The decoder reads LZW code streams, applies global and local palettes, interlacing, transparency
and disposal, and gives one composed canvas per frame with its delay, one at a time. Code streams are expanded
with numpy: within the codes between two clear codes every code is a literal or a copy of earlier
output, so all of them are resolved together by pointer doubling.
The encoder stores bytes as 8-bit grey samples in frames of bounded height, so that a text of any
length is held losslessly; memory is that of the text, its stored form and one frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from fluvia.llm.common import map_texts

#: Samples in a row, rows of a frame at most, and a frame's time in hundredths of a second.
ROW, FRAME_ROWS, DELAY = 192, 512, 10
#: Largest canvas or frame that is decoded (four bytes a pixel are held).
PIXELS = 1 << 24
#: Codes between two clear codes that get a table entry, with 8-bit samples.
_FULL = 4096 - 258


def _widths(first: int) -> np.ndarray:
    """Bits of each code after a clear code, as the reader's table grows from `first` entries."""
    i = np.arange(4096 - first + 1)
    bits = np.frompyfunc(lambda n: max(int(first - 1).bit_length(), min(12, int(n).bit_length())), 1, 1)
    return np.where(i == 0, (first - 1).bit_length(), bits(first - 1 + i)).astype(np.int64)


_W8 = _widths(258)


def lzw_encode(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples: clear code first, again whenever the table is full, end code last."""
    codes, table, n = [256], {}, 258
    put, get = codes.append, table.get
    clears = 1
    data = iter(samples)
    w = next(data)
    for b in data:
        k = w << 8 | b
        t = get(k)
        if t is None:
            put(w)
            table[k] = n
            n += 1
            w = b
            if n == 4096:
                put(256)
                table.clear()
                n = 258
                clears += 1
        else:
            w = t
    codes += (w, 257)
    # The clear code that ends a segment has the width that follows the segment's codes.
    widths = np.concatenate([[9], np.tile(_W8[: _FULL + 1], clears)])[: len(codes)]
    bits = (np.array(codes, np.int64)[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _expand(codes: np.ndarray, base: int) -> np.ndarray:
    """Samples of the codes between two clear codes; base: first code with a table entry."""
    copy = codes >= base
    if not copy.any():
        return codes.astype(np.uint8)
    at = np.arange(len(codes))
    ref = np.where(copy, codes - base, at)
    if (ref[copy] >= at[copy]).any():
        raise ValueError("a code refers to an entry that isn't there yet")
    # Length: one more than that of the code where the entry began; depth by pointer doubling.
    size, jump = copy.astype(np.int64), ref.copy()
    while copy[jump].any():
        size = size + size[jump]
        jump = jump[jump]
    size += 1
    start = np.cumsum(size) - size
    src = np.arange(int(size.sum()))
    shift = np.repeat(np.where(copy, start - start[ref], 0), size)
    src -= shift
    while True:
        nxt = src[src]
        if np.array_equal(nxt, src):
            break
        src = nxt
    literal = np.repeat(codes.astype(np.uint8), size)
    return literal[src]


def lzw_decode(stream: bytes, bits: int = 8) -> np.ndarray:
    """Samples of a code stream; it may lack its end code. Codes after a full table have 12 bits."""
    clear, end, base = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    width = _W8 if bits == 8 else _widths(base)
    offset = np.cumsum(width) - width
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out = 8 * len(stream), 0, []
    while at + width[0] <= total:
        codes = np.zeros(0, np.int64)
        stop, here = -1, at
        while stop < 0:
            # The next codes, as many as there are or as the table's growth lets us read at once.
            w = width if not len(codes) else np.full(4096, 12)
            pos = here + (offset if not len(codes) else 12 * np.arange(4096))
            pos = pos[pos + w <= total]
            if not len(pos):
                break
            byte = pos >> 3
            got = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7)) & ((1 << w[: len(pos)]) - 1)
            marks = np.flatnonzero((got == clear) | (got == end))
            stop = int(marks[0]) if len(marks) else -1
            here = int(pos[stop] + w[stop]) if stop >= 0 else int(pos[-1] + w[len(pos) - 1])
            ended = stop >= 0 and got[stop] == end
            codes = np.concatenate([codes, got[:stop] if stop >= 0 else got])
        if len(codes):
            out.append(_expand(codes, base))
        at = here
        if stop < 0 or ended:
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


@dataclass
class Frame:
    """A frame as shown: its place, time and rules, its own samples, and the canvas after it is drawn."""

    delay: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    canvas: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF one by one, each with the RGBA canvas (height, width, 4) that a viewer shows.

    Local palettes stand before the global one; a transparent sample leaves the canvas as it is.
    Disposal 2 clears the frame's place before the next frame, 3 restores what stood there, others
    leave it. Missing samples count as 0, surplus ones are ignored. Bytes that aren't a GIF, that end within
    a header or a palette or hold codes that can't be, and canvases or frames of over PIXELS: ValueError.
    """
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as damage:
        raise ValueError("damaged GIF") from damage


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    if width * height > PIXELS:
        raise ValueError("canvas too large")
    canvas, control = np.zeros((height, width, 4), np.uint8), (0, 0, None)
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            body, nxt = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, index if packed & 1 else None)
            at = nxt
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                n = 3 << ((packed & 7) + 1)
                palette = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
                at += n
            bits = data[at]
            if w * h > PIXELS or not 1 <= bits <= 8:
                raise ValueError("not a frame")
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, bits)[: w * h]
            if len(samples) < w * h:
                samples = np.concatenate([samples, np.zeros(w * h - len(samples), np.uint8)])
            grid = samples.reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                grid = grid[np.argsort(rows, kind="stable")]
            disposal, delay, transparent = control
            control = (0, 0, None)
            colours = np.zeros((256, 4), np.uint8)
            if palette is not None:
                colours[: len(palette), :3] = palette
                colours[: len(palette), 3] = 255
            under = canvas.copy() if disposal in (2, 3) else None
            place = canvas[top : top + h, left : left + w]
            patch = grid[: place.shape[0], : place.shape[1]]
            if transparent is None:
                place[:] = colours[patch]
            else:
                shown = patch != transparent
                place[shown] = colours[patch[shown]]
            yield Frame(delay, left, top, w, h, disposal, transparent, grid.reshape(-1), canvas.copy())
            if disposal == 2:
                place[:] = 0
            elif disposal == 3:
                canvas = under
        else:  # the trailer, or what can't be read
            break


def encode_gif(payload: bytes, row: int = ROW) -> bytes:
    """A grey GIF whose frames hold payload, a positive multiple of row, as 8-bit samples."""
    rows = len(payload) // row
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", row, min(rows, FRAME_ROWS), 0xF7, 0, 0), grey]
    for first in range(0, rows, FRAME_ROWS):
        part = payload[first * row : (first + FRAME_ROWS) * row]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHBB", 0, 0, row, len(part) // row, 0, 8)]
        out += [bytes((len(stream[i : i + 255]),)) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def pad_payload(text: str | None, row: int = ROW) -> bytes:
    """UTF-8 bytes of a text (null: empty) with spaces up to a positive multiple of row."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // row)) * row, b" ")


def histogram(pixels: np.ndarray) -> list[int]:
    """Opaque pixels in each of 64 cells of colours: quarters of red, of green and of blue, blue fastest."""
    flat = pixels.reshape(-1, 4)
    quarter = flat[:, :3] >> 6
    cell = (quarter[:, 0] << 4) | (quarter[:, 1] << 2) | quarter[:, 2]
    return np.bincount(cell[flat[:, 3] > 0], minlength=64).tolist()


def store_texts(docs: DataFrame) -> DataFrame:
    """docs with media binary: the text stored losslessly as a GIF. Null or empty text: a row of spaces. Other columns stay."""
    return map_texts(docs, lambda: lambda texts: [[encode_gif(pad_payload(t)) for t in texts]], "media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """media with frames array<struct<delay, left, top, width, height, disposal, histogram, samples>>.

    Null media, bytes that aren't a GIF and damaged ones: null frames. A GIF without a frame: no frames.
    Only one canvas is held at a time. Other columns and rows stay.
    """

    def work(blobs):
        out = []
        for blob in blobs:
            try:
                frames = None if blob is None else [{"delay": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": histogram(f.canvas), "samples": f.samples.tobytes()} for f in decode_gif(blob)]
            except ValueError:
                frames = None
            out.append(frames)
        return [out]

    frame = "struct<delay:int,left:int,top:int,width:int,height:int,disposal:int,histogram:array<int>,samples:binary>"
    return map_texts(media, lambda: work, f"frames array<{frame}>", text="media")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id and digests of each whole text's stored GIF and of what is read back from it.

    feature: number of frames, their time in hundredths of a second, and the colour histogram over all
    of them. Equal texts give equal values; an empty table stays empty.
    """

    def work(texts):
        rows = []
        for t in texts:
            media = encode_gif(pad_payload(t))
            parts, bins, delay = [], np.zeros(64, np.int64), 0
            for f in decode_gif(media):
                # The grey palette gives samples as colours; a frame's own place on the canvas holds them.
                place = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                parts.append(np.ascontiguousarray(place[:, :, 0]).tobytes())
                bins += histogram(place)
                delay += f.delay
            payload = b"".join(parts)
            feature = f"{len(parts)};{delay};" + ",".join(map(str, bins.tolist()))
            rows.append((len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return list(zip(*rows, strict=True))

    return map_texts(docs.select("doc_id", "text"), lambda: work, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", drop=("text",))
