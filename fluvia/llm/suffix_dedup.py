"""Suffix-array dedup with a run-length index: remove long byte strings that an earlier document holds.

Equal strings of WIDTH bytes have the same anchor, the leftmost k-gram with the smallest hash in them.
Documents are dealt out in chunks. A chunk first asks, by hash, which of its anchors any other document
has; only runs of neighbouring windows of such anchors (segments) are sent on, to the bucket of the
anchor's hash, so that equal windows always meet, whatever documents hold them.

A bucket puts equal segments together. Of the different segments of an anchor the first holders' are
indexed, in rounds: a run-compressed Burrows-Wheeler transform of them with samples of the suffix array
at the ends of its runs. All segments of the round's anchors stream through it backwards, and their
matching statistics (length and row of the longest match from each place) mark windows that an indexed
segment holds, with the smallest doc_id among the rows that agree. Segments with windows left go on to
the next round. Hashes only route, and spare windows that no other segment holds; what removes a byte is
a match of WIDTH bytes in the index.

Copies of a segment inside a chunk are settled there, so a hot passage sends one segment per chunk. An
anchor of very many chunks would fill a bucket with what stands around it: its windows go one by one to
the buckets of their own hashes. Every lost segment gives one row, and buckets grow in number with the text.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fluvia.llm.common import map_texts

#: Bytes of a string that counts as repeated, and of an anchor.
WIDTH, ANCHOR = 50, 16
#: Bytes of text of a chunk and of a bucket, on average.
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 4 << 20
#: Bytes of segments in one index, those of one anchor in it, and bytes whose prefix sums are held at a time.
INDEX_BYTES, LEADERS, HASHED_BYTES = 1 << 20, 1 << 12, 1 << 20
#: Chunks from which on an anchor's windows are sent one by one, each to the bucket of its own hash.
HOT_CHUNKS = 256
#: Compression of what is shuffled.
LEVEL = 3

_U = np.uint64
#: Odd constants of the hashes; their values don't matter.
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _C
    return h ^ (h >> _U(32))


def _words(data: bytes | np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places, as numbers."""
    return np.ndarray((n,), "<u8", data, 0, (1,))


def _anchor_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    w = _words(np.concatenate([data, np.zeros(8, np.uint8)]), len(data))
    return _mix((w[place] * _A) ^ (w[place + 8] * _B))


def cut(data: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents that lie one after another: their document, first window, windows, place of the anchor."""
    out = []
    which = (base + sizes) // HASHED_BYTES
    for docs in np.split(np.arange(len(base)), np.flatnonzero(np.diff(which)) + 1):
        low, high = (int(base[docs[0]]), int(base[docs[-1]] + sizes[docs[-1]])) if len(docs) else (0, 0)
        if high - low < WIDTH:
            continue
        w = _words(data[low:high], high - low - 7)
        h = _mix((w[:-8] * _A) ^ (w[8:] * _B))
        at, span, goal = np.arange(len(h), dtype=np.int32), 1, WIDTH - ANCHOR + 1
        while span < goal:  # the leftmost smallest of the next 1, 2, 4, ... places
            step = min(span, goal - span)
            right = h[step:] < h[:-step]
            h, at = np.where(right, h[step:], h[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        # Windows that lie within a document; a segment ends with it.
        windows = np.maximum(sizes[docs] - WIDTH + 1, 0)
        place, owner = _spread(base[docs] - low, windows), np.repeat(docs, windows)
        at = at[place]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else place
        out.append((owner[new], place[new] + low, np.diff(new, append=len(at)), at[new].astype(np.int64) + low))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _prefix_hashes(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two pairs of prefix sums and inverse powers, from which any slice's hash follows."""
    out = []
    for table, base in zip(_BYTES, (_A, _B), strict=True):
        inverse = pow(int(base), -1, 1 << 64)
        power, back = np.full(len(data) + 1, base, np.uint64), np.full(len(data) + 1, inverse, np.uint64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        out.append((np.concatenate([[_U(0)], np.cumsum(table[data] * power[:-1], dtype=np.uint64)]), back))
    return out


def _slice_hashes(sums, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    return [_mix((s[stop] - s[start]) * back[start]) for s, back in sums]


def _segment_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Hashes of segments in the order of their starts; only a block of prefix sums is held at a time."""
    cuts = np.searchsorted(start, np.arange(0, len(data) + HASHED_BYTES, HASHED_BYTES))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            low, stop = start[a], start[a:b] + size[a:b]
            parts.append(_slice_hashes(_prefix_hashes(data[low : stop.max()]), start[a:b] - low, stop - low))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _window_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pairs of hashes of all windows of segments, in the order of the segments."""
    order = np.argsort(start, kind="stable")
    windows = size - WIDTH + 1
    bounds = np.cumsum(windows) - windows
    out = [np.zeros(int(windows.sum()), np.uint64) for _ in range(2)]
    cuts = np.searchsorted(start[order], np.arange(0, len(data) + HASHED_BYTES, HASHED_BYTES))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = order[a:b]
            low = start[part[0]]
            at = _spread(start[part] - low, windows[part])
            for o, h in zip(out, _slice_hashes(_prefix_hashes(data[low : int((start[part] + size[part]).max())]), at, at + WIDTH), strict=True):
                o[_spread(bounds[part], windows[part])] = h
    yield out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the slices from start with the given sizes, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _join_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of the given sizes from a and from b hold the same bytes."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        part = slice(i, i + (1 << 14))
        differs = data[_spread(a[part], size[part])] != data[_spread(b[part], size[part])]
        out[part] = ~np.logical_or.reduceat(differs, np.cumsum(size[part]) - size[part])
    return out


def _copies(data: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each segment but the first, in the given order, holds the same bytes as the one before it."""
    a, b = order[1:], order[:-1]
    same = (one[a] == one[b]) & (two[a] == two[b]) & (size[a] == size[b])
    some = np.flatnonzero(same)
    same[some] = _equal(data, start[a[some]], start[b[some]], size[a[some]])
    return same


def _by_document(doc, sig, start, stop):
    """Joined spans of each document: numbers of documents and signatures, starts, stops; one row a span."""
    if not len(doc):
        return doc, sig, start, stop
    order = np.lexsort((sig, doc))
    doc, sig, start, stop = doc[order], sig[order], start[order], stop[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])])
    # Each document's spans lie in a range of their own, so that all are joined at once.
    which = np.cumsum(new) - 1
    start, stop = _join_spans(start + (which << 40), stop + (which << 40))
    low, which = (1 << 40) - 1, start >> 40
    return doc[new][which], sig[new][which], start & low, stop - (which << 40)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of segments, with suffix samples at run ends.

    data: the segments' bytes one after another; sizes: theirs; least: a number of each. Each segment ends
    with a terminator of its own, smaller than every byte, in the order of the segments.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, least: np.ndarray):
        self.count, self.sizes = len(sizes), sizes
        n = len(data) + self.count
        self.stops = np.cumsum(sizes + 1) - 1  # places of the terminators
        text = np.zeros(n + 8, np.int64)
        body = np.ones(n, bool)
        body[self.stops] = False
        text[:n][body] = data.astype(np.int64) + 1
        self.n = n
        self.left = left = np.repeat(self.stops, sizes + 1) - np.arange(n)  # bytes up to the terminator
        # First seven symbols as one number, nothing behind a terminator; ties there go by segment, which is their order.
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = key << 9 | np.where(left > j, text[j : j + n], 0)
        suffixes = np.argsort(key, kind="stable")
        new = np.concatenate([[0], (key[suffixes][1:] != key[suffixes][:-1]) | (left[suffixes[1:]] < 7)])
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.cumsum(new)
        depth = 7
        while rank[suffixes[-1]] < n - 1:  # prefix doubling; a suffix is unique once its terminator is in reach
            after = np.where(left >= depth, rank[np.minimum(np.arange(n) + depth, n - 1)] + 1, 0)
            key = rank * (n + 1) + after
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank[suffixes] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            depth *= 2
        before = np.where(np.concatenate([[True], ~body[:-1]]), 0, text[np.maximum(np.arange(n) - 1, 0)])
        bwt = before[suffixes]
        self.run_start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.head = bwt[self.run_start]
        length = np.diff(self.run_start, append=n)
        self.first_sample = suffixes[self.run_start]
        self.last_sample = suffixes[self.run_start + length - 1]
        by_head = np.argsort(self.head, kind="stable")
        self.by_head, self.length, self.jumps = by_head, length, 0
        self.ordered = self.head[by_head] * len(by_head) + by_head
        earlier = np.cumsum(length[by_head]) - length[by_head]
        self.lf = np.empty(len(by_head), np.int64)  # row that a run's first row is mapped to
        self.lf[by_head] = earlier
        self.head_bounds = np.searchsorted(self.head[by_head], np.arange(258))
        # Rows whose suffixes agree in WIDTH bytes lie together; each knows the smallest number of their segments.
        self.bytes = np.zeros(n + WIDTH, np.uint8)
        self.bytes[:n][body] = data
        whole = left[suffixes] >= WIDTH
        fresh = np.ones(n, bool)
        pairs = np.flatnonzero(whole[1:] & whole[:-1]) + 1
        for i in range(0, len(pairs), 1 << 16):
            part = pairs[i : i + (1 << 16)]
            fresh[part] = self.lce(suffixes[part], suffixes[part - 1], WIDTH) < WIDTH
        cuts = np.flatnonzero(fresh)
        owner = np.repeat(np.arange(self.count), sizes + 1)[suffixes]
        self.least = np.repeat(np.minimum.reduceat(least[owner], cuts), np.diff(cuts, append=n))

    def lce(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes in which the suffixes at places a and b agree, up to most and to their terminators."""
        reach = np.minimum(np.minimum(self.left[a], self.left[b]), most)
        size, going, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(going):
            span = np.arange(at, at + 16)
            last = len(self.bytes) - 1
            same = self.bytes[np.minimum(a[going, None] + span, last)] == self.bytes[np.minimum(b[going, None] + span, last)]
            run = np.where(same.all(1), 16, np.argmin(same, 1))
            size[going] += run
            at += 16
            going = going[(run == 16) & (at < most)]
        return np.minimum(size, reach)

    def _nearest(self, run: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest runs before and after the given ones that have the symbol as head; -1: none."""
        low, high = self.head_bounds[symbol], self.head_bounds[symbol + 1]
        j = np.searchsorted(self.ordered, symbol * len(self.head) + run)
        before, after = np.full(len(run), -1), np.full(len(run), -1)
        some = j > low
        before[some] = self.by_head[j[some] - 1]
        some = j < high
        after[some] = self.by_head[j[some]]
        return before, after

    def step(self, row, place, size, symbol) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extend matches (of size bytes, at rows whose suffixes start at place) to the left by a symbol.

        Where the row's run has another head, the match moves to the end of a run before it or to the start
        of one after it that has the symbol, whichever agrees longer; the samples kept there say where those
        suffixes start.
        """
        run = np.searchsorted(self.run_start, row, "right") - 1
        other = np.flatnonzero(self.head[run] != symbol)
        if len(other):
            self.jumps += len(other)
            row, place, size, run = row.copy(), place.copy(), size.copy(), run.copy()
            before, after = self._nearest(run[other], symbol[other])
            here, up, down = place[other], self.last_sample[before], self.first_sample[after]
            most = int(size[other].max(initial=1)) or 1
            agree_up = np.where(before >= 0, np.minimum(self.lce(here, up, most), size[other]), -1)
            agree_down = np.where(after >= 0, np.minimum(self.lce(here, down, most), size[other]), -1)
            higher = agree_up >= agree_down
            chosen = np.where(higher, before, after)
            run[other], size[other] = chosen, np.where(higher, agree_up, agree_down)
            row[other] = np.where(higher, self.run_start[chosen] + self.length[chosen] - 1, self.run_start[chosen])
            place[other] = np.where(higher, up, down)
        found = run >= 0  # else the symbol isn't in the text: the match starts anew
        return np.where(found, self.lf[run] + row - self.run_start[run], 0), np.where(found, place - 1, self.stops[0]), np.where(found, size + 1, 0)

    def stream(self, data: np.ndarray, sizes: np.ndarray):
        """Matching statistics of segments given as bytes, all of them streamed from their ends at once.

        Yields, for 1, 2, 3, ... bytes taken, the segments still going, and for each the length of the longest
        match that starts there and a row of such a match.
        """
        stops, symbols = np.cumsum(sizes), data.astype(np.int64) + 1
        alive = np.arange(len(sizes))
        row, place, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.stops[0]), np.zeros(len(sizes), np.int64)
        for taken in range(1, int(sizes.max(initial=0)) + 1):
            going = sizes[alive] >= taken
            row, place, size, alive = row[going], place[going], size[going], alive[going]
            row, place, size = self.step(row, place, size, symbols[stops[alive] - taken])
            yield taken, alive, size, row

    def matching_statistics(self, pattern: bytes) -> list[int]:
        """For each place of a pattern, the length of the longest match in a segment that starts there."""
        return [int(size[0]) for _, _, size, _ in self.stream(np.frombuffer(pattern, np.uint8), np.array([len(pattern)]))][::-1]


def _pack(ids, sigs, number, first, windows, offset, body) -> bytes:
    """Segments of one bucket as bytes: documents, then columns of segments, then what they hold, compressed."""
    columns = (ids.astype("<i8"), sigs.astype("<i8"), number.astype("<i4"), first.astype("<i4"), windows.astype("u1"), offset.astype("u1"))
    codec = pa.Codec("zstd", compression_level=LEVEL)
    numbers = codec.compress(b"".join(c.tobytes() for c in columns), asbytes=True)
    return struct.pack("<4I", len(ids), len(number), len(body), len(numbers)) + numbers + codec.compress(body.tobytes(), asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    docs, segments, size, width = struct.unpack_from("<4I", blob)
    at, out = 0, []
    numbers = pa.decompress(blob[16 : 16 + width], 16 * docs + 10 * segments, codec="zstd", asbytes=True)
    for kind, n in (("<i8", docs), ("<i8", docs), ("<i4", segments), ("<i4", segments), ("u1", segments), ("u1", segments)):
        out.append(np.frombuffer(numbers, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(pa.decompress(blob[16 + width :], size, codec="zstd", asbytes=True), np.uint8)]


_FOUND = "doc long, sig long, start int, stop int"


def _laid_out(texts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, where each begins, and their sizes."""
    sizes = np.array([len(t) for *_, t in texts], np.int64)
    return np.frombuffer(b"".join(t for *_, t in texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _split(order: np.ndarray, key: np.ndarray):
    """(key, members) of each run of equal keys."""
    if not len(key):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return zip(key[cuts].tolist(), np.split(order, cuts[1:]), strict=True)


def _ask(texts: list[tuple[int, int, bytes]], buckets: int):
    """For each bucket, hashes of a chunk's anchors as bytes; the lowest bit tells that two of its documents hold one."""
    data, base, sizes = _laid_out(texts)
    owner, _, _, anchor = cut(data, base, sizes)
    doc = np.array([d for d, *_ in texts], np.int64)[owner]
    h = _anchor_hashes(data, anchor) & ~_U(1)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
    last = np.append(cuts[1:], len(h))[: len(cuts)] - 1
    h = h[cuts] | (doc[cuts] != doc[last]).astype(np.uint64)
    bucket = ((h >> _U(8)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for b, members in _split(order, bucket[order]):
        yield b, h[members].tobytes()


def _tell(chunks: list[int], blobs: list[bytes], hot: int = HOT_CHUNKS):
    """For each chunk, those of its anchors that another chunk has too or two of its documents.

    The lowest bit of an anchor's hash now tells that many chunks have it.
    """
    parts = [np.frombuffer(b, np.uint64) for b in blobs]
    h = np.concatenate(parts)
    chunk = np.repeat(np.array(chunks, np.int64), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h, chunk = h[order], chunk[order]
    bare = h >> _U(1)
    cuts = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
    count = np.diff(cuts, append=len(h))
    shared = np.repeat((count > 1) | ((h[cuts + count - 1] & _U(1)) == 1), count)
    h, chunk = (h & ~_U(1) | np.repeat(count >= hot, count).astype(np.uint64))[shared], chunk[shared]
    order = np.argsort(chunk, kind="stable")
    for c, members in _split(order, chunk[order]):
        yield c, h[members].tobytes()


def _cut_chunk(texts: list[tuple[int, int, bytes]], buckets: int, shared: np.ndarray | None = None):
    """Rows of one chunk: settled spans by document, and for each bucket a blob of segments to settle.

    shared: sorted hashes of the anchors that matter, the lowest bit set for hot ones; all by default, none hot.
    """
    texts = sorted(texts, key=lambda x: x[:2])
    data, base, sizes = _laid_out(texts)
    owner, start, windows, anchor = cut(data, base, sizes)
    hot = np.zeros(len(start), bool)
    if shared is not None and len(start):
        bare, h = shared & ~_U(1), _anchor_hashes(data, anchor) & ~_U(1)
        at = np.minimum(np.searchsorted(bare, h), max(0, len(bare) - 1))
        known = bare[at] == h if len(bare) else hot
        owner, start, windows, anchor, at = owner[known], start[known], windows[known], anchor[known], at[known]
        hot = (shared[at] & _U(1)) == 1
    if not len(start):
        return
    if hot.any():  # each of their windows becomes a segment
        times = np.where(hot, windows, 1)
        start, hot = _spread(start, times), np.repeat(hot, times)
        owner, anchor, windows = np.repeat(owner, times), np.repeat(anchor, times), np.where(hot, 1, np.repeat(windows, times))
    first, size = start - base[owner], windows + WIDTH - 1
    one, two = _segment_hashes(data, start, size)
    doc = np.array([d for d, *_ in texts], np.int64)[owner]
    sig = np.array([s for _, s, _ in texts], np.int64)[owner]
    # Equal segments: all of a larger doc_id than the first holder's are settled here.
    order = np.lexsort((np.arange(len(first)), two, one))
    same = _copies(data, start, size, order, one, two)
    leader = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    holder = np.empty(len(order), np.int64)
    holder[order] = doc[order][leader]
    done = doc > holder
    if done.any():
        for row in zip(*(x.tolist() for x in _by_document(doc[done], sig[done], first[done], (first + size)[done])), strict=True):
            yield row[0] % buckets, *row, None
    keep = np.flatnonzero(~done)
    bucket = ((np.where(hot[keep], one[keep], _anchor_hashes(data, anchor[keep])) >> _U(8)) % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for b, k in _split(keep[by], bucket[by]):
        # Documents by number, with a table of those that occur: both compress well.
        here, number = np.unique(owner[k], return_inverse=True)
        ids, sigs = np.array([texts[i][0] for i in here], np.int64), np.array([texts[i][1] for i in here], np.int64)
        yield b, None, None, None, None, _pack(ids, sigs, number, first[k], windows[k], anchor[k] - start[k], data[_spread(start[k], size[k])])


def _match_windows(data, start, size, anchor, least, bounds, window_least) -> None:
    """Lower window_least of each window of different segments to the smallest number of a segment that holds it.

    Segments come in the order of their anchors; windows of one are those from its bounds on.
    """
    one, two = (np.concatenate(x) for x in zip(*_window_hashes(data, start, size), strict=True))
    # A window no other segment has the hashes of is nobody else's.
    order = np.lexsort((two, one))
    twin = np.zeros(len(one), bool)
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    open_ = np.add.reduceat(twin, bounds[:-1]) > 0
    alive = np.flatnonzero(open_)
    alive = alive[np.lexsort((least[alive], anchor[alive]))]
    leaders = 1
    while len(alive):
        cuts = np.flatnonzero(np.concatenate([[True], anchor[alive][1:] != anchor[alive][:-1]]))
        members = np.diff(cuts, append=len(alive))
        cuts, members = cuts[members > 1], members[members > 1]
        led = np.minimum(members, leaders)
        weight = np.cumsum(led) * (2 * WIDTH)
        rest = []
        for groups in np.split(np.arange(len(cuts)), np.flatnonzero(np.diff(weight // INDEX_BYTES)) + 1):
            if not len(groups):
                continue
            first, all_ = alive[_spread(cuts[groups], led[groups])], alive[_spread(cuts[groups], members[groups])]
            index = RunLengthIndex(data[_spread(start[first], size[first])], size[first], least[first])
            for taken, going, length, row in index.stream(data[_spread(start[all_], size[all_])], size[all_]):
                hit = np.flatnonzero(length >= WIDTH)
                if len(hit):
                    seg = all_[going[hit]]
                    at = bounds[seg] + size[seg] - taken
                    window_least[at] = np.minimum(window_least[at], index.least[row[hit]])
                    twin[at[index.least[row[hit]] < least[seg]]] = False
            later = alive[_spread(cuts[groups] + led[groups], members[groups] - led[groups])]
            rest.append(later[np.logical_or.reduceat(twin, bounds[:-1])[later]] if len(later) else later)
        alive = np.concatenate(rest) if rest else alive[:0]
        leaders = min(4 * leaders, LEADERS)


def _settle(tables: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that a bucket's segments lose: documents, signatures, starts, stops; of each segment its runs."""
    doc, sig, first, windows, offset, parts = [], [], [], [], [], []
    for blob in tables:
        ids, sigs, number, at, count, off, body = _unpack(blob)
        doc.append(ids[number])
        sig.append(sigs[number])
        first.append(at.astype(np.int64))
        windows.append(count.astype(np.int64))
        offset.append(off.astype(np.int64))
        parts.append(body)
    doc, sig, first, windows, offset = map(np.concatenate, (doc, sig, first, windows, offset))
    data = np.concatenate(parts)
    size = windows + WIDTH - 1
    start = np.cumsum(size) - size
    h = _anchor_hashes(data, start + offset)
    order = np.argsort(h, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    group = np.repeat(np.arange(len(cuts)), np.diff(cuts, append=len(order)))
    shared = np.minimum.reduceat(doc[order], cuts) < np.maximum.reduceat(doc[order], cuts)
    keep = np.zeros(len(order), bool)
    keep[order[shared[group]]] = True
    if not keep.any():
        return (np.zeros(0, np.int64),) * 4
    data = data[np.repeat(keep, size)]
    doc, sig, first, windows, size, h = (x[keep] for x in (doc, sig, first, windows, size, h))
    start = np.cumsum(size) - size
    one, two = _segment_hashes(data, start, size)
    # Different segments of each anchor, with the smallest doc_id of each.
    order = np.lexsort((doc, two, one, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | ~_copies(data, start, size, order, one, two)])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    lead = order[new]
    least = doc[lead]
    bounds = np.concatenate([[0], np.cumsum(windows[lead])])
    window_least = np.repeat(least, windows[lead])
    _match_windows(data, start[lead], size[lead], h[lead], least, bounds, window_least)
    # Every record's windows against its own doc_id.
    at = _spread(bounds[which], windows)
    lost = window_least[at] < np.repeat(doc, windows)
    record = np.repeat(np.arange(len(doc)), windows)[lost]
    begin = _spread(first, windows)[lost]
    new = np.flatnonzero(np.concatenate([[True], (record[1:] != record[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(record) else record
    last = np.append(new[1:], len(record))[: len(new)] - 1
    return doc[record[new]], sig[record[new]], begin[new], begin[last] + WIDTH


def _chunk(doc: str, sig: str, chunks: int):
    return F.pmod(F.xxhash64(F.col(doc).cast("long"), sig), F.lit(chunks))


def _texts(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """Number, signature and bytes of a chunk's documents that can hold a string of WIDTH bytes."""
    rows = zip(*(table[c].to_pylist() for c in ("doc_id", "sig_", "packed_", "size_")), strict=True)
    return [(d, s, pa.decompress(t, n, "zstd", asbytes=True)) for d, s, t, n in rows if d is not None and (n or 0) >= WIDTH]


def _repeated_spans(packed: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """(doc, sig, start, stop): spans of bytes of documents covered by strings that a smaller doc_id holds."""
    hot = HOT_CHUNKS
    columns = ("part", pa.int64()), ("doc", pa.int64()), ("sig", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("blob", pa.binary())

    def made(rows: list[tuple], named) -> pa.Table:
        values = zip(*rows, strict=True) if rows else [[]] * len(named)
        return pa.table([pa.array(v, t) for v, (_, t) in zip(values, named, strict=True)], [n for n, _ in named])

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = [(b, key[0].as_py(), h) for b, h in _ask(_texts(table), buckets)]
        return made(rows, (("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary())))

    def tell(table: pa.Table) -> pa.Table:
        rows = list(_tell(table["chunk"].to_pylist(), table["hashes"].to_pylist(), hot))
        return made(rows, (("chunk", pa.int64()), ("hashes", pa.binary())))

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in told["hashes"].to_pylist())]))
        return made(list(_cut_chunk(_texts(table), buckets, shared)) if len(shared) else [], columns)

    def settle(table: pa.Table) -> pa.Table:
        given = table.filter(pa.compute.is_valid(table["doc"])).select(["doc", "sig", "start", "stop"])
        tables = [b for b in table["blob"].to_pylist() if b is not None]
        if not tables:
            return given
        found = [pa.array(v, t) for v, (_, t) in zip(_settle(tables), columns[1:5], strict=True)]
        return pa.concat_tables([given, pa.table(found, ["doc", "sig", "start", "stop"]).cast(given.schema)])

    asked = packed.groupBy("chunk_").applyInArrow(ask, "bucket long, chunk long, hashes binary")
    told = asked.groupBy("bucket").applyInArrow(tell, "chunk long, hashes binary")
    sent = packed.groupBy("chunk_").cogroup(told.groupBy("chunk")).applyInArrow(send, f"part long, {_FOUND}, blob binary")
    return sent.groupBy("part").applyInArrow(settle, _FOUND)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without text, but with kept binary, n_bytes long and spans array<struct<start, stop>>.

    Every byte is removed that a WIDTH-byte string covers which also starts in a document with a
    smaller doc_id; strings are judged on the input. spans are the maximal removed runs, in bytes of
    the text's UTF-8; kept is the rest, which may cut characters. Null text counts as empty. A null
    doc_id is smaller than none and larger than none. Rows that repeat a doc_id are parts of one
    document and never evidence against each other; rows of one text and doc_id share a chunk. A very
    long text is held whole by its chunk's task. An empty table gives an empty table.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks, buckets = max(1, math.ceil(total / CHUNK_BYTES)), max(8, math.ceil(total / BUCKET_BYTES))
    signed = docs.withColumn("sig_", F.xxhash64("text")).withColumn("chunk_", _chunk("doc_id", "sig_", chunks))
    # Texts travel compressed, once: all that reads chunks reads the same exchange.
    packed = map_texts(signed, lambda: lambda texts: [[None if t is None else pa.compress(t.encode(), "zstd", asbytes=True) for t in texts], [None if t is None else len(t.encode()) for t in texts]], "packed_ binary, size_ int", drop=("text",))
    found = _repeated_spans(packed, chunks, buckets).withColumn("chunk", _chunk("doc", "sig", chunks))
    kept = [f for f in docs.schema.fields if f.name not in ("text", "kept", "n_bytes", "spans")]
    schema = T.StructType([*kept, *T._parse_datatype_string("kept binary, n_bytes long, spans array<struct<start:long,stop:long>>").fields])
    added = to_arrow_schema(T.StructType(schema.fields[len(kept) :]))

    def finish(table: pa.Table, lost: pa.Table) -> pa.Table:
        doc, sig, start, stop = (lost[c].to_numpy() for c in ("doc", "sig", "start", "stop"))
        spans = {}
        for d, s, a, b in zip(*(x.tolist() for x in _by_document(doc, sig, start.astype(np.int64), stop.astype(np.int64))), strict=True):
            spans.setdefault((d, s), []).append((a, b))
        rows = []
        for d, s, t, n in zip(*(table[c].to_pylist() for c in ("doc_id", "sig_", "packed_", "size_")), strict=True):
            data = b"" if t is None else pa.decompress(t, n, "zstd", asbytes=True)
            gone = spans.get((d, s), [])
            edges = [0, *(x for span in gone for x in span), len(data)]
            rows.append((b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), n or 0, [{"start": i, "stop": j} for i, j in gone]))
        arrays = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, added, strict=True)]
        return pa.table([*(table[f.name] for f in kept), *arrays], [f.name for f in schema.fields])

    return packed.groupBy("chunk_").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)
