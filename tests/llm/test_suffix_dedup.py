import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.llm import suffix_dedup

from .conftest import pairs


def brute(rows, width=50):
    """doc_id, bytes, removed bytes, runs and hash of the rest, from a dictionary of all strings."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, b in data:
        lost = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                lost[i : i + width] = b"\1" * width
        runs = sum(1 for i, x in enumerate(lost) if x and (i == 0 or not lost[i - 1]))
        out.append((d, len(b), sum(lost), runs, hashlib.sha256(bytes(x for x, y in zip(b, lost, strict=True) if not y)).hexdigest()))
    return sorted(out)


def result(df):
    kept = suffix_dedup.remove_repeats(df)
    return sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in kept.collect())


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_against_all_strings(request, name):
    df = request.getfixturevalue(name).where("coalesce(length(text), 0) < 60000")
    assert result(df) == brute(pairs(df))


def test_long_texts(awkward):
    rows = {r[0]: r for r in result(awkward)}
    assert rows[16][2] == 0 and rows[17][2] == rows[17][1]


def test_empty_and_null_ids(spark, nothing):
    assert result(nothing) == []
    text = "z1" * 60
    df = spark.createDataFrame([(None, text), (5, text), (9, text)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["kept"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {None: 120, 5: 120, 9: 0}


PARTS = [b"abracadabra" * 6, b"abracadabra" * 5 + b"xyz" * 6, bytes(range(97, 123)) * 3]


def longest(pattern, parts):
    """Length of the longest match in a part from each place of the pattern."""
    return [max(n for n in range(len(pattern) - i + 1) if any(pattern[i : i + n] in p for p in parts)) for i in range(len(pattern))]


def index_of(parts):
    return suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), np.arange(len(parts)) + 7)


def test_index_of_repetitive_segments():
    index = index_of(PARTS)
    assert len(index.head) < index.n / 2  # runs
    for pattern in (b"cadabraabracadab", b"abracadabra" * 3, b"zzzabrac?adabraxyzxyzabra", b"\0\xff", PARTS[1]):
        assert index.matching_statistics(pattern) == longest(pattern, PARTS)
    assert index.jumps > 0  # samples of run ends were used


def test_matching_statistics_of_random_texts():
    rng = np.random.default_rng(5)
    for letters in (2, 4):
        parts = [bytes(rng.integers(97, 97 + letters, rng.integers(50, 90)).tolist()) for _ in range(20)]
        index = index_of(parts)
        for _ in range(10):
            pattern = bytes(rng.integers(97, 98 + letters, 60).tolist()) + parts[3][:30]
            assert index.matching_statistics(pattern) == longest(pattern, parts)
        index.first_sample = index.last_sample = np.full_like(index.last_sample, index.stops[0])
        assert index.matching_statistics(pattern) != longest(pattern, parts)  # the samples of run ends count


def covered(blobs):
    """Bytes that each document loses in a bucket."""
    found = {}
    for d, _, a, b in zip(*suffix_dedup._settle(blobs), strict=True):
        found.setdefault(int(d), bytearray(500))[a:b] = b"\1" * (b - a)
    return {d: sum(x) for d, x in found.items()}


@pytest.mark.parametrize("broken", ["least", "runs", "hashes"])
def test_the_index_decides(spark, monkeypatch, broken):
    """Without the index's answers nothing is removed between different segments; without hashes all is found."""
    shared = "the quick brown fox jumps over the lazy dog while it rains on the hills and far away"
    rows = [(i, f"{'abcdefghij'[i]}{i * 7919} " * 3 + shared[i:] + f" {i * 104729}{'klmnopqrst'[i]}" * 3) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    if broken == "hashes":  # all windows look alike, and so do all segments
        monkeypatch.setattr(suffix_dedup, "_slice_hashes", lambda sums, start, stop: [np.zeros(len(start), np.uint64)] * 2)
        blobs = [r[-1] for r in suffix_dedup._cut_chunk([(d, 0, t.encode()) for d, t in rows], 1) if r[-1] is not None]
        assert covered(blobs) == {r[0]: r[2] for r in brute(rows) if r[2]}
        return
    assert result(df) == brute(rows)
    whole = suffix_dedup.RunLengthIndex.__init__

    def spoilt(self, data, sizes, least):
        whole(self, data, sizes, least)
        if broken == "least":
            self.least = np.full_like(self.least, 1 << 40)
        else:
            self.lf = np.zeros_like(self.lf)

    monkeypatch.setattr(suffix_dedup.RunLengthIndex, "__init__", spoilt)
    blobs = [r[-1] for r in suffix_dedup._cut_chunk([(d, 0, t.encode()) for d, t in rows], 1) if r[-1] is not None]
    assert sum(covered(blobs).values()) < sum(r[2] for r in brute(rows)) * 0.5


def test_other_columns_stay(awkward):
    out = suffix_dedup.remove_repeats(awkward)
    assert set(out.columns) == set(awkward.columns) - {"text"} | {"kept", "n_bytes", "spans"}
    assert out.where(F.col("lang") == "keep").count() == awkward.count()


def test_hot_anchors_are_split(spark, sample, monkeypatch):
    """As if every anchor were that of very many chunks, in small chunks and buckets."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 15)
    monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", 2)
    df = sample.where("length(text) < 20000")
    assert result(df) == brute(pairs(df))
    texts = [(i, 0, t.encode()) for i, t in pairs(df)]
    asked = [(b, i % 3, h) for i in range(3) for b, h in suffix_dedup._ask(texts[i::3], 1)]
    told = list(suffix_dedup._tell([c for _, c, _ in asked], [h for *_, h in asked], 2))
    assert any((np.frombuffer(h, np.uint64) & np.uint64(1)).any() for _, h in told)
