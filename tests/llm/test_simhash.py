import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fluvia.llm import simhash

from .conftest import pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict):
    """Smallest linked id of each fingerprint, by comparing all pairs."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for d, v in prints.items():
        r = find(v)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(v)] for d, v in prints.items()}


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_against_all_pairs(request, name):
    df = request.getfixturevalue(name)
    prints = {d: plain_fingerprint(t) for d, t in pairs(df)}
    want = components(prints)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(d, f"{v:016x}", want[d]) for d, v in prints.items()}


@pytest.mark.parametrize("held", [1 << 21, 20])
def test_large_buckets_lose_no_link(spark, monkeypatch, held):
    """A dense cloud of fingerprints, expanded in small slices and with codes of several lengths."""
    rng = random.Random(4)
    seen = {0}
    while len(seen) < 500:
        v = rng.choice(sorted(seen)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        seen.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in seen]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    monkeypatch.setattr(simhash, "SLICE", 5000)
    monkeypatch.setattr(simhash, "HELD", held)
    links = [(r["a"], r["b"]) for r in simhash.link_fingerprints(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    want = components({v: v & (1 << 64) - 1 for v in signed})
    from fluvia.llm.components import connected_components

    root = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    by_root, by_want = {}, {}
    for v in signed:
        by_root.setdefault(root.get(v, v), set()).add(v)
        by_want.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_one_of_each_group_stays(awkward, nothing):
    kept = simhash.keep_one_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    want = simhash.near_duplicates(awkward).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    assert ids == sorted(r["doc_id"] for r in want.collect()) and 17 not in ids and 16 in ids
    assert simhash.near_duplicates(nothing).count() == 0


def test_groups_are_of_rows(spark):
    """Null doc_ids and one doc_id with different texts lose nothing but near copies."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    rows = [(None, "a"), (None, "a"), (None, "b"), (1, "b"), (2, "c"), (2, "d"), (3, "c"), (4, "e"), (5, "e"), (5, "f"), (5, "f")]
    df = spark.createDataFrame([(i, text[k], k) for i, k in rows], "doc_id long, text string, fp string").repartition(4)
    got = sorted((r["fp"], r["doc_id"]) for r in simhash.keep_one_each(df).collect())
    assert got == [("a", None), ("b", 1), ("c", 2), ("d", 2), ("e", 4), ("f", 5)]


def test_codes_of_all_variants():
    """A fingerprint is sent to the code of every variant within two bits, and meets there."""
    import numpy as np

    value = np.array([0x0123456789ABCDEF], np.uint64)
    for bits in (8, 12, 20):
        flips = simhash._flips(bits)
        every = np.concatenate([np.concatenate(v) for v in flips.values()])
        assert len(np.unique(every)) == len(every) == 1 + 64 + 2016
        for change, (near, far) in flips.items():
            for part in (near, far):
                assert (simhash.codes(value ^ part, bits) == simhash.codes(value, bits)[0] ^ change).all()
