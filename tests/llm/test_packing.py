import random
import struct
import zlib

import pytest

from fluvia.llm import packing
from fluvia.llm.bpe_trie import tokenizer_path

from .conftest import pairs


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_every_id_lies_in_one_piece(request, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    df = request.getfixturevalue(name).dropDuplicates(["doc_id"])
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in pairs(df)}
    rows = packing.pack_documents(df).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert docs.keys() == ids.keys()
    for d, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[d])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_padding_is_small(sample):
    rows = packing.pack_documents(sample.coalesce(1), with_ids=False).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert pad / sum(sizes.values()) < 0.01, pad


def test_differencing_is_near_equal_and_window_count_rises():
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 20):
        sizes = [rng.randint(1, 500) for _ in range(40 * k)]
        groups = packing.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert max(sums) - min(sums) <= max(sizes) // 10
    assert packing.difference([], 3) == [[], [], []]
    assert len(packing.windows_for([6, 6, 6], 10)) == 3  # two windows would hold 18 of 20, but not uncut
    assert [sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.windows_for([8, 7, 6, 5, 4], 16)]


def test_empty_table(nothing):
    assert packing.pack_documents(nothing).count() == 0
