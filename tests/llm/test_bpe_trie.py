import hashlib

import pytest

from fluvia.llm import bpe_trie

from .conftest import pairs

ODD = ["İstanbul ΣΊΣΥΦΟΣ ǅ ﬁne", "á ë", "𝒳 emoji 👩‍👩‍👧 flags 🇩🇪", "​zero﻿width", "tabs\tand\x0bfeeds\x85nel sep", "'s 're don't I'LL", "١٢٣ 12.5 ½ ²", "<|startoftext|>a<|endoftext|><|endoftext|>", "x" * 300, "\x00\x1f control", "日本語テキスト한국어", "ſ K Å ı", "!?!?...---___", "²³¹ \xa0 nbsp"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_odd_texts(library):
    encoder = bpe_trie.TrieEncoder(bpe_trie.tokenizer_path())
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_against_library(request, library, name):
    df = request.getfixturevalue(name)
    want = []
    for d, t in pairs(df):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe_trie.encoding_digests(df).collect()]
    assert sorted(got) == sorted(want)


def test_round_trip_and_empty_table(awkward, nothing):
    encoded = bpe_trie.encode_documents(awkward)
    assert dict(encoded.dtypes)["ids"] == "array<int>"
    rows = {r["doc_id"]: r for r in bpe_trie.decode_documents(encoded).collect()}
    assert rows[1]["decoded"] == "" and rows[10]["decoded"] == "one</w>" and rows[16]["lang"] == "keep"
    assert bpe_trie.encoding_digests(nothing).count() == 0
