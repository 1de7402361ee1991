"""BPE encoding and decoding over a prefix-sharing trie.

The distinct words of a batch are inserted into a trie whose edges are bytes. A depth-first walk
gives each node the last token of the encoding of the prefix that it stands for: the longest token
that ends there and forms a stable pair with the last token before it. Prefixes that words share
are therefore encoded once, and a word's ids are read by stepping back from its leaf.
Words recur, so their encodings stay in a bounded table per worker process; no data is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from fluvia.llm.common import map_texts

#: Words whose encodings a process keeps at most; the table is emptied when full.
MEMO_WORDS = 750_000
#: Pairs of tokens of which a process keeps whether merging leaves them apart.
MEMO_PAIRS = 2_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes as the tokenizer file says: normaliser, split, then merges with word ends.

    forms: in which forms encodings of words are kept: "raw" (bytes of ids), "ids" and "text".
    """

    #: Characters for which this module's own normaliser and split are used; others go through the library's.
    _SAFE = [chr(c) for c in (*range(0x300), *range(0x2010, 0x2028), 0x20AC)]

    def __init__(self, path: str, forms: tuple[str, ...] = ("raw", "ids", "text")):
        self.forms = forms
        spec = json.load(open(path, encoding="utf-8"))
        model, symbols = spec["model"], _byte_symbols()
        self.path, self.suffix = path, model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.rank, self.split = {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = made
            self.rank.setdefault(made, rank)
            self.split.setdefault(made, (vocab[a], vocab[b]))
        inner, final = {}, {}
        sound: set[int] = set()
        for text, i in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            if i in self.split:
                a, b = self.split[i]
                if not (a in sound and b in sound and self._stable(a, b, self.rank[i])):
                    continue
            sound.add(i)
            ends = text.endswith(self.suffix)
            body = text.removesuffix(self.suffix) if ends else text
            (final if ends else inner)[bytes(symbols[c] for c in body)] = i
        self.inner, self.final = inner, final
        self.inner_lengths, self.final_lengths = map(self._lengths, (inner, final))
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = {c: unicodedata.category(c)[0] for c in self._SAFE}
        white = "\t-\r \x85\xa0  -     　"
        letters = "".join(map(re.escape, (c for c in self._SAFE if kinds[c] == "L")))
        digits = "".join(map(re.escape, (c for c in self._SAFE if kinds[c] == "N")))
        self.unsafe = re.compile(f"[^{re.escape(''.join(self._SAFE))}]")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{white}{letters}{digits}]+")
        self._library = None
        self._symbols = symbols
        self.stable: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    @staticmethod
    def _lengths(tokens: dict[bytes, int]) -> dict[bytes, list[int]]:
        """Lengths of the tokens that end in a given way, longest first: by their last four bytes, and by
        fewer for text whose last four end no token of four bytes or more."""
        short = lambda k: [n for n in (3, 2, 1) if n <= len(k) and k[len(k) - n :] in tokens]
        by: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) >= 4:
                by.setdefault(t[-4:], set()).add(len(t))
        return {k: sorted(v, reverse=True) + short(k) for k, v in by.items()} | {t: short(t) for t in tokens if len(t) < 4}

    def _stable(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        """Whether merging leaves tokens a and b apart when they stand side by side (merges below limit count)."""
        rank, split, pair = self.rank, self.split, self.pair
        while True:
            made = pair.get((a, b))
            if made is not None and rank[made] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # The later merge of the two is undone: before it, its inner part faced the other token.
            if ra > rb:
                limit, a = min(limit, ra), split[a][1]
            else:
                limit, b = min(limit, rb + 1), split[b][0]

    def _last(self, word: bytes, end: int, last: list[int], tokens: dict[bytes, int], lengths: dict[bytes, list[int]]) -> tuple[int, int]:
        """Last token of word[:end] and where it starts; last: the last tokens of the shorter prefixes."""
        stable, get = self.stable, lengths.get
        low = end - 4 if end > 4 else 0
        for n in get(word[low:end]) or get(word[max(low, end - 3) : end]) or get(word[max(low, end - 2) : end]) or get(word[end - 1 : end], ()):
            if n <= end and (t := tokens.get(word[end - n : end])) is not None:
                if n == end:
                    return t, 0
                pair = last[end - n], t
                if (apart := stable.get(pair)) is None:
                    if len(stable) > MEMO_PAIRS:
                        stable.clear()
                    apart = stable[pair] = self._stable(*pair)
                if apart:
                    return t, end - n
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words.

        Sorted words are their trie, laid out depth first: what a word has in common with the one
        before it is the path to the node where it branches off. last[d] and start[d] hold the last
        token, and where it begins, for the node at depth d of the current path; only nodes below
        the branch are computed. A word's leaf is its end with the vocabulary's word-end tokens.
        """
        out: list[list[int]] = []
        last, start = [-1] * 64, [0] * 64
        before, inner, final, mid_len, end_len = b"", self.inner, self.final, self.inner_lengths, self.final_lengths
        for word in words:
            n, most = len(word), min(len(before), len(word)) - 1
            if n > len(last):
                last += [-1] * n
                start += [0] * n
            same = 0
            while same < most and before[same] == word[same]:
                same += 1
            for end in range(same + 1, n):
                last[end], start[end] = self._last(word, end, last, inner, mid_len)
            t, at = self._last(word, n, last, final, end_len)
            ids = [t]
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def _split(self, text: str) -> list[str]:
        """Words of a text, normalised. White space only separates, so its kinds need not be made equal."""
        if text.isascii() or not self.unsafe.search(text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._symbols[c] for c in p).decode() for p, _ in pieces]

    def _pieces(self, text: str | None) -> list[str]:
        """Words of a text; special tokens stand as themselves."""
        if not text:
            return []
        if self.special_re is None or not self.special_re.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self._split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._split(text[at:])

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """Words of each text, after one trie has encoded all those that the table lacks."""
        pieces = [self._pieces(t) for t in texts]
        known = getattr(self, self.forms[0])
        new = set().union(*pieces).difference(known)
        if new and len(known) + len(new) > MEMO_WORDS:
            for memo in (self.ids, self.raw, self.text):
                memo.clear()
            new = set().union(*pieces)
        words = sorted(w.encode() for w in new - self.special.keys())
        coded = [*((w.decode(), ids) for w, ids in zip(words, self.encode_words(words), strict=True)), *((w, [self.special[w]]) for w in new & self.special.keys())]
        if "raw" in self.forms:
            self.raw.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in coded)
        if "ids" in self.forms:
            self.ids.update((w, " ".join(map(str, ids))) for w, ids in coded)
        if "text" in self.forms:
            self.text.update((w, " ".join([self.token[i] for i in ids])) for w, ids in coded)
        return pieces

    def encode_raw(self, words: list[str]) -> bytes:
        """Ids of prepared words as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.raw.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null or empty: none."""
        raw = self.encode_raw(*self.prepare([text]))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(self.token[i] for i in ids)

    def digest(self, words: list[str]) -> tuple[int, str, str]:
        """Of prepared words: number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        ids = " ".join(map(self.ids.__getitem__, words))
        decoded = " ".join(map(self.text.__getitem__, words))
        n = ids.count(" ") + 1 if words else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str, *forms: str) -> TrieEncoder:
    """This process's encoder for a file: Spark's Python workers outlive tasks, and so do its words."""
    return TrieEncoder(path, forms)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids array<int> of the whole text. Null or empty text: no ids. Other columns stay."""

    def make():
        encoder = shared_encoder(path or tokenizer_path(), "raw")
        return lambda texts: [[np.frombuffer(encoder.encode_raw(w), np.int32) for w in encoder.prepare(texts)]]

    return map_texts(docs, make, "ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded string, from its ids. Null ids: empty text. Other columns stay."""

    def make():
        encoder = shared_encoder(path or tokenizer_path(), "raw")
        return lambda ids: [[encoder.decode(x or []) for x in ids]]

    return map_texts(encoded, make, "decoded string", text="ids")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text (null: empty).

    Both directions run per word in one pass, so ids and decoded text are hashed where they are
    made. Repeated rows get equal values; an empty table gives an empty table.
    """

    def make():
        encoder = shared_encoder(path or tokenizer_path(), "ids", "text")
        return lambda texts: list(zip(*map(encoder.digest, encoder.prepare(texts)), strict=True)) or [[], [], []]

    return map_texts(docs.select("doc_id", "text"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop=("text",))
