"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, schemes and words that
announce an account or a street address. A small parser for each kind expands an anchor to the
whole value and validates it. Four kinds (email, ip, card, phone) have fixed grammars; accounts,
addresses and credentials in URLs are added on top and never displace those.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from fluvia.llm.common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "address", "url")
KINDS = BASE_KINDS + ADDED_KINDS

#: Words that announce an account or identifier, and words that end a street name.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "user id", "userid", "customer id", "ssn", "konto", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "boulevard", "lane", "road", "drive")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\s?(?:no|number|nr)\.?)?\s?[:#=]\s?([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.I)
# A slash ends both, so that attempts from several schemes don't read the same text twice.
_USERINFO = re.compile(r"[^\s/@:<>\"']++:[^\s/@<>\"']++@[A-Za-z0-9.-]++")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def street_start(text: str, at: int, low: int) -> int | None:
    """Where an address begins that ends with the street cue at `at`: a house number of one to five digits, perhaps a
    letter, and one to three capitalised words before the cue; read backwards, not below low."""
    end = at
    for _ in range(3):
        last = end - 1
        if last < low or text[last] != " ":
            return None
        first = last
        while first > low and "a" <= text[first - 1] <= "z":
            first -= 1
        if first == last or first <= low or not "A" <= text[first - 1] <= "Z":
            return None
        end = first - 1
        stop = end - 1
        if stop > low and text[stop] == " ":
            if "A" <= text[stop - 1].upper() <= "Z":
                stop -= 1
            start = stop
            while start > low and stop - start < 6 and "0" <= text[start - 1] <= "9":
                start -= 1
            if 1 <= stop - start <= 5 and (start == low or not (text[start - 1].isalnum() or text[start - 1] in "_.")):
                return start
    return None


def _octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for c in "0123456789":
        anchors.add_word(c, ("digit", 1))
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            anchors.add_word(form, ("account", len(form)))
    for cue in STREET_CUES:
        anchors.add_word(cue.capitalize(), ("street", len(cue)))
    for scheme in SCHEMES:
        anchors.add_word(scheme, ("url", len(scheme)))
    anchors.make_automaton()
    return anchors


class PersonalData:
    """Finds spans (kind, start, end) in a text, in code points, end exclusive."""

    def __init__(self):
        self.anchors = _automaton()

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans, by kind as in KINDS, then by start. Null or empty text: none."""
        if not text:
            return []
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        # Up to where each kind's grammar has read: matches of a kind don't overlap, failing ones included.
        read = dict.fromkeys(KINDS, 0)
        for last, (anchor, size) in self.anchors.iter(text):
            at = last + 1 - size
            if anchor == "digit":
                run_start = at == 0 or not ("0" <= text[at - 1] <= "9")
                if run_start and at >= read["ip"] and (m := _IP.match(text, at)):
                    read["ip"] = m.end()
                    if all(map(_octet, m[0].split("."))):
                        found["ip"].append(m.span())
                if at >= read["card"] and (m := _CARD.match(text, at)):
                    read["card"] = m.end()
                    digits = re.sub("[ -]", "", m[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            elif anchor == "at":
                start = at
                while start > read["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    read["email"] = m.end()
                    found["email"].append((start, m.end()))
                elif start < at:
                    read["email"] = at  # what was read up to here can't start another address
            elif anchor == "plus":
                if at >= read["phone"] and (m := _PHONE.match(text, at)):
                    read["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif anchor == "account":
                if at >= read["account"] and (m := _ACCOUNT.match(text, last + 1)) and sum("0" <= c <= "9" for c in m[1]) >= 4:
                    read["account"] = m.end()
                    found["account"].append(m.span(1))
            elif anchor == "street":
                if at >= read["address"] and not text[last + 1 : last + 2].isalnum():
                    start = street_start(text, at, read["address"])
                    if start is not None:
                        read["address"] = last + 1
                        found["address"].append((start, last + 1))
            elif at >= read["url"] and (m := _USERINFO.match(text, last + 1)):
                read["url"] = m.end()
                found["url"].append((at, m.end()))
        return [(k, a, b) for k in KINDS for a, b in found[k]]


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with spans array<struct<kind, start, end>> over the whole text; other columns stay.

    Null or empty text: no spans. Very long texts are read in one linear pass. Repeated rows get
    equal spans; an empty table stays empty; a column named spans is replaced.
    """

    def make():
        finder = PersonalData()
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in finder.find(t)] for t in texts]]

    return map_texts(docs, make, "spans array<struct<kind:string,start:int,end:int>>")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; overlapping spans become one, named after the first.

    Null text stays null; texts without spans, other columns and the number of rows stay as they are.
    """

    def make():
        finder = PersonalData()

        def mask(text):
            out, at = [], 0
            for kind, a, b in sorted(finder.find(text), key=lambda x: (x[1], -x[2])):
                if a >= at:
                    out += [text[at:a], f"<{kind.upper()}>"]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        return lambda texts: [[mask(t) for t in texts]]

    return map_texts(docs, make, "text string")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row's whole text (null: empty)."""

    def make():
        finder = PersonalData()

        def work(texts):
            rows = []
            for t in texts:
                spans = finder.find(t)
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
            return list(zip(*rows, strict=True))

        return work

    return map_texts(docs.select("doc_id", "text"), make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", drop=("text",))
