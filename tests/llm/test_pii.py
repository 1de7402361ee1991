import hashlib
import random
import re
import time

import pytest

from fluvia.llm import pii

from .conftest import pairs

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in BASE.items() for m in p.finditer(text or "") if valid(k, m[0])]


def join(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_base_kinds_against_plain_patterns(request, name):
    df = request.getfixturevalue(name)
    want = sorted((d, *(sum(s[0] == k for s in plain(t)) for k in BASE), hashlib.sha256(join(plain(t)).encode()).hexdigest()) for d, t in pairs(df))
    rows = pii.span_digests(df).collect()
    assert sorted(tuple(r)[:6] for r in rows) == want
    for r in rows:
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_base_kinds_on_random_strings():
    rng, finder = random.Random(8), pii.PersonalData()
    for _ in range(20000):
        s = "".join(rng.choice("01479..@@a-b+  ()x4") for _ in range(rng.randint(1, 40)))
        assert [x for x in finder.find(s) if x[0] in BASE] == plain(s), s


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, lives at 12 Green Hill Road. See https://user:pw@host.org/x"
    found = {k: text[a:b] for k, a, b in pii.PersonalData().find(text)}
    assert found["account"] == "DE89 3704 0044 0532 0130 00"
    assert found["address"] == "12 Green Hill Road"
    assert found["url"] == "https://user:pw@host.org"


def test_masking_and_long_texts(spark, awkward, nothing):
    rows = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(awkward).collect()}
    assert rows[1] is None and rows[10] == "one" and "<CARD>" in rows[15]
    assert rows[14] == "mail <EMAIL> or x@y, call <PHONE> now, 10.0.0.256 and <IP>"
    assert pii.find_personal_data(nothing).count() == 0
    assert dict(pii.find_personal_data(awkward).dtypes)["spans"].startswith("array<struct")
    long = spark.createDataFrame([(1, "1 " * 300000), (2, "a." * 300000), (3, "+1" + "(" * 300000), (4, "a@" * 200000)], "doc_id long, text string")
    assert pii.span_digests(long).count() == 4


#: Runs of each class of characters, and of the beginnings of all kinds.
RUNS = ["0", "7", ".", "a", "Z", "@", "+", " ", "-", "(", ")", "/", ":", "%", "_", "\n", "é", "0.", "1.2.3.", "a.", "a@", "@a", "a@b.", "+1", "+1 ", "1 ", "1-", "4111 ", "http://", "http://a:b", "ssh://u:", "Street ", "12 Street ", "Aa ", "iban:", "account 1", "<", "日"]
ENDS = ["", ".1.2.3", "@host.org", "12345678901", " Street", ":pw@host.org", "1"]


def test_long_runs_of_each_class():
    finder = pii.PersonalData()
    for run in RUNS:
        for end in ENDS:
            for text in (run * (2500 // len(run)) + end, end + run * (2500 // len(run))):
                assert [x for x in finder.find(text) if x[0] in BASE] == plain(text), (run, end)


def test_very_long_runs_take_linear_time(spark):
    rows = [(i, run * (600_000 // len(run)) + end) for i, (run, end) in enumerate((r, e) for r in RUNS for e in ENDS[1:3])]
    began = time.time()
    assert pii.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).where("text is not null").count() == len(rows)
    assert time.time() - began < 120


def test_digits_beyond_what_int_reads():
    assert pii.PersonalData().find("0" * 5000 + ".1.2.3")[0] == ("ip", 0, 5006)
    assert [x for x in pii.PersonalData().find("9" * 5000 + ".1.2.3") if x[0] == "ip"] == []


def test_no_caps_on_credentials_and_streets():
    token, name = "t" * 700, "G" + "r" * 500
    text = f"https://user{token}:{token}@host.org/x and 17b {name} Hill Road, 123456 Green Road, 12 green Road, 9 A Road"
    found = [(k, text[a:b]) for k, a, b in pii.PersonalData().find(text)]
    assert ("url", f"https://user{token}:{token}@host.org") in found
    assert [v for k, v in found if k == "address"] == [f"17b {name} Hill Road"]
