import hashlib
import inspect
import re
import string

import pytest
import regex

from fluvia.llm import secret_scan

from .conftest import pairs

SECRET = "ghp_Zk39sLq82MxP01aBcD45eFgH67iJkL89mNoP"


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train_forest(spark)


def test_planted_findings(spark, forest, awkward):
    texts = [
        (1, f'config token = "{SECRET}" end'),
        (2, "see commit 0123456789abcdef0123456789abcdef01234567 for it"),
        (3, "password: aZ8kQ2mX7pL4vN9bT6yR1c\n" * 2),
        (4, "docs/user/guide/chapter12.html and https://host.example/image/static/logo2024.png"),
        (5, None),
        (6, "é" * 50 + f" api_key='{SECRET[4:]}'"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = secret_scan.scan_secrets(df, forest).collect()
    by = {}
    text = dict(texts)
    for r in rows:
        found = text[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(found.encode()).hexdigest() == r["secret_sha256"]
        by.setdefault(r["doc_id"], []).append(found)
    assert by[1] == [SECRET] and by[6] == [SECRET[4:]] and len(by[3]) == 2
    assert 2 not in by and 4 not in by and 5 not in by
    again = {r["doc_id"] for r in secret_scan.scan_secrets(awkward, forest).collect()}
    assert again == {15}


def test_held_out_findings(spark, forest):
    unseen = secret_scan.labelled_findings(200, seed=99)
    rows = [(i, b + c + a) for i, (b, c, a, _) in enumerate(unseen)]
    found = {(r["doc_id"], r["start"]) for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()}
    right = sum((any(d == i for d, _ in found)) == bool(y) for i, (*_, y) in enumerate(unseen))
    assert right / len(unseen) > 0.95


def test_positions_on_the_tables(forest, sample):
    text = dict(pairs(sample))
    for r in secret_scan.scan_secrets(sample, forest).collect():
        found = text[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(found.encode()).hexdigest() == r["secret_sha256"]


def test_no_python_in_the_plan(spark, forest, sample, nothing):
    found = secret_scan.scan_secrets(sample, forest)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert not any(w in inspect.getsource(secret_scan) for w in ("udf", "mapIn", "applyIn", ".rdd"))
    assert secret_scan.scan_secrets(nothing, forest).count() == 0


def test_exact_spans_of_assigned_values(spark, forest):
    key, letters = "aZ8kQ2mX7pL4vN9bT6yR1cW3", "qZkTbWmXpLrVnJdYhRgCsFwK"
    texts = [
        (1, f"API_KEY={key}\nDEBUG=1", key),
        (2, "token=0123456789abcdef0123456789abcdef01234567 rest", "0123456789abcdef0123456789abcdef01234567"),
        (3, f"https://host.example/get?page=2&access_token={key}&lang=en", key),
        (4, f'secret = "{letters}"', letters),
        (5, "password: hunter2Secret\n", "hunter2Secret"),
        (6, "secret=QWxhZGRpbjpvcGVuIHNlc2FtZQ==\n", "QWxhZGRpbjpvcGVuIHNlc2FtZQ=="),
        (7, "an internationalization of the configurationElement and ================", None),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {}
    for r in secret_scan.scan_secrets(df, forest).collect():
        got.setdefault(r["doc_id"], []).append(texts[r["doc_id"] - 1][1][r["start"] : r["start"] + r["length"]])
    assert got == {i: [want] for i, _, want in texts if want}


CUE, OTHER = (re.compile(p, re.A) for p in (f"(?i)({secret_scan.SECRET_CUES})[^\\s]{{0,16}}\\s{{0,2}}[=:]?\\s{{0,2}}[\"'`]?$", f"(?i)({secret_scan.OTHER_CUES})[^\\n]{{0,24}}$"))


def plain_features(c, before, after):
    """The features of a candidate, one at a time."""
    share = lambda letters: sum(x in letters for x in c) / len(c)
    kinds = ["a" if x.isascii() and x.isalpha() and x.islower() else "A" if x.isascii() and x.isupper() else "0" if x in "0123456789" else x for x in c]
    low, covered, i = c.lower(), 0, 0
    words = sorted(secret_scan.DICTIONARY, key=lambda w: (-len(w), w))
    while i < len(low):
        hit = next((w for w in words if low.startswith(w, i)), None)
        covered, i = (covered + len(hit), i + len(hit)) if hit else (covered, i + 1)
    pairs, i = 0, 0
    while i < len(low) - 1:
        hit = low[i : i + 2] in secret_scan.COMMON_PAIRS.split("|")
        pairs, i = pairs + hit, i + 1 + hit
    last = before[:-1] if before.endswith("\n") else before
    return {
        "size": len(c),
        "digits": share("0123456789"),
        "uppers": share(string.ascii_uppercase),
        "marks": share("+/_=-"),
        "classes": sum(any(x in s for x in c) for s in (string.ascii_lowercase, string.ascii_uppercase, string.digits)),
        "changes": sum(a != b for a, b in zip(kinds, kinds[1:])) / len(c),
        "variety": len(set(c)) / len(c),
        "pairs": 2 * pairs / len(c),
        "words": covered / len(c),
        "hexadecimal": all(x in "0123456789abcdef" for x in c) or all(x in "0123456789ABCDEF" for x in c),
        "issued": bool(re.match(secret_scan.ISSUED, c)),
        "slashes": c.count("/"),
        "in_path": last[-1:] in ("/", "\\", ".", "~") or bool(re.search(r"://[^\s]*$", last, re.A)),
        "extension": bool(re.match(r"\.[A-Za-z]{1,5}\b", after)),
        "repeats": any(len(set(c[i : i + 6])) == 1 and len(c[i : i + 6]) == 6 for i in range(len(c))) or any(w in low for w in ("abcdef", "123456", "xxxx", "example")),
        "assigned": bool(re.search(r"[=:]\s*[\"'`]?$", before, re.A)),
        "quoted": after[:1] in ("'", '"', "`") and after != "",
        "secret_cue": bool(CUE.search(before)),
        "other_cue": bool(OTHER.search(before)),
    }


def plain_scan(text, forest):
    """(start, length, score) of a text's findings, one candidate at a time."""

    def vote(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    out = []
    found = list(regex.finditer(secret_scan.CANDIDATE, text or ""))
    ends = [0, *(m.end() for m in found)]
    starts = [*(m.start() for m in found), len(text or "")]
    for i, m in enumerate(found):
        before, after = text[ends[i] : starts[i]][-secret_scan.BEFORE :], text[ends[i + 1] : starts[i + 1]][: secret_scan.AFTER]
        x = plain_features(m[0], before, after)
        score = round(sum(vote(t, [float(x[k]) for k in secret_scan.FEATURES]) for t in forest) / len(forest), 6)
        if score >= secret_scan.THRESHOLD:
            out.append((m.start(), len(m[0]), score))
    return out


@pytest.mark.parametrize("name", ["awkward", "sample", "generated"])
def test_against_plain_scans(request, spark, forest, name):
    if name == "generated":
        rows = [(i, b + c + a + ("x" * 3000 + " ") * (i % 40 == 0)) for i, (b, c, a, _) in enumerate(secret_scan.labelled_findings(150, seed=31))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(name)
    want = sorted((d, *f) for d, t in pairs(df) for f in plain_scan(t, forest))
    got = sorted((r["doc_id"], r["start"], r["length"], r["score"]) for r in secret_scan.scan_secrets(df, forest).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_learns_from_a_table(spark):
    """Labels that say the opposite of the built-in ones are followed."""
    rows = [(b, c, a, 1 - y) for b, c, a, y in secret_scan.labelled_findings(200, seed=3)] + [("x ", "aaaaaaaaaaaaaaaaaaaa", " ", None), ("x ", "b" * 20, " ", 7)]
    forest = secret_scan.train_forest(spark, spark.createDataFrame(rows, "before string, candidate string, after string, label int"))
    df = spark.createDataFrame([(1, f'config token = "{SECRET}" end'), (2, "see commit 0123456789abcdef0123456789abcdef01234567\n")], "doc_id long, text string")
    assert {r["doc_id"] for r in secret_scan.scan_secrets(df, forest).collect()} == {2}
