import hashlib

import pytest

from fluvia.llm import line_dedup

from .conftest import pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\v\f\r").translate(LOWER)


def plain(rows, min_docs=5, min_length=40):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), ())) < min_docs or d == max(h)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in line_dedup.drop_common_lines(df).collect())


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_against_dictionary(request, name):
    df = request.getfixturevalue(name)
    assert result(df) == plain(pairs(df))


def test_columns_and_empty_table(awkward, nothing):
    out = line_dedup.drop_common_lines(awkward)
    assert set(out.columns) == set(awkward.columns) | {"n_dropped"} and dict(out.dtypes)["n_lines"] == "bigint"
    assert {r["key"] for r in out.select("key").collect()} == {"keep"}
    assert line_dedup.drop_common_lines(nothing).count() == 0


def test_null_ids_count_as_one_document(spark):
    line = "q" * 45
    df = spark.createDataFrame([(None, line), (None, line), (1, line), (2, line), (3, line)], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in line_dedup.drop_common_lines(df).collect()) == 0
    more = df.union(spark.createDataFrame([(4, line)], "doc_id long, text string"))
    assert sum(r["n_dropped"] for r in line_dedup.drop_common_lines(more).collect()) == 5
