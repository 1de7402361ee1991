"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import pytest

LONG_LINE = "a passage that several documents share, word for word, from here on to its very end"


def awkward_rows() -> list[tuple]:
    shared = "This long sentence stands in more than four documents at once, unchanged."
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\r "),
        (4, shared + "\nfirst own line"),
        (5, "  " + shared.upper() + "\t\nsecond own line\n" + shared),
        (6, shared),
        (7, shared + "\n\n" + LONG_LINE),
        (8, "own\n" + shared + "\r\nend"),
        (9, LONG_LINE + " then something else entirely"),
        (10, "one"),
        (11, "one two"),
        (12, "ONE Two"),
        (13, "naïve café ÅNGSTRÖM 日本語 text ✓ 1234 don't <|endoftext|> stop"),
        (14, "mail a.b+c@example.co.uk or x@y, call +49 (711) 123-4567 now, 10.0.0.256 and 192.168.1.1"),
        (15, "card 4111 1111 1111 1111 and 4111-1111-1111-1112; token = \"ghp_Zk39sLq82MxP01aBcD45eFgH67iJkL89mNoP\""),
        (16, "word " * 40000),
        (17, "word " * 40000),
        (18, "same text here, repeated row"),
        (18, "same text here, repeated row"),
        (19, LONG_LINE * 3),
        (20, "x" * 120),
        (21, "x" * 60 + "y" + "x" * 60),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents with extra columns whose names clash with those that operators add."""
    columns = "doc_id long, text string, score string, spans string, n_lines string, key string, fp string, start string, ids string, media string, lang string"
    rows = [(i, t, *(["keep"] * 9)) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, columns).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
