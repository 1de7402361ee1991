import hashlib
import uuid

import pytest

from fluvia.llm import exact_dedup
from fluvia.session import scratch_dir

from .conftest import pairs

BLANK = str.maketrans("", "", " \t\n\v\f\r")


def plain(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault((t or "").translate(BLANK), []).append((-len(t or ""), d is None, d or 0, i, d))
    out = []
    for text, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[4], best[4], len(members), m[3] == best[3], sha) for m in members]
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def result(spark, path, **options):
    return sorted(map(tuple, exact_dedup.exact_duplicates(spark, path, **options).collect()), key=key)


def stored(df):
    path = f"{scratch_dir(df.sparkSession)}/exact-test-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 1}, {"key_bytes": 0}, {"batch_bytes": 1, "key_bytes": 1}])
def test_awkward_rows_against_plain(spark, awkward, options):
    """In one micro-batch and in one a file; with states that hold different texts."""
    path = stored(awkward)
    assert result(spark, path, **options) == sorted(plain(pairs(awkward)), key=key)


def test_sample_against_plain(spark, sample, sf_dir):
    assert result(spark, f"{sf_dir}/documents.parquet") == sorted(plain(pairs(sample)), key=key)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, "ab"), (3, "ab"), (3, "ab"), (None, None), (5, ""), (6, "\t\n"), (7, "a b"), (8, "x" * 300000), (9, "x " * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(spark, stored(df)) == sorted(plain(rows), key=key)


def test_empty_table(spark, nothing):
    assert result(spark, stored(nothing)) == []


def test_state_holds_over_batches(spark):
    """A row of a later micro-batch changes what the state of an earlier one says stays."""
    path = stored(spark.createDataFrame([(1, "same text"), (2, "other")], "doc_id long, text string").coalesce(1))
    spark.createDataFrame([(3, "same   text"), (0, "o ther")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = {r[0]: r[1:4] for r in result(spark, path, batch_bytes=1)}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (0, 2, False), 0: (0, 2, True)}
