import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fluvia.llm import ranked_search
from fluvia.llm.queries import op13_ranked_search

from .conftest import pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 25
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def result(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def item_rows(items):
    return [(r["item_id"], r["text"]) for r in items.collect()]


def test_terms():
    texts = ["", "A-b_C9 é ÀÉ x\x7fy\x00z", "naïve café ÅNGSTRÖM 日本語 don't", "x" * 5000, "\t \n"]
    assert [[t.decode() for t in ranked_search.terms_of(t.encode())] for t in texts] == [terms(t) for t in texts]
    assert ranked_search.terms_of(None) == []


@pytest.mark.parametrize("shard", [4096, 7])
def test_sample_against_plain(monkeypatch, sample, items, shard):
    """Shards are made on the driver's copy of the module in local mode too: the closure takes the patched size."""
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    index = ranked_search.build_index(sample)
    assert result(ranked_search.search(index, items)) == sorted(plain(pairs(sample), item_rows(items)), key=key)


def test_awkward(spark, awkward):
    rows = [(1, "one word"), (1, "one"), (2, None), (None, "same text here row one"), (3, "日本語 café word"), (4, "zzz"), (5, ""), (6, "this passage several own x")]
    items = spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, term string")
    more = awkward.unionByName(awkward.where("doc_id in (6, 11)").withColumn("doc_id", F.lit(None).cast("long")))
    docs = pairs(more)
    assert result(ranked_search.search(ranked_search.build_index(more), items)) == sorted(plain(docs, rows), key=key)


def test_ties_nulls_and_few(spark):
    docs = [(9, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (5, "gamma"), (6, "delta epsilon"), (7, "zeta")] + [(100 + i, "omega psi") for i in range(30)]
    rows = [(1, "alpha"), (2, "gamma alpha alpha"), (3, "omega"), (4, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(rows, "item_id long, text string")
    assert result(ranked_search.search(ranked_search.build_index(df), items)) == sorted(plain(docs, rows), key=key)


def test_empty_tables(spark, nothing, sample, items):
    index = ranked_search.build_index(nothing)
    assert (index.documents, index.terms) == (0, 0)
    assert ranked_search.search(index, items).count() == 0
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(sample), no_items).count() == 0


def test_first_tiers_prove_clear_answers_and_others_fall_through(spark):
    """Twelve short documents with two rare terms stand far above the rest; for a common term nothing is proven early."""
    docs = [(i, f"rare{i % 2} rarer") for i in range(12)] + [(100 + i, "common " + " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(80)]
    rows = [(1, "rarer rare1"), (2, "common w3 w5")]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    out = ranked_search.search(index, spark.createDataFrame(rows, "item_id long, text string"))
    assert result(out) == sorted(plain(docs, rows), key=key)
    tiers = {r["item_id"]: r["tier"] for r in out.select("item_id", "tier").distinct().collect()}
    assert tiers[1] == 0 and tiers[2] > 0


def test_residuals_bound_what_lower_tiers_hold(sample):
    rows = ranked_search.build_index(sample).postings.collect()
    found = {}
    for r in rows:
        assert r["impacts"] == sorted(r["impacts"], reverse=True)
        found.setdefault((r["shard"], r["term"]), {})[r["tier"]] = (r["impacts"], r["rest"], r["df"])
    for tiers in found.values():
        assert sum(len(x[0]) for x in tiers.values()) == tiers[0][2]
        for t, (_, rest, _) in tiers.items():
            assert rest == max((i for u, x in tiers.items() if u > t for i in x[0]), default=0)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    made = con.sql(ranked_search.ORACLE_SQL)
    df = op13_ranked_search(spark, sf_dir)
    assert sorted(made.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*made.columns).collect())) == sorted(made.fetchall())
