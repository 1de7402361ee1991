"""The pipeline against brute-force versions of its stages, and the registry of queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluvia.llm import pii, toxicity

from .conftest import pairs
from .test_line_dedup import key
from .test_simhash import components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, by name, on the smallest tables."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert stages[n].dtypes == stages["input"].dtypes, n


def test_toxic_documents_go(spark, sf_dir, stages):
    net = toxicity.fit(stages["input"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in stages["toxicity"].select("doc_id").collect()}
    again = toxicity.score_documents(stages["input"], net).where("predicted = 0")
    assert {r["doc_id"] for r in again.collect()} == kept


def test_unseen_toxic_documents_go(spark):
    """On rows whose labels are never learnt from, and enough of the others' to learn something."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.reject_toxic(spark, docs, sf_dir).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.held_out(F.col("doc_id"))).join(docs, "doc_id", "left_semi")
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    clean, toxic = ([d for d, y in truth.items() if y == c] for c in (0, 1))
    assert sum(d in kept for d in clean) / len(clean) > 0.97
    assert sum(d in kept for d in toxic) / len(toxic) < 0.15


def test_line_stage(stages):
    rows = pairs(stages["toxicity"])
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    want = {d: "\n".join(x for x in (t or "").split("\n") if len(h := holders.get(key(x), ())) < 5 or d == max(h)) for d, t in rows}
    assert dict(pairs(stages["line_dedup"])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_copies_go(stages):
    rows = pairs(stages["line_dedup"])
    groups = components({d: plain_fingerprint(t) for d, t in rows})
    assert sorted(pairs(stages["near_dedup"])) == sorted((d, t) for d, t in rows if groups[d] == d)


def test_personal_data_is_masked(stages):
    finder = pii.PersonalData()
    before, after = dict(pairs(stages["near_dedup"])), dict(pairs(stages["pii"]))
    assert before.keys() == after.keys()
    for d, text in before.items():
        found = finder.find(text)
        assert (after[d] == text) == (not found)
        assert all(text[a:b] not in after[d] for k, a, b in found if k == "email")


def test_packing_holds_every_document(stages):
    ids = {r["doc_id"] for r in stages["pii"].collect()}
    packed = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == ids and all(r["n"] == r["m"] for r in packed)


def test_registry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [f"op{n}_" for n in range(1, 14)] == [n[: n.index("_") + 1] for n in names if n.startswith("op")]
    assert "pipeline" in names and "op9_line_dedup" in __spark_entry__.oracle_sql()


def test_line_sql_agrees(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from fluvia.llm import line_dedup, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op9_line_dedup(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, awkward, nothing, name, stage):
    """Null ids and texts, repeated ids with other texts, and columns named like those that operators add."""
    more = spark.createDataFrame([(None, None), (None, "a text of its own"), (4, "another text under an old number"), (18, None)], "doc_id long, text string")
    docs = awkward.drop("lang").withColumn("predicted", F.lit("mine")).withColumn("n_dropped", F.lit(7)).unionByName(more, allowMissingColumns=True)
    out = stage(spark, docs, sf_dir)
    if name == "packing":
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert stage(spark, nothing, sf_dir).count() == 0
        return
    assert out.dtypes == docs.dtypes
    rows, before = out.collect(), docs.collect()
    assert stage(spark, nothing, sf_dir).count() == 0
    assert all(r["predicted"] in ("mine", None) and r["n_dropped"] in (7, None) and r["score"] in ("keep", None) for r in rows)
    if name in ("line_dedup", "pii"):
        assert len(rows) == len(before)
    elif name == "near_dedup":
        texts = {r["text"] for r in rows}
        assert {"a text of its own", "another text under an old number"} <= texts and len(rows) == len(texts)
