"""A corpus pipeline of five stages: toxicity, line dedup, SimHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import line_dedup, packing, pii, simhash, toxicity
from fluvia.llm.common import table
from fluvia.session import materialize

def _through(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What operator makes of docs, with their columns; n_chars follows the text.

    Other columns than doc_id and text go through under names of their own, so that none clashes with
    those that the operator adds.
    """
    names = {c: f"kept_{i}_" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = operator(docs.withColumnsRenamed(names)).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on labelled ones, doesn't predict to be toxic.

    Null or empty texts score the share of toxic labels. Rows are judged by their text alone.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _through(docs, lambda d: toxicity.score_documents(d, net).where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share. A null text becomes an empty one; no row goes."""
    return _through(docs, line_dedup.drop_common_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, nulls last.

    Groups are of rows, so null or repeated doc_ids lose nothing else. Texts without a word are one group.
    """
    return _through(docs, simhash.keep_one_each)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay as mask_personal_data leaves them."""
    return _through(docs, pii.mask_personal_data)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, packed into sequences. Null texts count as empty; every row is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", mask_pii),
    ("packing", pack),
]

#: SQL can express neither the network nor the tokenizer; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
