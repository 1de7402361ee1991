"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import ann, bpe_trie, dual_tree, exact_dedup, gif_media, line_dedup, packing, pii, ranked_search, secret_scan, simhash, suffix_dedup, toxicity
from fluvia.llm.common import documents, table
from fluvia.session import ship


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encoding_digests(documents(spark, sf_dir))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_digests(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), with_ids=False)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(ship(spark), f"{sf_dir}/documents.parquet")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(documents(spark, sf_dir))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_toxicity, op3_simhash, op4_bpe_trie, op5_gif_media, op6_pii, op7_secret_scan, op8_ann, op9_line_dedup, op10_packing, op11_exact_dedup, op12_centroid_clustering, op13_ranked_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": line_dedup.ORACLE_SQL, "op11_exact_dedup": exact_dedup.ORACLE_SQL, "op12_centroid_clustering": dual_tree.oracle_sql(), "op13_ranked_search": ranked_search.ORACLE_SQL}
