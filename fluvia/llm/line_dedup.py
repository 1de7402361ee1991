"""Line dedup: drop lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised form, distinct documents are counted per
hash, and documents are put together again, by position, without the lines over the threshold.
The text itself is shuffled once, to meet the hashes that its document loses; hot lines travel as
(hash, doc_id) pairs only and are counted with partial aggregation.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import map_texts
from fluvia.session import materialize


def line_key(line: bytes, min_length: int) -> bytes | None:
    """Hash of a line's key: ASCII white space stripped, A-Z lower-cased; None if the key is short."""
    key = line.strip().lower()
    if len(key) < min_length or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_length):
        return None
    return xxhash.xxh3_128_digest(key)


def drop_common_lines(docs: DataFrame, min_docs: int = 5, min_length: int = 40) -> DataFrame:
    """docs with the lines dropped that at least min_docs documents hold, but for their last holder.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased; keys of
    fewer than min_length code points never count. Keys of min_docs or more documents lose all their
    lines except in the document with the largest doc_id. Adds text (the kept lines), n_lines and
    n_dropped; other columns stay, and a column named like an added one is replaced.

    Null or empty text: one empty line, kept. Rows that repeat a doc_id count as one document and
    each get the same treatment. Null doc_ids count together as one document, smaller than others.
    An empty table gives an empty table.
    """

    def keys():
        def work(texts):
            return [[list({k for line in (t or "").encode().split(b"\n") if (k := line_key(line, min_length))}) for t in texts]]

        return work

    found = map_texts(docs.select("doc_id", "text"), keys, "keys array<binary>", drop=("text",))
    pairs = materialize(found.select("doc_id", F.explode("keys").alias("key")).distinct(), "line-keys")
    common = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written out, so that both sides of the next join are exchanges and adaptive execution can split hot keys.
    common = materialize(common.select("key", "keeper"), "common-lines")
    lost = pairs.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key")
    lost = lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost_keys_")).withColumnRenamed("doc_id", "lost_id_")
    marked = docs.join(lost, docs["doc_id"].eqNullSafe(lost["lost_id_"]), "left").drop("lost_id_")

    def assemble():
        def work(texts, lost_keys):
            kept, lines, dropped = [], [], []
            for t, lost in zip(texts, lost_keys, strict=True):
                if not lost:
                    kept.append(t or "")
                    lines.append((t or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                drop = set(lost)
                all_lines = t.encode().split(b"\n")
                stay = [x for x in all_lines if line_key(x, min_length) not in drop]
                kept.append(b"\n".join(stay).decode())
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
            return kept, lines, dropped

        return work

    return map_texts(marked, assemble, "text string, n_lines long, n_dropped long", extra=("lost_keys_",), drop=("lost_keys_",))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(c.key) FILTER (WHERE l.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.key IS NULL OR l.doc_id = c.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY l.doc_id
"""
