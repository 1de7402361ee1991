"""Exact dedup as a stateful stream.

Two streams run one after the other, each in micro-batches of a bounded number of bytes. The first
reads the documents and appends a row to a ledger for each: digest of the normalised text, stable
identifier, code points, and a content locator (file and row). The second keeps a state per digest on
disk (RocksDB), without expiry: how many rows have it, and the identifier and locator of the row that
stays so far. Rows of a digest are combined before they are shuffled to their state, so that a third
of all rows may be copies of one text. Every hit, a row whose digest others have too, is then fetched by
its locator and compared byte by byte within its digest; should texts differ, the digest is split.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import slices
from fluvia.session import materialize, scratch_dir, ship

#: Characters that don't count.
BLANK = b" \t\n\v\f\r"
_LEDGER = "doc_id long, points int, sha binary, file string, row long"


def _contents(column: pa.Array) -> list[bytes]:
    """Normalised texts as bytes; null is empty."""
    return [(t or b"").translate(None, BLANK) for t in column.cast(pa.binary()).to_pylist()]


def _digests(batches):
    """Ledger rows of (doc_id, text, file, row)."""
    for batch in batches:
        for part in slices(iter([batch])):
            text = part.column(1)
            sha = [hashlib.sha256(t).digest() for t in _contents(text)]
            points = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), points, pa.array(sha, pa.binary()), part.column(2), part.column(3)], ["doc_id", "points", "sha", "file", "row"])


def _fetched(batches):
    """(key, content) of (key, text)."""
    for batch in batches:
        for part in slices(iter([batch])):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_contents(part.column(1)), pa.binary())], ["key", "content"])


def _located(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _best() -> Column:
    """What orders the rows of a class: most code points, then the smallest doc_id (nulls last), then the locator."""
    return F.min(F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's partitions whose streams keep their state on disk."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    # Else each of many small stores claims some MB of disk in advance.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return own


def stream_states(spark: SparkSession, path: str, batch_bytes: int, key_bytes: int = 32) -> tuple[DataFrame, DataFrame]:
    """(ledger, states) of the Parquet table at path.

    ledger: doc_id, points, sha, file, row of every row. states: key (the digest's first key_bytes),
    n rows and best, the row that stays: identifier and locator.
    """
    folder, own = f"{scratch_dir(ship(spark))}/exact-{uuid.uuid4().hex}", _stream_session(spark)
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # A pattern, since a stream doesn't take the path of a single file.
    source = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    ledger = _located(source).mapInArrow(_digests, _LEDGER)
    ledger.writeStream.format("parquet").option("path", f"{folder}/ledger").option("checkpointLocation", f"{folder}/ledger-log").trigger(availableNow=True).start().awaitTermination()

    rows = own.readStream.schema(_LEDGER).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{folder}/ledger")
    state = rows.groupBy(F.substring("sha", 1, key_bytes).alias("key")).agg(F.count(F.lit(1)).alias("n"), _best().alias("best"))

    def keep(changed: DataFrame, batch: int) -> None:
        # Overwritten, so that a batch that is run again changes nothing.
        changed.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")

    state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state-log").trigger(availableNow=True).start().awaitTermination()
    ledger = spark.read.schema(_LEDGER).parquet(f"{folder}/ledger")
    if not ledger.limit(1).count():  # the state stream may not have had a batch
        return ledger, spark.createDataFrame([], state.schema)
    changes = spark.read.parquet(f"{folder}/states")
    latest = changes.groupBy("key").agg(F.max_by(F.struct("n", "best"), "batch").alias("x"))
    return ledger, latest.select("key", "x.n", "x.best")


def exact_duplicates(spark: SparkSession, path: str, batch_bytes: int = 1 << 40, key_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet table at path (doc_id, text).

    Texts are equal when identical without any of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts,
    the row with the most code points stays, then the smallest doc_id (null is largest), then the first by
    file and row, so that of repeated rows exactly one stays. keep_id is null where the row that stays
    has a null doc_id. Whole texts of any length count. Other columns aren't read; an empty table gives no
    rows. batch_bytes: of a micro-batch; the result doesn't depend on it. key_bytes: of the digest that
    keys the state; fewer make different texts meet in a state, which the comparison of bytes then splits.
    """
    ledger, states = stream_states(spark, path, batch_bytes, key_bytes)
    key = F.substring("sha", 1, key_bytes)
    # Written out, so that both sides of the next joins are exchanges and adaptive execution can split a hot digest.
    states = materialize(states, "exact-states")
    rows = ledger.withColumn("key", key)
    several = states.where("n > 1").select("key")
    hits = rows.join(several, "key").select("file", "row", "key")
    # A third of all rows may be copies of one text: equal contents are counted before they are shuffled.
    contents = _located(spark.read.parquet(path)).join(hits, ["file", "row"]).select("key", "text").mapInArrow(_fetched, "key binary, content binary")
    different = contents.groupBy("key", "content").count().groupBy("key").count().where("count > 1").select("key")
    different = materialize(different, "exact-different")
    plain = rows.join(states, "key").select("doc_id", "sha", "file", "row", "n", "best")
    if different.limit(1).count():
        plain = rows.join(states.join(different, "key", "left_anti"), "key").select("doc_id", "sha", "file", "row", "n", "best")
        plain = plain.unionByName(_split(spark, path, rows.join(different, "key")))
    same = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
    return plain.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _split(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Ledger rows of digests with different texts: classed by their bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(iter([batch])):
                keep = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(_contents(part.column(0)), pa.binary())], [*part.schema.names[1:], "content"])

    texts = _located(spark.read.parquet(path)).select("file", "row", "text").join(rows.select("doc_id", "points", "sha", "file", "row"), ["file", "row"])
    full = texts.select("text", "doc_id", "points", "sha", "file", "row").mapInArrow(run, f"{_LEDGER}, content binary")
    full = materialize(full, "exact-split")
    classes = materialize(full.groupBy("content").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")), "exact-classes")
    return full.join(classes, "content").select("doc_id", "sha", "file", "row", "n", "best")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), k AS (
  SELECT norm, count(*) AS n, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, k.keep_id, k.n AS group_size, d.doc_id = k.keep_id AS kept, d.sha AS text_sha256 FROM d JOIN k ON d.norm = k.norm
"""
