"""Fields: every target at every time. Targets are packed into blocks, and a unit of work is a time and a block.

What a time needs, its stations and whatever has been made of them, is one row, made once and sent to the blocks;
targets are shuffled once for every TIMES times and never crossed with them. Units are rows of their own:
a task takes them one by one, so that it holds one time's row and one block, however many there are of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets of a block; times that share a copy of a block.
BLOCK, TIMES = 4096, 4
#: Most partitions that are asked for; beyond, tasks take more units each.
MOST_TASKS = 100_000


def meet(times: DataFrame, targets: DataFrame, time: str, shared: int = TIMES, width: int = BLOCK) -> DataFrame:
    """A row for each row of times (one a time, of any columns) and block of targets: the former's columns and wanted,
    the block's targets as an array of structs. Targets fall into blocks of some `width` by the hash of their stn; a copy of a block serves some `shared` times."""
    blocks = max(1, -(-targets.count() // width))
    parts = max(1, -(-times.select(time).count() // shared))
    n = min(blocks * parts, MOST_TASKS)
    block, part = F.pmod(F.xxhash64("stn"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(time), F.lit(parts)).cast("int")
    packed = targets.groupBy(block.alias("block_")).agg(F.collect_list(F.struct(*targets.columns)).alias("wanted"))
    packed = packed.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = times.withColumn("part_", part).withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Units are few and heavy: numbers of partitions of their own, or Spark would put many into one task.
    keys = ["block_", "part_"]
    return sent.repartition(n, *keys).join(packed.repartition(n, *keys).hint("shuffle_hash"), keys).drop(*keys)


def numbers(row: pa.Array, i: int) -> np.ndarray:
    """The numbers in the i-th list of a column; nulls are NaN."""
    return row[i].values.to_numpy(zero_copy_only=False).astype(float)


def own_places(wanted: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each wanted id stands among the known ones, or -1."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(wanted, value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def unit_rows(batch: pa.RecordBatch, time: str, i: int, n: int) -> pa.Array:
    """The time of the i-th unit, n times."""
    return batch.column(batch.schema.get_field_index(time)).take(pa.array(np.full(n, i)))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which the first column takes another value, and the end."""
    code = batch.column(0).dictionary_encode("encode").indices.to_numpy()
    return np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)]


def whole_groups(batches):
    """Of batches in which equal values of the first column follow each other: (batch, starts), batches of whole groups, the i-th from row starts[i]
    to starts[i + 1]. A group that spans several batches is put together once."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, first = _starts(batch), batch.column(0)[0].as_py()
        last = int(starts[-2])
        if held and (last or key != first):
            whole = pa.concat_batches([*held, batch.slice(0, last)])
            yield whole, _starts(whole)
            held = []
        elif last:
            yield batch.slice(0, last), starts[:-1]
        held.append(batch.slice(last))
        key = batch.column(0)[last].as_py()
    if held:
        whole = pa.concat_batches(held)
        yield whole, _starts(whole)


def spread(rows: DataFrame, key: str, least: int = 1) -> DataFrame:
    """rows in partitions by their key, sorted by it: at least so many, and some for each core. By its hash, as Spark would take the partitions of a
    join before for them, and would then put small ones into one task."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, min(least, MOST_TASKS))
    return rows.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key)
