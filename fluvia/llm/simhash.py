"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most three have a variant in common that is at most one
bit from the one and at most two from the other: half the radius, rounded down and up. So every distinct
fingerprint emits all variants of both balls (1 + 64 near ones, 2,016 at two bits), variants are
shuffled, and where balls meet the fingerprints are linked and verified.

Variants are shuffled by a code of theirs: the parities of some groups of their bits. A flip changes the
parity of its group alone, so the variants of one fingerprint with the same code follow from it and the
code; they travel as one number, and a task expands those of its codes, a slice at a time.

Whoever meets a near member of a ball is at most three bits away from it, so a link to the smallest
such member joins the whole ball: links grow with the members of a ball and not with their pairs, and
none between components is lost. A task keeps a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import map_texts
from fluvia.llm.components import connected_components
from fluvia.session import materialize

#: Differing bits at which fingerprints link (the ball arithmetic below is for three).
RADIUS = 3
#: Fingerprints that a task is meant to hold for one code, and variants that it expands at a time.
HELD, SLICE = 1 << 21, 1 << 20


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the XXH64 hashes (seed 42) of word shingles, as a signed 64-bit number; no words: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], stops[: n - 1]]).tolist()
    ends = (stops[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def code_bits(count: int) -> int:
    """Parities of a code, so that of count fingerprints some HELD are sent to one code."""
    bits = 8
    while bits < 32 and count * (1 + bits + math.comb(bits, 2)) > HELD << bits:
        bits += 4
    return bits


def codes(prints: np.ndarray, bits: int) -> np.ndarray:
    """Codes of fingerprints: the parity of each of some groups of neighbouring bits."""
    out = np.zeros(len(prints), np.int64)
    for j in range(bits):
        low, high = 64 * j // bits, 64 * (j + 1) // bits
        mask = np.uint64((1 << high) - (1 << low))
        out |= (np.bitwise_count(prints & mask) & 1).astype(np.int64) << j
    return out


def _flips(bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the change of the code: flips of at most one bit, and those of two bits."""
    single = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    near, far = np.append(single, np.uint64(0)), single[i] | single[j]
    near_codes, far_codes = codes(near, bits), codes(far, bits)
    return {int(c): (near[near_codes == c], far[far_codes == c]) for c in np.union1d(near_codes, far_codes)}


def _emit(batches, bits: int):
    """(code, fingerprints as bytes): each fingerprint at every code that a variant of it has."""
    changes = np.array(sorted(_flips(bits)))
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 1 << 14):
            part = prints[at : at + (1 << 14)]
            code = (codes(part, bits)[:, None] ^ changes).reshape(-1)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], np.repeat(part, len(changes))[order]
            cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            blobs = [x.tobytes() for x in np.split(owner, cuts[1:])] if len(cuts) else []
            yield pa.RecordBatch.from_arrays([pa.array(code[cuts]), pa.array(blobs, pa.binary())], ["code", "fps"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that a spanning forest of them needs."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = np.split(ends, 2)
    root, kept = np.arange(len(nodes)), []
    left = np.arange(len(i))
    while len(left):
        left = left[root[i[left]] != root[j[left]]]
        p, q = root[i[left]], root[j[left]]
        high, low = np.maximum(p, q), np.minimum(p, q)
        picked, at = np.unique(high, return_index=True)  # each root joins a smaller one: no circles
        kept.append(left[at])
        root[picked] = low[at]
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    kept = np.concatenate(kept) if kept else left
    return a[kept], b[kept]


def _meet(code: int, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose balls meet at variants of one code."""
    prints = np.unique(prints)
    change = codes(prints, bits) ^ code
    order = np.argsort(change, kind="stable")
    kinds, cuts = np.unique(change[order], return_index=True)
    flips = _flips(bits)
    groups = [(prints[part], *flips[int(kind)]) for kind, part in zip(kinds, np.split(order, cuts[1:]), strict=True)]
    near = np.concatenate([(f[:, None] ^ n).reshape(-1) for f, n, _ in groups])
    owner = np.concatenate([np.repeat(f, len(n)) for f, n, _ in groups])
    order = np.lexsort((owner, near))
    near, owner = near[order], owner[order]
    variant, first = np.unique(near, return_index=True)
    hub = owner[first]
    to = np.repeat(hub, np.diff(first, append=len(near)))
    a, b = [to[to != owner]], [owner[to != owner]]
    # A table of bits of the near variants spares most far ones the search.
    size = 1 << max(10, int(len(variant)).bit_length() + 4)
    place = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)
    table = np.zeros(size, bool)
    table[place(variant)] = True
    for f, _, flip in groups:
        step = max(1, SLICE // max(1, len(flip)))
        for at in range(0, len(f), step) if len(flip) else ():
            part = f[at : at + step]
            far = (part[:, None] ^ flip).reshape(-1)
            some = np.flatnonzero(table[place(far)])
            found = np.minimum(np.searchsorted(variant, far[some]), len(variant) - 1)
            met = variant[found] == far[some]
            to, back = hub[found[met]], part[some[met] // len(flip)]
            # The same two fingerprints may meet at several variants.
            pair = np.unique(np.stack([to, back], 1), axis=0)
            a.append(pair[:, 0])
            b.append(pair[:, 1])
    a, b = np.concatenate(a), np.concatenate(b)
    close = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return _forest(a[close], b[close])


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within RADIUS bits: enough of them to join
    all that are linked, every one of them verified."""
    bits = code_bits(prints.count())

    def meet(table: pa.Table) -> pa.Table:
        code = table["code"][0].as_py()
        held = np.concatenate([np.frombuffer(x, np.uint64) for x in table["fps"].to_pylist()])
        a, b = _meet(code, held, bits)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    sent = prints.select("fp").mapInArrow(lambda it: _emit(it, bits), "code long, fps binary")
    return sent.groupBy("code").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    Fingerprints are those of whole texts; null or blank texts have fingerprint zero and link like
    any other. component_id is the smallest doc_id that links reach, the row's own included; null
    doc_ids are ignored by it (null if a component has no other). Rows that repeat a doc_id each get
    a row. An empty table gives an empty table.
    """

    def make():
        return lambda texts: [[fingerprint(t, words) for t in texts]]

    prints = materialize(map_texts(docs.select("doc_id", "text"), make, "fp long", drop=("text",)), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = connected_components(link_fingerprints(firsts))
    members = materialize(labels.toDF("fp", "root").join(firsts, "fp"), "members")
    least = materialize(members.groupBy("root").agg(F.min("first").alias("least")), "component-ids")
    named = members.join(least, "root").select("fp", "least")
    classes = materialize(firsts.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with one row of each group of near duplicates; columns stay.

    Groups are those of rows, whatever their doc_id: rows that share one or have none stay unless they
    are near copies. The row of smallest doc_id is kept, nulls last, then that of the smallest hash of the text.
    """
    row = "near_row_"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), row)
    first = groups.join(rows.select(row, order.alias("order")), row).groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order")[row].alias(row)), row, "left_semi").select(*docs.columns)
