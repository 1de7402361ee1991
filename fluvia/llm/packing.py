"""Packing: cut documents into pieces and fill fixed windows with little padding.

Pieces of a block of documents are divided over windows by Karmarkar-Karp multiway differencing:
the two partial partitions with the largest imbalances are merged again and again, the fullest
window of one with the emptiest of the other, which gives windows of nearly equal length. If one
exceeds the capacity, the number of windows rises by one and the block is divided again.
Blocks have a bounded number of tokens and never leave their task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluvia.llm.bpe_trie import shared_encoder, tokenizer_path
from fluvia.llm.common import slices

#: Tokens a window holds, windows a block fills, and tokens a piece has at most.
WINDOW, BLOCK_WINDOWS, PIECE = 2048, 96, 512
#: A block's last FINE_TOKENS tokens are cut into pieces of at most FINE, which even out what the
#: larger ones leave; its mean window stays SLACK tokens below the capacity for the same reason.
FINE, FINE_TOKENS, SLACK = 8, 2048, 7


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k groups of nearly equal sum, by Karmarkar-Karp multiway differencing.

    A partial partition is a list of (sum, node), fullest first, without its empty groups; nodes
    form a forest whose leaves are indices. Ties go to the smaller index. No sizes: k empty groups.
    """
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, ia, a = heapq.heappop(heap)
        _, ib, b = heap[0]
        alone = k - len(b)
        made = a[:alone]
        if len(a) > alone:
            for (x, i), (y, j) in zip(a[alone:], reversed(b), strict=False):
                left.append(i)
                right.append(j)
                made.append((x + y, len(left) - 1))
            made += b[: len(b) - (len(a) - alone)]
        else:
            made += b
        made.sort(reverse=True)
        low = made[-1][0] if len(made) == k else 0
        heapq.heapreplace(heap, (low - made[0][0], min(ia, ib), made))
    groups = []
    for _, node in heap[0][2] if heap else []:
        stack, members = [node], []
        while stack:
            n = stack.pop()
            if left[n] < 0:
                members.append(n)
            else:
                stack += (left[n], right[n])
        groups.append(sorted(members))
    return groups + [[] for _ in range(k - len(groups))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups whose sums stay within capacity; the count starts at the least possible and rises."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids.

    A document's ids are those of its text (null or empty: none) and end_id. Full windows are cut
    off its front and stand alone; the rest is cut into equal pieces of at most PIECE tokens, which
    share windows with other documents' pieces. Sequences are full or nearly so; at the end of a
    partition some have a smaller power of two as their length. start counts the document's ids before the piece,
    offset the ids before it in its sequence; offsets have no gaps. ids_crc32 is that of the piece's
    ids as little-endian unsigned 32-bit numbers; ids array<int> is left out without with_ids.
    Rows that repeat a doc_id are separate documents. sequence_id is unique over the table. An empty
    table gives no rows.
    """
    tokenizer = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [f.split(" ")[0] for f in schema.split(", ")]
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder = shared_encoder(tokenizer, "raw")
        key = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        sequence = 0
        items: list[tuple] = []
        tokens, goal = 0, BLOCK_WINDOWS * (window - SLACK)

        def emit(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, raw, n in pieces:
                size = len(raw) // 4
                out.append((doc, start, size, zlib.crc32(raw), n, key + sequence, offset, *([np.frombuffer(raw, np.int32)] * with_ids)))
                offset += size
            sequence += 1

        def carve(size):
            """The last size tokens of the block's pieces, taken off; a piece is cut where they begin."""
            taken = []
            while size:
                doc, start, raw, n = items.pop()
                keep = max(0, len(raw) // 4 - size)
                if keep:
                    items.append((doc, start, raw[: 4 * keep], n))
                taken.append((doc, start + keep, raw[4 * keep :], n))
                size -= len(raw) // 4 - keep
            return taken[::-1]

        def finish():
            """Close a partition's last block, which doesn't fill its windows: what whole windows leave
            goes into sequences of a power of two, and the end of the rest is cut fine."""
            tail = tokens % (window - SLACK)
            for bit in reversed(range(tail.bit_length())):
                if tail >> bit & 1:
                    emit(carve(1 << bit))
            for doc, start, raw, n in carve(min(FINE_TOKENS, tokens - tail)):
                items.extend((doc, start + i, raw[4 * i : 4 * (i + FINE)], n) for i in range(0, len(raw) // 4, FINE))
            close()

        def close():
            nonlocal items, tokens
            for group in windows_for([len(x[2]) // 4 for x in items], window):
                emit(items[i] for i in group)
            items, tokens = [], 0

        def rows():
            rows, out[:] = [list(c) for c in zip(*out, strict=True)], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

        types: list[pa.DataType] = []
        for part in slices(batches):
            types = types or [part.schema.field("doc_id").type, *([pa.int64()] * 6), *([pa.list_(pa.int32())] * with_ids)]
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            for doc, words in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), encoder.prepare(texts), strict=True):
                raw = encoder.encode_raw(words) + end
                n, at = len(raw) // 4, 0
                while n - at >= window:
                    emit([(doc, at, raw[4 * at : 4 * (at + window)], n)])
                    at += window
                while at < n:
                    # What this part of the block still takes, so that it closes at its goal; then equal pieces.
                    fine = tokens >= goal - FINE_TOKENS
                    size = min(n - at, (goal if fine else goal - FINE_TOKENS) - tokens)
                    count = -(-size // (FINE if fine else PIECE))
                    cuts = [at + size * i // count for i in range(count + 1)]
                    items += [(doc, a, raw[4 * a : 4 * b], n) for a, b in zip(cuts, cuts[1:], strict=False)]
                    at += size
                    tokens += size
                    if tokens == goal:
                        close()
            if len(out) >= 4096:
                yield rows()
        if items:
            finish()
        if out:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
