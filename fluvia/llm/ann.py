"""Approximate nearest neighbours by inner product: NN-descent on Spark and greedy graph search.

The graph holds, for every distinct vector, its best neighbours so far. It starts from exact
neighbours inside small cells of random hyperplanes. In a round every vector gathers its neighbours
and those that list it, each pair of them is scored where they meet, and everyone keeps the best it
has been shown: neighbours of neighbours, by joins. How many places a vector joins, and how many meet
in one place, is bounded, so that hubs stay small. Queries start from their own place in the graph,
open the best candidates of their pool in a few rounds of joins, and are scored at last, in double
precision, on the original vectors. Equal vectors are one node; copies come back at the end.
Travelling vectors are quantised to bytes, as what they differ by from the nearest of a few pivots, which
only steers the search. The descent ends when few lists change, a query's search when the best of its pool
have all been opened; queries that aren't done by then are compared with all vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize

#: Neighbours in the graph; places a vector joins and members of a place; pairs that a member takes from one place.
NEIGHBOURS, PLACES, TAKEN = 32, 56, 16
#: Tables of random cells at the start, members of a cell; most rounds of joins, and the share of new neighbours at which they end.
TABLES, CELL, ROUNDS, SETTLED = 4, 512, 10, 0.01
#: Search: candidates opened in a round, most rounds, pool size, candidates that have to be open at the end, candidates scored exactly.
OPENED, SEARCH_ROUNDS, POOL, FRONT, EXACT = 64, 16, 400, 160, 160
#: Places from which every search starts besides its own: the longest vectors, and as many by hash.
ENTRIES = 48
#: Vectors from a sample that codes are relative to.
PIVOTS = 256
#: Of an exact search: queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
SEED = 11


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows that take part: not null, all finite, not all zero, of the length
    that most rows have (ties: the shorter; no product is defined with others); equal rows once."""
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))"
    rows = rows.where(finite).where("exists(embedding, x -> x <> 0)")
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (size["size"] if size else 0)).distinct()


class Codes:
    """Rows of bytes for vectors: the number of a pivot, a float32 scale, and a signed byte for each component of the difference."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float32)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        near = (vectors @ self.pivots.T - 0.5 * np.einsum("ij,ij->i", self.pivots, self.pivots)).argmax(1)
        rest = vectors - self.pivots[near]
        scale = (np.abs(rest).max(1, keepdims=True) / 127).astype(np.float32)
        steps = np.rint(rest / np.where(scale > 0, scale, 1)).clip(-127, 127).astype(np.int8)
        return np.concatenate([near.astype(np.int16).view(np.int8).reshape(len(vectors), 2), scale.view(np.int8).reshape(len(vectors), 4), steps], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        near = np.ascontiguousarray(codes[:, :2]).view(np.int16)[:, 0]
        return self.pivots[near] + codes[:, 6:].astype(np.float32) * np.ascontiguousarray(codes[:, 2:6]).view(np.float32)


def _binary(column: pa.Array) -> np.ndarray:
    """Rows of int8 from a binary column whose values have one length."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    width = (int(offsets[-1]) - int(offsets[0])) // max(1, n)
    return np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(n, width)


def _lists(column: pa.Array) -> np.ndarray:
    """Bounds of each list in the flattened values."""
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _ragged(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _meet(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """Score the pairs of each place's members; every member takes its best."""
    for batch in batches:
        bounds, flat = _lists(batch.column(0)), batch.column(0).flatten()
        ids, vectors = flat.field(0).to_numpy(), codes.decode(_binary(flat.field(1))) if len(flat) else None
        out_u, out_v, out_s, sizes = [], [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            here, x = ids[a:b], vectors[a:b]
            score = x @ x.T
            np.fill_diagonal(score, -np.inf)
            k = min(TAKEN, len(here) - 1)
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            out_u.append(here)
            out_v.append(here[best].ravel())
            out_s.append(np.take_along_axis(score, best, 1).ravel())
            sizes += [k] * len(here)
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), _ragged(np.concatenate(out_v), sizes, pa.int64()), _ragged(np.concatenate(out_s), sizes, pa.float32())], ["node", "ids", "scores"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """The k best distinct ids, best first, ties to the smaller id; `more` goes along."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    keep = order[np.sort(first)[:k]]
    return [ids[keep], scores[keep], *(m[keep] for m in more)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list of the best from each node's lists of candidates."""
    for batch in batches:
        nodes, column = batch.column(0), batch.column(1)
        outer, flat = _lists(column), column.flatten()
        inner, ids, scores = _lists(flat.field(0)), flat.field(0).flatten().to_numpy(), flat.field(1).flatten().to_numpy()
        out_v, out_s, sizes = [], [], []
        for a, b in zip(outer[:-1], outer[1:], strict=True):
            v, s = _best(ids[inner[a] : inner[b]], scores[inner[a] : inner[b]], NEIGHBOURS)
            out_v.append(v)
            out_s.append(s)
            sizes.append(len(v))
        if sizes:
            yield pa.RecordBatch.from_arrays([nodes, _ragged(np.concatenate(out_v), sizes, pa.int64()), _ragged(np.concatenate(out_s), sizes, pa.float32())], ["node", "ids", "scores"])


_LISTS = "node long, ids array<long>, scores array<float>"


def _improve(places: DataFrame, known: DataFrame | None, codes: Codes) -> DataFrame:
    """The graph after the members of places (one list column of node and code) have met."""
    shown = places.mapInArrow(lambda batches: _meet(batches, codes), _LISTS)
    shown = shown.union(known) if known is not None else shown
    gathered = shown.groupBy("node").agg(F.collect_list(F.struct("ids", "scores")).alias("shown"))
    return materialize(gathered.mapInArrow(_merged, _LISTS), "graph")


def _cells(nodes: DataFrame, n: int, codes: Codes) -> DataFrame:
    """Places of the start: cells of random hyperplanes, large ones dealt into parts of about CELL members."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / CELL)))))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, power = codes.decode(_binary(batch.column(1))), 1 << np.arange(bits)
            x = x - codes.pivots.mean(0)  # planes through the middle, so that cells are even
            for t in range(TABLES):
                planes = np.random.default_rng((SEED, t)).normal(size=(x.shape[1], bits))
                cell = ((x @ planes) > 0) @ power
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell * TABLES + t)], ["node", "code", "cell"])

    rows = nodes.mapInArrow(run, "node long, code binary, cell long")
    sizes = materialize(rows.groupBy("cell").count(), "cells")
    part = F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("count") / CELL))
    dealt = rows.join(sizes, "cell").withColumn("part", part)
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "code")).alias("members")).select("members")


def _neighbour_places(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places of a round: each node with its neighbours and with those that list it, the best of both."""
    links = graph.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("node", F.col("x.ids").alias("near"), F.col("x.scores").alias("score"))
    both = links.union(links.select("near", "node", "score")).distinct().toDF("place", "node", "score")
    ranked = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), other))
    joined = both.withColumn("r", ranked("node", "place")).where(F.col("r") <= PLACES)
    kept = joined.withColumn("r", ranked("place", "node")).where(F.col("r") <= PLACES).select("place", "node")
    return kept.join(nodes, "node").groupBy("place").agg(F.collect_list(F.struct("node", "code")).alias("members")).select("members")


def build_graph(nodes: DataFrame, codes: Codes) -> DataFrame:
    """(node, ids, scores) with up to NEIGHBOURS neighbours of each node of (node, code)."""
    graph = _improve(_cells(nodes, nodes.count(), codes), None, codes)
    for _ in range(ROUNDS):
        better = _improve(_neighbour_places(graph, nodes), graph, codes)
        both = better.select("node", "ids").join(graph.select("node", F.col("ids").alias("old")), "node", "left")
        share = both.agg((F.sum(F.size(F.array_except("ids", F.coalesce("old", F.array().cast("array<long>"))))) / F.sum(F.size("ids"))).alias("s")).first()["s"]
        graph = better
        if share is None or share < SETTLED:
            break
    return graph


def _score_opened(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """Scores of an opened node's neighbours for one query."""
    for batch in batches:
        if not batch.num_rows:
            continue
        queries = codes.decode(_binary(batch.column(1)))
        bounds, ids = _lists(batch.column(2)), batch.column(2).flatten().to_numpy()
        near = codes.decode(_binary(batch.column(3).flatten()))
        scores = np.einsum("ij,ij->i", near, np.repeat(queries, np.diff(bounds), 0)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), _ragged(ids, np.diff(bounds).tolist(), pa.int64()), _ragged(scores, np.diff(bounds).tolist(), pa.float32()), _ragged(np.zeros(len(ids), bool), np.diff(bounds).tolist(), pa.bool_())], ["node", "ids", "scores", "opened"])


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's pool after a round: best candidates, and which of them have been opened."""
    for batch in batches:
        column = batch.column(1)
        outer, flat = _lists(column), column.flatten()
        inner = _lists(flat.field(0))
        ids, scores, opened = (flat.field(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
        out = [[], [], []]
        sizes = []
        for a, b in zip(outer[:-1], outer[1:], strict=True):
            part = slice(inner[a], inner[b])
            done = np.unique(ids[part][opened[part]])
            v, s = _best(ids[part], scores[part], POOL)
            for o, x in zip(out, (v, s, np.isin(v, done)), strict=True):
                o.append(x)
            sizes.append(len(v))
        if sizes:
            arrays = [_ragged(np.concatenate(o), sizes, t) for o, t in zip(out, (pa.int64(), pa.float32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["node", "ids", "scores", "opened"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, codes: Codes, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ids, scores, opened), the pool that greedy search ends with for each query node (column node), and the queries
    whose search hasn't ended. entries: nodes from which every search starts besides its own place."""
    links = graph.select("node", F.explode("ids").alias("near"))
    # The entries stand on the shelf as the neighbours of a node -1 that everybody opens first.
    links = links.union(entries.select(F.lit(-1).cast("long"), "node"))
    found = links.join(nodes.toDF("near", "near_code"), "near").groupBy("node").agg(F.collect_list(F.struct("near", "near_code")).alias("x"))
    shelf = materialize(found.select(F.col("node").alias("open"), F.col("x.near").alias("near"), F.col("x.near_code").alias("near_codes")), "shelf")
    asked = materialize(queries.join(nodes, "node"), "asked")
    own = lambda c, v: F.array_insert(c, F.lit(1), v)
    start = queries.join(graph, "node", "left").select("node", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("scores", F.array().cast("array<float>")).alias("scores"))
    start = start.select("node", own("ids", F.lit(-1).cast("long")).alias("ids"), own("scores", F.lit(1e30).cast("float")).alias("scores"))
    start = start.select("node", own("ids", F.col("node")).alias("ids"), own("scores", F.lit(2e30).cast("float")).alias("scores"))
    pool = start.select("node", "ids", "scores", F.transform("ids", lambda x: x == F.col("node")).alias("opened"))
    kinds = "node long, ids array<long>, scores array<float>, opened array<boolean>"
    done = None
    for _ in range(SEARCH_ROUNDS):
        pool = materialize(pool, "pool")
        fresh = F.slice(F.filter(F.slice(F.arrays_zip("ids", "opened"), 1, FRONT + 2), lambda x: ~x["opened"]), 1, OPENED)
        front = pool.select("node", F.transform(fresh, lambda x: x["ids"]).alias("front"))
        ended = pool.join(front.where(F.size("front") == 0).select("node"), "node", "left_semi")
        done = ended if done is None else done.union(ended)
        front = front.where(F.size("front") > 0)
        if not front.limit(1).count():
            return done, queries.limit(0)
        found = front.join(asked, "node").select("node", "code", F.explode("front").alias("open")).join(shelf, "open")
        shown = found.select("node", "code", "near", "near_codes").mapInArrow(lambda batches: _score_opened(batches, codes), kinds)
        marked = pool.join(front, "node").select("node", "ids", "scores", F.transform(F.arrays_zip("ids", "opened"), lambda x: x["opened"] | F.array_contains("front", x["ids"])).alias("opened"))
        gathered = shown.union(marked).groupBy("node").agg(F.collect_list(F.struct("ids", "scores", "opened")).alias("shown"))
        pool = gathered.mapInArrow(_pooled, kinds)
    pool = materialize(pool, "pool")
    return pool if done is None else done.union(pool), pool.select("node")


def search_exactly(named: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(node, near): the k nearest of all nodes (node, embedding) to each query node, by blocks of both that meet once."""
    blocks, parts = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-named.count() // VECTOR_BLOCK))
    packed = lambda rows, n, name: rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias(f"{name}_")).agg(F.collect_list(F.struct("node", "embedding")).alias(name))
    asked = packed(queries.join(named, "node").select("node", "embedding"), blocks, "q").withColumn("v_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = asked.repartition(parts, "v_").join(packed(named.select("node", "embedding"), parts, "v").repartition(parts, "v_").hint("shuffle_hash"), "v_").select("q", "v")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (batch.column(c)[i].values for c in range(2))
                x, y = (np.array(part.field("embedding").to_pylist(), np.float64) for part in (q, v))
                node, ids = q.field("node").to_numpy(), v.field("node").to_numpy()
                for j, row in enumerate(x @ y.T):
                    # Ties in the order of nodes are settled later, by exact scores and ids of rows: take all that equal the last.
                    last = np.partition(row, len(row) - min(k, len(row)))[len(row) - min(k, len(row))]
                    best = np.flatnonzero(row >= last - 1e-12 * abs(last))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), node[j])), pa.array(ids[best]), pa.array(row[best])], ["node", "near", "score"])

    rows = met.mapInArrow(run, "node long, near long, score double")
    order = Window.partitionBy("node").orderBy(F.desc("score"))
    # All that equal the k-th, and some more, since these sums may differ in the last bit from those that decide.
    placed = rows.withColumn("r", F.rank().over(order)).withColumn("n", F.row_number().over(order))
    return placed.where((F.col("r") <= k) | (F.col("n") <= k + EXACT)).select("node", "near")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.asarray(v, np.float64) for v in batch.column(i).to_pylist()] for i in (2, 3))
        score = np.array([float(np.dot(x, y)) for x, y in zip(a, b, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["node", "near", "score"])


def _found(named: DataFrame, query_nodes: DataFrame, k: int) -> DataFrame:
    """(node, near): candidates of each query node by the graph, and exactly where its search hasn't ended."""
    pivots = [r["embedding"] for r in named.select("embedding").orderBy(F.xxhash64("embedding"), "node").limit(PIVOTS).collect()]
    if not pivots:
        return query_nodes.select("node", F.col("node").alias("near"))
    codes = Codes(np.array(pivots, np.float64))

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes.encode(x)], pa.binary())], ["node", "code"])

    nodes = materialize(named.select("node", "embedding").mapInArrow(encode, "node long, code binary"), "nodes")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    entries = named.orderBy(F.desc(length), "node").limit(ENTRIES).select("node").union(named.orderBy(F.xxhash64("node")).limit(ENTRIES).select("node")).distinct()
    pool, open_ = search(build_graph(nodes, codes), nodes, query_nodes, codes, materialize(entries, "entries"))
    found = pool.select("node", F.explode(F.slice("ids", 1, EXACT)).alias("near")).where("near >= 0")
    return found.union(search_exactly(named, open_, k + 1)) if open_.limit(1).count() else found


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row whose vec_id is divisible by `every`.

    exact: compare every query with every vector, in blocks, in place of the graph.

    Candidates are all rows but the query's own; nearness is the inner product in double precision;
    ties go to the smaller vec_id. Null, zero and non-finite vectors, and those of an odd length,
    take no part. A vec_id with several vectors is a candidate with each of them, never its own, and asks with
    the smallest; rows that repeat both count once. An empty table gives no rows.
    """
    rows = materialize(usable(vectors), "vectors")
    # Equal vectors are one node, numbered here; of its copies only k + 1 can ever be returned.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    copies = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("copies"))
    named = materialize(copies.select(F.monotonically_increasing_id().alias("node"), "embedding", "copies"), "distinct-vectors")

    asking = materialize(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).join(named.select("node", "embedding"), "embedding").select("vec_id", "node"), "queries")
    query_nodes = materialize(asking.select("node").distinct(), "query-nodes")
    lone = query_nodes.select("node", F.col("node").alias("near"))
    if exact:
        found = search_exactly(named, query_nodes, k + 1).union(lone).distinct()
    else:
        found = _found(named, query_nodes, k).union(lone).distinct()
    vector = named.select(F.col("node"), F.col("embedding").alias("a"))
    pairs = found.join(vector, "node").join(named.select(F.col("node").alias("near"), F.col("embedding").alias("b")), "near")
    scored = pairs.select("node", "near", "a", "b").mapInArrow(_exact, "node long, near long, score double")
    each = scored.join(named.select(F.col("node").alias("near"), "copies"), "near").select("node", "score", F.explode("copies").alias("vec_id"))
    # One more than k per node, for a query that finds itself; at most EXACT * (k + 1) rows meet here.
    listed = each.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("near"))
    listed = materialize(listed, "lists")
    answers = asking.toDF("query_id", "node").join(listed, "node").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
