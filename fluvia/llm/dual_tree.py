"""Centroid clustering by dual-tree Lloyd rounds.

Vectors, as integers, are dealt once to blocks of bounded size, near ones together, and every block gets a
cover tree: a node has a vector of its own as centre, a radius, and a run of the block's vectors. In a
round the centroids get a tree as well, small and sent to every task. Pairs of a node of vectors
and nodes of centroids are pruned by bounds on their distance; a node that is left with one centroid is
assigned whole, and leaves that aren't compare their vectors exactly. Tasks give sums and counts per
centroid, which Spark adds up: what reaches the driver is the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.session import materialize, ship

#: Vectors of a block, of a leaf; rows of the documented sample that gives the blocks their places.
BLOCK, LEAF, PIVOTS = 2048, 16, 256
SCALE = 1024
#: Components from here on can't have distances in 64 bits.
LARGEST = 1 << 27
#: Pairs of nodes that are held at a time, about.
PAIRS = 1 << 16
#: Bounds are floating: pairs are pruned only where they are apart by more than this share.
SLACK = 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and y, both integers."""
    dims = max(1, x.shape[1])
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * dims * top * top < 1 << 53:  # exact as doubles, by the matrix product
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1) if len(y) else np.zeros((len(x), 0), np.int64)


class CoverTree:
    """A cover tree over rows of integers. Nodes stand in depth-first order; node i has the rows
    order[start[i]:end[i]], all within radius[i] of rows[centre[i]], and children[i]; leaves have none."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.leaf = rows, leaf
        self.centre, self.radius, self.start, self.end, self.children = [], [], [], [], []
        self.order: list[int] = []
        if len(rows):
            distance = np.sqrt(squared(rows, rows[:1])[:, 0])
            top = float(distance.max())
            # Scales halve on the way down; a stack in place of recursion, since depths follow the data.
            stack = [(0, np.arange(len(rows)), distance, top, -1)]
            while stack:
                stack.extend(reversed(self._node(*stack.pop())))
        self.order = np.array(self.order, np.int64)

    def _node(self, centre: int, members: np.ndarray, distance: np.ndarray, scale: float, parent: int) -> list[tuple]:
        """Add a node; (centre, members, distances, scale, parent) of its children."""
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.start.append(len(self.order))
        self.end.append(len(self.order) + len(members))
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(node)
        if len(members) <= self.leaf or self.radius[node] == 0:
            self.order.extend(members.tolist())
            return []
        # The node's own centre comes first (nesting); then any vector that none covers yet (separation).
        while scale >= self.radius[node]:
            scale /= 2
        found, rest, far, pick = [], members, distance, centre
        while len(rest):
            near = far <= scale
            found.append((pick, rest[near], far[near], scale, node))
            rest = rest[~near]
            if len(rest):
                pick = int(rest[0])
                far = np.sqrt(squared(self.rows[rest], self.rows[pick : pick + 1])[:, 0])
        return found


def _flat(tree: CoverTree) -> dict[str, bytes]:
    """A tree as bytes."""
    sizes = [len(c) for c in tree.children]
    return {
        "centre": np.array(tree.centre, np.int32).tobytes(),
        "radius": np.array(tree.radius, np.float64).tobytes(),
        "start": np.array(tree.start, np.int32).tobytes(),
        "end": np.array(tree.end, np.int32).tobytes(),
        "first": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes(),
        "children": np.array([x for c in tree.children for x in c], np.int32).tobytes(),
    }


class Block:
    """A block's vectors, in the order of its tree, and the tree."""

    def __init__(self, row: dict, dims: int):
        self.x = np.frombuffer(row["rows"], np.int64).reshape(-1, dims)
        self.centre, self.start, self.end, self.first, self.children = (np.frombuffer(row[c], np.int32) for c in ("centre", "start", "end", "first", "children"))
        self.radius = np.frombuffer(row["radius"], np.float64)

    def assign(self, centroids: np.ndarray, tree: CoverTree) -> tuple[np.ndarray, int]:
        """Nearest centroid of every row (ties: the smaller number), and how many pairs of a vector and a centroid were compared."""
        out, compared = np.zeros(len(self.x), np.int64), 0
        places, spread = centroids[np.array(tree.centre)], np.array(tree.radius)
        kids = np.array([len(c) for c in tree.children])
        kid = np.array([x for c in tree.children for x in c], np.int64)
        first_kid = np.cumsum(kids) - kids
        held = np.array(tree.end) - np.array(tree.start)
        own = self.x[self.start + self.centre]
        # Pairs (node, node of centroids), those of a node together; all of them are pruned and opened at once.
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.x) else []
        while stack:
            v, c = stack.pop()
            while True:
                d = np.sqrt(((own[v] - places[c]) ** 2).sum(1))
                runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                # The centre of a node of centroids is a centroid: nobody here is farther from it than this.
                bound = np.repeat(np.minimum.reduceat(d + self.radius[v], runs), np.diff(np.r_[runs, len(v)]))
                kept = d - self.radius[v] - spread[c] <= bound * (1 + SLACK) + SLACK
                v, c = v[kept], c[kept]
                if not kids[c].any():
                    break
                n = np.maximum(1, kids[c])
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                v, old = np.repeat(v, n), np.repeat(c, n)
                c = np.where(kids[old] > 0, kid[np.minimum(first_kid[old] + at, len(kid) - 1)], old)
            runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            left = np.add.reduceat(held[c], runs)
            leaf = self.first[v[runs]] == self.first[v[runs] + 1]
            for i in np.flatnonzero(left == 1):
                node = v[runs[i]]
                out[self.start[node] : self.end[node]] = tree.order[tree.start[c[runs[i]]]]
            ends = np.r_[runs[1:], len(v)]
            for i in np.flatnonzero((left > 1) & leaf):
                a, b = self.start[v[runs[i]]], self.end[v[runs[i]]]
                numbers = np.sort(np.concatenate([tree.order[tree.start[k] : tree.end[k]] for k in c[runs[i] : ends[i]]]))
                compared += int(b - a) * len(numbers)
                out[a:b] = numbers[squared(self.x[a:b], centroids[numbers]).argmin(1)]
            some = np.flatnonzero((left > 1) & ~leaf)
            # A bounded number of pairs at a time.
            for part in np.array_split(some, max(1, -(-len(v) * 8 // PAIRS))):
                new_v, new_c = [], []
                for i in part:
                    below = self.children[self.first[v[runs[i]]] : self.first[v[runs[i]] + 1]]
                    new_v.append(np.repeat(below, ends[i] - runs[i]))
                    new_c.append(np.tile(c[runs[i] : ends[i]], len(below)))
                if new_v:
                    stack.append((np.concatenate(new_v).astype(np.int64), np.concatenate(new_c)))
        return out, compared


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def integer_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and x, floor(1024 * component) of rows with exactly dims components, none null or non-finite."""
    rows = vectors.select("vec_id", "embedding").where(F.size("embedding") == dims)
    rows = rows.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))")
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    return rows.select("vec_id", x.alias("x")).where(F.forall("x", lambda v: (v < LARGEST) & (v > -LARGEST)))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of 3:<vec_id>, in that order; null ids last, repeated ids by their vectors."""
    name = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(name.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def build_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """A row per block: vec_ids and the vectors as bytes in the order of its cover tree, and the tree."""
    # A sample of bounded size places the blocks; every vector is in one, whatever the sample.
    sample = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(PIVOTS).collect()
    pivots = np.array([r["x"] for r in sample], np.int64).reshape(-1, dims)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell = squared(_rows(batch.column(1), dims), pivots).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "x", "cell"])

    types = f"vec_id {dict(rows.dtypes)['vec_id']}, x array<long>"
    placed = materialize(rows.mapInArrow(place, f"{types}, cell int"), "placed-vectors")
    # Cells over a block's size are dealt out by hash, copies of one vector too: ids differ, and a salt parts what doesn't.
    sizes = materialize(placed.groupBy("cell").count(), "cell-sizes")
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.ceil(F.col("count") / (BLOCK / 2)))
    dealt = placed.join(F.broadcast(sizes), "cell").select("vec_id", "x", "cell", part.alias("part"))
    binary = ", ".join(f"{c} binary" for c in ("rows", "centre", "radius", "start", "end", "first", "children"))
    ids = f"vec_ids array<{dict(rows.dtypes)['vec_id']}>"

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _rows(table.column("x").chunk(0), dims)
        tree = CoverTree(x)
        # Centres as places within a node's own run, and rows in the tree's order.
        where = np.empty(len(x), np.int64)
        where[tree.order] = np.arange(len(x))
        flat = _flat(tree) | {"rows": x[tree.order].tobytes(), "centre": (where[tree.centre] - np.array(tree.start)).astype(np.int32).tobytes()}
        named = pa.array([table.column("vec_id").take(pa.array(tree.order)).to_pylist()], pa.list_(table.schema.field("vec_id").type))
        return pa.table({"vec_ids": named} | {c: pa.array([flat[c]], pa.binary()) for c in ("rows", "centre", "radius", "start", "end", "first", "children")})

    return materialize(dealt.groupBy("cell", "part").applyInArrow(grow, f"{ids}, {binary}"), "cover-trees")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names) if n != "vec_ids"}
            yield {"vec_ids": batch.column(batch.schema.get_field_index("vec_ids"))[i].values if "vec_ids" in batch.schema.names else None}, Block(row, dims)


def lloyd_round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of the means; those of nobody stay."""
    k, dims = centroids.shape

    def run(batches):
        tree, sums, counts = CoverTree(centroids, 1), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, block in _blocks(batches, dims):
            number, _ = block.assign(centroids, tree)
            order = np.argsort(number, kind="stable")
            at = np.flatnonzero(np.bincount(number, minlength=k))
            sums[at] += np.add.reduceat(block.x[order], np.searchsorted(number[order], at), axis=0)
            counts += np.bincount(number, minlength=k)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    each = blocks.drop("vec_ids").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = each.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    moved = centroids.copy()
    for r in total.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return moved


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for the vectors of (vec_id, embedding).

    Vectors of exactly dims components take part, none of them null or non-finite, each as floor(1024 *
    component); components of 2**17 or more in size, whose distances need over 64 bits, take no part
    either. Centroids start as the vectors of the k smallest sha256 of 3:<vec_id> (fewer vectors: fewer
    centroids). Ties go to the smaller number. Repeated rows count each, null ids too (never first as
    starts); other columns are left out; an empty table gives no rows. Distances and means are exact.
    """
    rows = materialize(integer_vectors(vectors, dims), "integer-vectors")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    ship(rows.sparkSession)
    blocks = build_blocks(rows, dims)
    for _ in range(rounds):
        centroids = lloyd_round(blocks, centroids)

    def assign(batches):
        tree = CoverTree(centroids, 1)
        for ids, block in _blocks(batches, dims):
            number, _ = block.assign(centroids, tree)
            distance = ((block.x - centroids[number]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids["vec_ids"], pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(blocks.mapInArrow(assign, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"), "assigned")
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # k rows at most.
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(i, inertia[i], sum(inertia.values()), names[i]) for i in sorted(inertia)]
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """DuckDB SQL of cluster() over embeddings, a pair of table expressions a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, first(i ORDER BY d, i) AS i, min(d) AS d FROM (
    SELECT v.vec_id, v.x, c.i, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c
  ) GROUP BY vec_id, x
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM (
    SELECT i, p, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT i, unnest(x) AS e, unnest(range({dims})) AS p FROM a{r}) GROUP BY i, p
  ) GROUP BY i
), c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.i = m.i)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS i, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})
), {", ".join(steps)}
SELECT a.vec_id, CAST(a.i AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.i = c.i
"""
