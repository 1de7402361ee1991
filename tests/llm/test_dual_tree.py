import hashlib

import duckdb
import numpy as np
import pytest

from fluvia.llm import dual_tree


def plain(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), by Python integers."""
    kept = [(i, [int(np.floor(float(c) * 1024)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    kept = [(i, np.array(v, dtype=object)) for i, v in kept if max(map(abs, v)) < dual_tree.LARGEST]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), list(r[1])))
    centres = [v for _, v in order[:k]]
    if not centres:
        return []

    def assign():
        return [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, t) in zip(kept, to, strict=True) if t == j]
            if own:
                centres[j] = np.array([int(s) // len(own) for s in sum(own)], dtype=object)
    to = assign()
    each = [sum(d for d, t in to if t == j) for j in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, t, d, each[t], sum(each), names[t]) for (i, _), (d, t) in zip(kept, to, strict=True)]


def key(row):
    return tuple((v is None, v) for v in row)


def same(got, want):
    return sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("dims", [1, 2, 24])
@pytest.mark.parametrize("leaf", [1, 7])
def test_tree_covers_nests_and_separates(dims, leaf):
    x = np.random.default_rng(dims).integers(-500, 500, (300, dims))
    x[:60] = x[0]
    tree = dual_tree.CoverTree(x, leaf)
    assert sorted(tree.order.tolist()) == list(range(300))
    for i, kids in enumerate(tree.children):
        own = tree.order[tree.start[i] : tree.end[i]]
        far = np.sqrt(((x[own] - x[tree.centre[i]]) ** 2).sum(1))
        assert tree.centre[i] in own and far.max() <= tree.radius[i]
        if kids:
            assert tree.centre[kids[0]] == tree.centre[i]
            assert [tree.start[kids[0]], *(tree.end[c] for c in kids)] == [*(tree.start[c] for c in kids), tree.end[i]]
            centres = x[[tree.centre[c] for c in kids]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
            assert apart.min() > max(tree.radius[c] for c in kids)


def test_pruning_leaves_few_pairs_to_compare():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 16))
    x = centres[rng.integers(0, 8, 2000)] + rng.integers(-300, 300, (2000, 16))
    tree = dual_tree.CoverTree(x)
    flat = dual_tree._flat(tree) | {"rows": x[tree.order].tobytes()}
    where = np.argsort(tree.order)
    flat["centre"] = (where[tree.centre] - np.array(tree.start)).astype(np.int32).tobytes()
    number, compared = dual_tree.Block(flat, 16).assign(centres, dual_tree.CoverTree(centres, 1))
    assert (number == ((x[tree.order][:, None] - centres) ** 2).sum(2).argmin(1)).all()
    assert compared < 0.2 * 2000 * 8


def test_table_against_plain(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert same(dual_tree.cluster(df), plain([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    made = con.sql(dual_tree.oracle_sql())
    df = dual_tree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert sorted(df.columns) == sorted(made.columns)
    assert same(df.select(*made.columns), made.fetchall())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(c) for c in row] for row in rng.normal(size=(40, 4)).round(3)]
    rows = [(i, x) for i, x in enumerate(v)] + [(100 + i, v[0]) for i in range(50)]
    rows += [(7, v[7]), (7, v[7]), (7, v[8]), (None, v[3]), (None, v[3]), (200, None), (201, []), (202, v[0][:3]), (203, [1.0, None, 2.0, 3.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [0.0] * 4), (207, [1e30, 0.0, 0.0, 0.0]), (208, [-1e5, 1e5, 9e4, 0.0])]
    df = spark.createDataFrame([(i, x, "keep", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, x int").repartition(3)
    assert same(dual_tree.cluster(df, dims=4), plain(rows, dims=4))


def test_few_copies_and_empty(spark):
    few = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    kind = "vec_id long, embedding array<float>"
    assert same(dual_tree.cluster(spark.createDataFrame(few, kind), dims=2), plain(few, dims=2))
    out = dual_tree.cluster(spark.createDataFrame([], kind))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_many_copies_are_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 64)
    rows = [(i, [0.5, 0.25]) for i in range(400)] + [(400 + i, [i / 7, -i / 3]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = dual_tree.integer_vectors(df, 2)
    sizes = [len(r["vec_ids"]) for r in dual_tree.build_blocks(x, 2).select("vec_ids").collect()]
    assert sum(sizes) == 500 and max(sizes) <= 64
    assert same(dual_tree.cluster(df, dims=2), plain([(i, [float(np.float32(c)) for c in v]) for i, v in rows], dims=2))
