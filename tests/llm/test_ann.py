import math

import numpy as np
import pytest

from fluvia.llm import ann


def plain(rows, every=20, k=20):
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(np.array(x), np.array(y))), v) for v, y in rows if v != q)[:k]
            out[q] = [(v, -s) for s, v in near]
    return out


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(15)]
    odd = [(100, None), (120, [0.0] * 8), (140, [math.nan] * 8), (160, [1.0, None, *[0.0] * 6]), (180, [math.inf] * 8), (None, [1.0] * 8), (200, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "'y' AS node")
    got, want = gathered(ann.nearest_neighbours(df)), plain(rows)
    assert got.keys() == want.keys() == {0}
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]] and np.allclose([s for _, s in got[0]], [s for _, s in want[0]])


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100 + i, [0.5, 0.1 * i]) for i in range(5)]
    got = gathered(ann.nearest_neighbours(spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")))
    assert [v for v, _ in got[20]] == list(range(20)) and [v for v, _ in got[0]] == list(range(1, 21))
    assert [v for v, _ in got[100]] == [v for v, _ in plain(rows)[100]]


def test_empty_table(spark):
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_recall(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in ann.usable(df).collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = gathered(ann.nearest_neighbours(df))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[: min(20, len(ids) - 1)]
        mine = got[int(ids[q])]
        assert len(mine) == len(best)
        assert all(np.isclose(score, x[np.flatnonzero(ids == v)[0]] @ x[q], rtol=1e-12) for v, score in mine[:3])
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hits += len({v for v, _ in mine} & set(ids[best].tolist()))
        total += len(best)
    assert hits / total >= 0.9, hits / total


def test_one_id_with_several_vectors(spark):
    """Each vector is a candidate, none for its own id; the id asks with the smallest."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(20, [5.0, 0.5]), (7, [100.0, 0.0]), (7, [100.0, 0.0])]
    got = gathered(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5))
    own = min(x for v, x in rows if v == 20)
    want = sorted({(-float(np.dot(own, x)), v, tuple(x)) for v, x in rows if v != 20})[:5]
    assert got == {20: [(v, -s) for s, v, _ in want]}


def clustered(n, d=64, tight=0.05):
    """Random vectors, a third of them in one dense cluster."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    x[: n // 3] = rng.normal(size=d) + tight * rng.normal(size=(n // 3, d))
    return x[rng.permutation(n)].astype(np.float32).astype(np.float64)


def recalls(got, x):
    out = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        out.append(len({v for v, _ in got[q]} & set(np.argpartition(-s, 19)[:20].tolist())) / 20)
    return np.sort(out)


@pytest.mark.parametrize("tight", [0.05, 0.002])
def test_recall_where_a_third_is_one_dense_cluster(spark, tight, monkeypatch):
    """With pools and fronts far below the number of vectors."""
    monkeypatch.setattr(ann, "FRONT", 64)
    monkeypatch.setattr(ann, "POOL", 160)
    x = clustered(4000, tight=tight)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    found = recalls(gathered(ann.nearest_neighbours(df)), x)
    assert found.mean() >= 0.9 and found[: len(found) // 20].mean() >= 0.5, (found.mean(), found[:10])


def test_exact_search_and_searches_that_do_not_end(spark, monkeypatch):
    x = clustered(900, 16)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = plain(rows)
    for options in ({"exact": True}, {}):
        if not options:  # no round at all: everybody is left to the exact way
            monkeypatch.setattr(ann, "SEARCH_ROUNDS", 0)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
        monkeypatch.setattr(ann, "VECTOR_BLOCK", 100)
        got = gathered(ann.nearest_neighbours(df, **options))
        assert got.keys() == want.keys()
        assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in want)


def test_codes_keep_what_tells_close_vectors_apart():
    x = clustered(600, tight=0.002)
    codes = ann.Codes(x[:256])
    assert np.abs(codes.decode(codes.encode(x)) - x)[: 200].max() < 0.05
    dense = x[np.linalg.norm(x - np.median(x, 0), axis=1) < 12]
    assert np.abs(codes.decode(codes.encode(dense)) - dense).max() < 0.05
