import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.llm import toxicity


@pytest.fixture(scope="module")
def trained(spark):
    """A corpus in which some words make a text toxic."""
    rng = random.Random(1)
    calm = [f"word{i}" for i in range(300)]
    bad = ["vile", "scum", "hateful", "wretch"]
    rows = []
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(trained):
    docs, _, net, truth = trained
    rows = toxicity.score_documents(docs, net).select("doc_id", "score", "predicted", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["h"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95


def test_awkward_texts(trained, awkward, nothing):
    net = trained[2]
    out = toxicity.score_documents(awkward, net)
    assert out.columns.count("score") == 1 and dict(out.dtypes)["score"] == "double"
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1 and np.isclose(blank.pop(), net.prior)
    assert len({r["score"] for r in rows if r["doc_id"] == 18}) == 1
    assert toxicity.score_documents(nothing, net).count() == 0


def test_labels_that_cannot_teach(spark, awkward):
    labels = spark.createDataFrame([(1, None), (3, 1), (99, 0)], "doc_id long, toxic int")
    net = toxicity.fit(awkward, labels)
    assert toxicity.score_documents(awkward, net).count() == awkward.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(awkward, toxicity.fit(awkward, none)).collect()} == {0.0}


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 88, 89, 100, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_gradients():
    rng = np.random.default_rng(3)
    net = toxicity.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["alpha", "beta", "gamma", "delta"]
    spread = toxicity._spread(words)
    index = rng.integers(0, 4, (3, toxicity.WINDOW))
    mask = np.ones(index.shape, np.float32)
    mask[1, 20:] = 0
    bag, y = np.array([0, 1, 0]), np.array([1, 0])

    def loss():
        x = net.inputs(spread).astype(np.float64)
        gates = net.gates(x)
        t = np.bincount(bag, np.logaddexp(0, net.forward(gates, index, mask)))
        return np.where(y == 1, -np.log(-np.expm1(-t)), t).mean(), net.backward(index, mask, bag, y, x, spread, gates)

    _, grads = loss()
    for name in ("uf", "wb", "att", "out", "cf"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        step, old = 1e-3, net.p[name][at]
        net.p[name][at] = old + step
        up = loss()[0]
        net.p[name][at] = old - step
        down = loss()[0]
        net.p[name][at] = old
        assert np.isclose((up - down) / (2 * step), grads[name][at], rtol=0.05, atol=2e-5), name
    rows, moved = grads["word"]
    step, at = 1e-2, (rows[0], 3)
    old = net.p["word"][at]
    net.p["word"][at] = old + step
    up = loss()[0]
    net.p["word"][at] = old - step
    assert np.isclose((up - loss()[0]) / (2 * step), moved[0, 3], rtol=0.05, atol=2e-5)


def plain_score(net, text):
    """The score of a text, one number at a time."""
    words, size, h = toxicity.words_of(text), toxicity.WIDE, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))

    def vector(word):
        grams = toxicity._grams(word)
        return [float(v) for v in net.p["word"][zlib.crc32(word.encode()) % toxicity.BUCKETS]] + [sum(float(net.p["gram"][g][k]) for g in grams) / len(grams) for k in range(size)]

    total = 0.0
    for start in toxicity.window_starts(len(words)):
        vectors = [vector(w) for w in words[start : start + toxicity.WINDOW]]
        states = [[0.0] * (2 * h) for _ in vectors]
        for d, shift, order in (("f", 0, range(len(vectors))), ("b", h, range(len(vectors) - 1, -1, -1))):
            w, u, c, prev = (net.p[f"{k}{d}"] for k in "wuc"), None, None, [0.0] * h
            w, u, c = w
            for t in order:
                x = [float(c[j]) + sum(vectors[t][i] * float(w[i][j]) for i in range(2 * size)) for j in range(3 * h)]
                r = [sum(prev[i] * float(u[i][j]) for i in range(h)) for j in range(3 * h)]
                reset, keep = [sig(x[j] + r[j]) for j in range(h)], [sig(x[h + j] + r[h + j]) for j in range(h)]
                new = [math.tanh(x[2 * h + j] + reset[j] * r[2 * h + j]) for j in range(h)]
                prev = [(1 - keep[j]) * new[j] + keep[j] * prev[j] for j in range(h)]
                states[t][shift : shift + h] = prev
        weight = [math.exp(sum(s * float(a) for s, a in zip(row, net.p["att"], strict=True))) for row in states]
        pooled = [sum(v * row[j] for v, row in zip(weight, states, strict=True)) / sum(weight) for j in range(2 * h)]
        logit = float(net.p["bias"][0]) + sum(a * float(b) for a, b in zip(pooled, net.p["out"], strict=True))
        total += math.log1p(math.exp(logit))
    return sig(net.slope * (total + math.log(-math.expm1(-total))) + net.shift)


def test_against_plain_scores(trained):
    docs, _, net, _ = trained
    rows = docs.where("doc_id < 12").collect()
    texts = [r["text"] for r in rows] + ["scum", "One word1 scum " * 20, "x" * 500 + " vile"]
    for text, score in zip(texts, toxicity.Scorer(net).scores(texts), strict=True):
        assert np.isclose(score, plain_score(net, text), rtol=1e-3, atol=1e-5)


def test_equal_texts_score_equally_beside_others(trained):
    docs, _, net, _ = trained
    texts = [r["text"] for r in docs.collect()]
    whole = toxicity.Scorer(net).scores(texts)
    for size in (1, 7, 100):
        scorer = toxicity.Scorer(net)
        assert [s for i in range(0, 200, size) for s in scorer.scores(texts[i : i + size])][:200] == whole[:200]
    assert toxicity.Scorer(net).scores(texts[::-1])[::-1] == whole


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + "long " * (i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    seen = []
    keep, toxicity.train = toxicity.train, lambda texts, y, prior: seen.append((texts, y, prior))
    try:
        toxicity.fit(docs, labels, 9, 600)
    finally:
        toxicity.train = keep
    texts, y, prior = seen[0]
    assert 0 < len(texts) <= 18 and sum(len(t) for t in texts) <= 600 and set(y) == {0, 1}
