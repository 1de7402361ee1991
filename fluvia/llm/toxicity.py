"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as an embedding of itself and the mean embedding of its character n-grams. Windows of
WINDOW words, each overlapping the next, cover the whole text; each gets a logit from the network, and a
document is toxic if any of its windows is (a noisy or). The network learns from documents as bags of
windows, so clean windows of a toxic text aren't taught to be toxic. A part of the labelled documents is
kept from its gradients: it chooses the epoch to stop at and calibrates the score.
Training reads a bounded, documented sample of labelled rows; scoring is a map without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import map_texts

#: Labelled rows of either class that training reads at most, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 1500, 8 << 20
#: Words of a window and between the starts of two windows.
WINDOW, STRIDE = 48, 40
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Rows of the embedding tables, their width, hidden units of a direction.
BUCKETS, WIDE, HIDDEN = 1 << 15, 8, 8
#: Passes over the sample, windows of a step (more only for one long document), rate of the steps.
EPOCHS, BATCH, RATE, SEED = 3, 128, 0.01, 7
#: Passes without a smaller loss of the documents kept apart, after which training ends (samples of few steps: more).
PATIENCE = 2
#: Documents of the sample that must hold a word or n-gram for it to get an embedding.
KNOWN_FROM = 4
#: One in so many documents of the sample is kept from the gradients.
CHECKED = 5
#: Characters of texts that are scored at a time, about (one longer text may exceed them).
SCORED = 1 << 21
#: Rows of a product in scoring: always so many, padded, since the order of sums may follow the shape.
BLOCK = 512
#: Words whose gate inputs a task keeps, and their characters; the table is emptied when full.
MEMO_WORDS, MEMO_CHARS = 200_000, 8 << 20

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall((text or "").lower())


def _grams(word: str) -> list[int]:
    """Buckets of a word's character 3- to 5-grams, its edges marked."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (3, 4, 5) for i in range(max(1, len(w) - n + 1))]


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: their buckets, all n-gram buckets, and the first n-gram of each word."""
    grams = [_grams(w) for w in words]
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    return np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words)), np.fromiter((g for x in grams for g in x), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n words; the last window ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _row_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b with each row summed in the same order, which the library's fast product doesn't do."""
    return np.einsum("nk,kj->nj", a, b)


@dataclass
class Network:
    """Parameters: embeddings, per direction input and recurrent weights, attention, output; a score's slope and shift."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        h, f = HIDDEN, np.float32
        p = {k: rng.normal(0, 0.1, (BUCKETS, WIDE)).astype(f) for k in ("word", "gram")}
        for d in "fb":
            p |= {f"w{d}": rng.normal(0, 0.3, (2 * WIDE, 3 * h)).astype(f), f"u{d}": rng.normal(0, 0.3, (h, 3 * h)).astype(f), f"c{d}": np.zeros(3 * h, f)}
        p |= {"att": rng.normal(0, 0.3, 2 * h).astype(f), "out": rng.normal(0, 0.3, 2 * h).astype(f), "bias": np.full(1, -4, f)}
        return Network(p)

    def inputs(self, spread: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Vectors (words, 2 * WIDE) of words given as their buckets."""
        own, grams, first = spread
        counts = np.diff(first, append=len(grams))
        mean = np.add.reduceat(self.p["gram"][grams], first) / counts[:, None]
        return np.concatenate([self.p["word"][own], mean], 1).astype(np.float32)

    def gates(self, x: np.ndarray, product=np.matmul) -> dict[str, np.ndarray]:
        return {d: product(x, self.p[f"w{d}"]) + self.p[f"c{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (rows of index: words' places in gates; mask: 1 where there is a word)."""
        n, t_all = index.shape
        h, states, tape = HIDDEN, np.empty((t_all, n, 2 * HIDDEN), np.float32), {}
        product = np.matmul if keep else _row_product
        index, mask = np.ascontiguousarray(index.T), np.ascontiguousarray(mask.T)
        for d, half in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, prev = self.p[f"u{d}"], np.zeros((n, h), np.float32)
            for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
                x, r = gates[d][index[t]], product(prev, u)
                rz = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
                new = np.tanh(x[:, 2 * h :] + rz[:, :h] * r[:, 2 * h :])
                m = mask[t, :, None]
                z = rz[:, h:] if m.all() else rz[:, h:] * m + (1 - m)  # without a word the state stays
                state = new + z * (prev - new)
                if keep:
                    tape[d, t] = prev, rz, new, z, r[:, 2 * h :], m
                prev = state
                states[t, :, half] = state
        score = np.einsum("tnk,k->tn", states, self.p["att"]) - 1e4 * (1 - mask)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = np.einsum("nk,k->n", pooled, self.p["out"]) + self.p["bias"][0]
        return (logit, states, weight, pooled, tape) if keep else logit

    def backward(self, index, mask, bag, y, x, spread, gates) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Gradients of the mean cross-entropy of documents; those of embeddings with the rows they are for.

        bag: the document of each window.
        """
        logit, states, weight, pooled, tape = self.forward(gates, index, mask, True)
        p, h, n = self.p, HIDDEN, len(logit)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        # With t the sum of softplus(logit) over a document's windows, none of them is toxic with exp(-t).
        t = np.maximum(np.bincount(bag, np.logaddexp(0, logit), len(y)), 1e-9)
        d_t = np.where(y > 0.5, 1 / -np.expm1(t), 1.0) / len(y)
        d_logit = (_sigmoid(logit) * d_t[bag]).astype(np.float32)
        g["out"], g["bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pool = d_logit[:, None] * p["out"]
        along = np.einsum("tnk,nk->tn", states, d_pool)
        d_score = weight * (along - (weight * along).sum(0))
        g["att"] = np.einsum("tn,tnk->k", d_score, states)
        d_states = weight[:, :, None] * d_pool + d_score[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        order = np.argsort(index.T.reshape(-1), kind="stable")
        places, first = np.unique(index.T.reshape(-1)[order], return_index=True)
        for d in "fb":
            u, carry = p[f"u{d}"], np.zeros((n, h), np.float32)
            d_gate = np.zeros((index.shape[1], n, 3 * h), np.float32)
            for t in range(index.shape[1] - 1, -1, -1) if d == "f" else range(index.shape[1]):
                prev, rz, new, z, rn, m = tape[d, t]
                d_h = carry + d_states[t, :, :h] if d == "f" else carry + d_states[t, :, h:]
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (prev - new) * m * rz[:, h:] * (1 - rz[:, h:])
                d_r = d_new * rn * rz[:, :h] * (1 - rz[:, :h])
                rec = np.concatenate([d_r, d_z, d_new * rz[:, :h]], 1)
                g[f"u{d}"] += prev.T @ rec
                carry = d_h * z + rec @ u.T
                d_gate[t] = np.concatenate([d_r, d_z, d_new], 1)
            flat = np.add.reduceat(d_gate.reshape(-1, 3 * h)[order], first)
            total = np.zeros((len(x), 3 * h), np.float32)
            total[places] = flat
            g[f"w{d}"], g[f"c{d}"] = x.T @ total, total.sum(0)
            d_x += total @ p[f"w{d}"].T
        own, grams, first = spread
        counts = np.diff(first, append=len(grams))
        d_gram = np.repeat(d_x[:, WIDE:] / counts[:, None], counts, 0)
        for name, at, d in (("word", own, d_x[:, :WIDE]), ("gram", grams, d_gram)):
            rows, local = np.unique(at, return_inverse=True)
            g[name] = rows, np.stack([np.bincount(local, d[:, k], len(rows)) for k in range(WIDE)], 1).astype(np.float32)
        return g


def bag_logit(logits: np.ndarray) -> float:
    """Logit of a document, one of whose windows at least is toxic, from the logits of all its windows."""
    t = max(float(np.logaddexp(0, logits.astype(np.float64)).sum()), 1e-9)
    return t + float(np.log(-np.expm1(-t)))


def _index(texts: list[list[str]], place: dict[str, int], starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = sum(map(len, starts))
    index, mask, row = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.float32), 0
    for words, at in zip(texts, starts, strict=True):
        ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        for s in at:
            part = ids[s : s + WINDOW]
            index[row, : len(part)] = part
            mask[row, : len(part)] = 1
            row += 1
    return index, mask


def _blocks(n: int) -> list[slice]:
    return [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]


def _padded(rows: np.ndarray) -> np.ndarray:
    return rows if len(rows) == BLOCK else np.concatenate([rows, np.zeros((BLOCK - len(rows), *rows.shape[1:]), rows.dtype)])


class Scorer:
    """Scores texts with a trained network; keeps the gate inputs of words it has met.

    Every product has BLOCK rows, each summed alike, so a window's logit doesn't depend on what is scored beside it.
    """

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.place, self.used, self.chars = {}, 0, 0
        self.table = {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}

    def _meet(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        size = sum(map(len, new))
        if self.used + len(new) > MEMO_WORDS or self.chars + size > MEMO_CHARS:
            self._forget()
            new = list(words)
            size = sum(map(len, new))
        if not new:
            return
        x = self.net.inputs(_spread(new))
        room = self.used + len(new)
        for d in "fb":
            if room > len(self.table[d]):  # in place, so that old and new never stand side by side
                self.table[d].resize((room + room // 2, 3 * HIDDEN), refcheck=False)
        for part in _blocks(len(new)):
            gates = self.net.gates(_padded(x[part]), _row_product)
            n = len(x[part])
            for d, rows in gates.items():
                self.table[d][self.used + part.start : self.used + part.start + n] = rows[:n]
        self.place.update(zip(new, range(self.used, room), strict=True))
        self.used, self.chars = room, self.chars + size

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Logits of all overlapping windows of each text."""
        words = [words_of(t) for t in texts]
        self._meet(set().union(*words))
        starts = [window_starts(len(w)) for w in words]
        index, mask = _index(words, self.place, starts)
        parts = [self.net.forward(self.table, _padded(index[b]), _padded(mask[b]))[: len(index[b])] for b in _blocks(len(index))]
        ends = np.cumsum([len(s) for s in starts])
        return np.split(np.concatenate(parts or [np.zeros(0, np.float32)]), ends[:-1])

    def logits(self, texts: list[str | None]) -> list[float | None]:
        """Logits of documents before calibration; None for texts without a word."""
        return [bag_logit(r) if len(r) else None for r in self.window_logits(texts)]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores from 0 to 1; texts without a word get the share of toxic labels."""
        net = self.net
        if not net.p:
            return [net.prior] * len(texts)
        return [net.prior if v is None else float(_sigmoid(net.slope * v + net.shift)) for v in self.logits(texts)]


def _known(found: list[np.ndarray]) -> np.ndarray:
    """Which buckets at least KNOWN_FROM documents hold; found: those of each document."""
    held = np.zeros(BUCKETS, np.int64)
    for buckets in found:
        held[np.unique(buckets)] += 1
    return held >= KNOWN_FROM


def _calibrate(logits: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a ridge logistic regression on logits, weighted so that its classes have the prior."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0.5, prior / share, (1 - prior) / (1 - share))
    x, beta, pull = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.1])

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (pull * (b - [1.0, 0.0]) ** 2).sum() / 2)

    for _ in range(40):  # Newton steps, halved until the loss falls
        p = _sigmoid(x @ beta)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, x.T @ (weight * (p - y)) + pull * (beta - [1.0, 0.0]))
        while loss(beta - move) > loss(beta) and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta - move
    return max(float(beta[0]), 0.05), float(beta[1])


def train(texts: list[str | None], labels: list[int], prior: float) -> Network:
    """A network trained on texts with labels 0 or 1; prior: the share of label 1 among all rows.

    Every CHECKED-th text of either class is kept from the gradients; the epoch after which these have
    the smallest loss is returned, calibrated on them. Without both classes, or with too few texts to keep
    some of either apart: the prior for every text.
    """
    y_all = np.array(labels, np.int64)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y_all))
    check = np.concatenate([order[y_all[order] == c][::CHECKED] for c in (0, 1)])
    learn = np.setdiff1d(order, check)
    words = [words_of(t) for t in texts]
    starts = [window_starts(len(w)) for w in words]
    counts = np.array([len(s) for s in starts], np.int64)
    check, learn = check[counts[check] > 0], learn[counts[learn] > 0]
    if any(len(set(y_all[part].tolist())) < 2 for part in (check, learn)):
        return Network({}, prior=prior)
    net = Network.fresh(rng)
    vocabulary = sorted(set().union(*words))
    place = {w: i for i, w in enumerate(vocabulary)}
    owns, grams_all, firsts = _spread(vocabulary)
    sizes_all = np.diff(firsts, append=len(grams_all))
    ids = [np.unique(np.fromiter(map(place.__getitem__, words[i]), np.int64, len(words[i]))) for i in learn]
    known = {"word": _known([owns[i] for i in ids]), "gram": _known([grams_all[_ranges(firsts[i], sizes_all[i])] for i in ids])}
    for name, rows in known.items():
        net.p[name][~rows] = 0
    index, mask = _index(words, place, starts)
    first_window = np.cumsum(counts) - counts
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    batches = max(1, int(counts[learn].sum()) // BATCH)
    epochs = max(EPOCHS, -(-400 // batches))  # small samples are passed more often
    steps, step, best = epochs * batches, 0, None
    for epoch in range(epochs):
        for part in _batches(rng.permutation(learn), counts):
            at = _ranges(first_window[part], counts[part])
            used, local = np.unique(index[at], return_inverse=True)
            sizes = sizes_all[used]
            spread = owns[used], grams_all[_ranges(firsts[used], sizes)], np.cumsum(sizes) - sizes
            x = net.inputs(spread)
            bag = np.repeat(np.arange(len(part)), counts[part])
            grads = net.backward(local.reshape(len(at), WINDOW), mask[at], bag, y_all[part], x, spread, net.gates(x))
            step += 1
            rate = RATE * max(0.05, min(1, 2 * (1 - step / steps)))
            for k, g in grads.items():
                rows = slice(None)
                if k in known:  # embeddings move, and their moments too, when a step meets them
                    rows, g = g[0][known[k][g[0]]], g[1][known[k][g[0]]]
                    g = g + 1e-5 * net.p[k][rows]
                m, v = moments[k]
                m[rows] += 0.1 * (g - m[rows])
                v[rows] += 0.001 * (g * g - v[rows])
                net.p[k][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-8)
        scorer = Scorer(net)
        logits = np.array([v for i in range(0, len(check), 128) for v in scorer.logits([texts[j] for j in check[i : i + 128]])])
        slope, shift = _calibrate(logits, y_all[check], prior)
        p = np.clip(_sigmoid(slope * logits + shift), 1e-7, 1 - 1e-7)
        y = y_all[check]
        loss = -np.log(p[y == 1]).mean() * prior - np.log(1 - p[y == 0]).mean() * (1 - prior)
        if best is None or loss < best[0]:
            best = loss, {k: v.copy() for k, v in net.p.items()}, slope, shift, epoch
        elif epoch - best[4] >= max(PATIENCE, epochs // 4):
            break
    return Network(*best[1:4], prior=prior)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the slices from start with the given sizes, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _batches(order: np.ndarray, counts: np.ndarray):
    """Cut documents into steps of about BATCH windows."""
    which = np.cumsum(counts[order]) // BATCH
    return np.split(order, np.flatnonzero(np.diff(which)) + 1)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network:
    """A network trained on at most train_docs labelled rows of either class, of train_bytes together at most.

    Rows with a null label, a label other than 0 or 1, a held-out doc_id or no document are left out. The sample
    is the same on every run: rows in order of their ids' hashes; those whose text goes beyond what is left
    of train_bytes, or is longer than a sixteenth of it, are passed over. Only the sample reaches the driver;
    ids or labels that repeat make no difference to these bounds.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    size, order = F.coalesce(F.octet_length("text"), F.lit(0)), (F.xxhash64("doc_id"), "doc_id")
    sample = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).distinct().orderBy(*order).limit(train_docs)
        sample = part if sample is None else sample.union(part)
    # Both lists below have at most twice train_docs rows: a bound that doesn't grow with the tables.
    rows = docs.select("doc_id", size.alias("size"), F.xxhash64("text").alias("sig")).join(F.broadcast(sample), "doc_id")
    listed = rows.where(F.col("size") <= train_bytes // 16).distinct()
    keys, kept = [], {0: train_bytes // 2, 1: train_bytes // 2}
    for label in (0, 1):
        for r in listed.where(F.col("toxic") == label).orderBy(*order, "size", "sig").limit(train_docs).collect():
            if r["size"] <= kept[label]:
                kept[label] -= r["size"]
                keys.append((r["doc_id"], r["size"], r["sig"], label))
    if not keys:
        return train([], [], float(share))
    picked = docs.sparkSession.createDataFrame(keys, "doc_id long, size long, sig long, toxic int")
    texts = docs.select("doc_id", "text", size.alias("size"), F.xxhash64("text").alias("sig")).join(F.broadcast(picked), ["doc_id", "size", "sig"])
    found = texts.groupBy("doc_id", "toxic", "sig").agg(F.first("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], r["sig"]))
    return train([r["text"] for r in found], [r["toxic"] for r in found], float(share))


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score double and predicted int (1 from THRESHOLD on), from whole texts; other columns stay.

    Null or empty texts, and texts without a letter, score the share of toxic labels. Equal texts get
    equal scores, whatever lies beside them; a very long text is scored over all of its windows, in
    memory proportional to its length. An empty table stays empty; columns named score or predicted are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(model.value)

        def work(texts):
            # Many long texts at a time would need much memory at once; none depends on those beside it.
            which = np.cumsum([len(t or "") for t in texts]) // SCORED
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(texts)]
            scores = [s for a, b in zip(cuts[:-1], cuts[1:], strict=True) for s in scorer.scores(texts[a:b])]
            return scores, [int(s >= THRESHOLD) for s in scores]

        return work

    return map_texts(docs, make, "score double, predicted int")
