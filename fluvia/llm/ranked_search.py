"""Ranked lexical search over a tiered index.

Documents are dealt into shards as they are read, without a shuffle. A shard's postings stand in tiers by
impact, high ones first, in a table partitioned by tier; each row of a term in a tier also says how much any
of the term's lower postings in the shard can still have: the residual bound. A search reads the first tier
alone and gets, for each item, a lower and an upper bound on the score of each document. An item's answer
is proven when no other document in any shard, seen or not, can reach its last place; it is then scored
exactly from the postings of its few candidates. Items without proof fall through to the next tier; the last
has no residuals and settles all.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.llm.common import map_texts, slices
from fluvia.session import materialize, scratch_dir, ship

#: Least impacts of the tiers but the last, of at most 10**6.
TIERS = (600_000, 400_000)
#: A shard ends after so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 4096, 64 << 20
#: Items that are scored together in a shard; documents that a shard shows for an item, at least the answer's.
ITEM_BLOCK, SHOWN = 256, 20

#: Bytes of UTF-8: letters, digits and all that isn't ASCII stay, A-Z in lower case; the others part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased; null has none."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Index:
    """documents N, terms L with repeats, and the tables: postings (tier, shard, term, docs, impacts, rest; df in the shard) and shards (shard, doc_ids)."""

    documents: int
    terms: int
    postings: DataFrame
    shards: DataFrame


def _counts(docs: DataFrame) -> tuple[int, int]:
    """N and L over whole texts."""

    def count(batches):
        n = total = 0
        for batch in batches:
            for part in slices(iter([batch])):
                sizes = [len(terms_of(t)) for t in part.column(0).cast(pa.binary()).to_pylist()]
                n, total = n + sum(s > 0 for s in sizes), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


class _Shard:
    """Term counts of a shard's documents while it is filled."""

    def __init__(self):
        self.ids, self.lengths, self.bytes = [], [], 0
        self.known: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []

    def add(self, doc_id, text: bytes | None) -> None:
        counts = Counter(terms_of(text))
        known = self.known
        self.term.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.doc.append(np.full(len(counts), len(self.ids), np.int32))
        self.lengths.append(int(self.tf[-1].sum()))
        self.ids.append(doc_id)
        self.bytes += len(text or b"")

    def rows(self, shard: int, n: int, total: int):
        """Index rows: the shard's doc_ids (tier -1), and its postings by tier, term and falling impact."""
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard]), pa.array([b""], pa.binary()), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([self.ids], pa.list_(pa.int64()))], _COLUMNS)
        term, doc, tf = (np.concatenate(x) for x in (self.term, self.doc, self.tf))
        if not len(term):
            return
        m = 25 + np.array([(75 * size * n) // total for size in self.lengths], np.int64)
        impact = (10**9 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order].astype(np.int32), impact[order].astype(np.int32)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        end = np.r_[first[1:], len(term)]
        names = pa.array(list(self.known), pa.binary())
        rest_of = np.append(impact, 0)
        at = first
        for tier, least in enumerate((*TIERS, 0)):
            # Of each term, the postings from `at` that reach the tier; lower ones begin at `below`.
            below = first + np.add.reduceat((impact >= least).astype(np.int64), first)
            has = at < end
            a, b = at[has], below[has]
            rest = np.where(b < end[has], rest_of[b], 0)
            take = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            bounds = np.r_[0, np.cumsum(b - a)]
            none = pa.nulls(len(a), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), tier, np.int32)), pa.array(np.full(len(a), shard)), names.take(pa.array(term[a])), _lists(doc[take], bounds, pa.int32()), _lists(impact[take], bounds, pa.int32()), pa.array(rest.astype(np.int32)), pa.array((end - first)[has].astype(np.int32)), none], _COLUMNS)
            at = below


_COLUMNS = ["tier", "shard", "term", "docs", "impacts", "rest", "df", "doc_ids"]
_INDEX = "tier int, shard long, term binary, docs array<int>, impacts array<int>, rest int, df int, doc_ids array<long>"


def build_index(docs: DataFrame) -> Index:
    """The tiered index of all rows and whole texts of docs (doc_id long, text); other columns are left out.

    Null texts have no term. Every row is a document of its own, repeated and null doc_ids too.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, total = _counts(docs)

    def run(batches):
        task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for part in slices(iter([batch])):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    shard.add(i, t)
                    if len(shard.ids) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                        yield from shard.rows((task << 32) + made, n, total)
                        made, shard = made + 1, _Shard()
        if shard.ids:
            yield from shard.rows((task << 32) + made, n, total)

    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    docs.mapInArrow(run, _INDEX).write.partitionBy("tier").parquet(path)
    postings, shards = (spark.read.schema(_INDEX).parquet(path) for _ in range(2))
    return Index(n, total, postings.where("tier >= 0").drop("doc_ids"), shards.where("tier = -1").select("shard", "doc_ids"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): items with one item_id, null too, count as one; those without a term have no row."""

    def make():
        def work(texts):
            return [[[{"term": t, "times": c} for t, c in Counter(terms_of(None if x is None else x.encode())).items()] for x in texts]]

        return work

    rows = map_texts(items.select("item_id", F.col("text").cast("string").alias("text")), make, "found array<struct<term:binary,times:long>>", drop=("text",))
    return rows.select("item_id", F.explode("found").alias("x")).groupBy("item_id", "x.term").agg(F.sum("x.times").alias("times"))


_SHOWN = "item long, shard long, doc int, doc_id long, low long, high long"


def _score(tier: int, shown: int, by_doc: bool):
    """Work of a group (shard, item block): for each item the documents shown, with bounds on their scores, and one
    row without a document that says how much any other of the shard can have."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            left, doc_ids = left.combine_chunks(), right.combine_chunks().column("doc_ids").chunk(0)[0].values
            size, shard = len(doc_ids), right.column("shard")[0].as_py()
            chunk = lambda name: left.column(name).chunk(0)
            term = chunk("term").dictionary_encode().indices.to_numpy()
            tiers, rests = chunk("tier").to_numpy(), chunk("rest").to_numpy()
            docs, impacts, users = chunk("docs"), chunk("impacts"), chunk("users")
            spans, doc, impact = (np.r_[0, np.cumsum(docs.value_lengths().to_numpy())], docs.flatten().to_numpy(), impacts.flatten().to_numpy().astype(np.int64))
            user_spans, flat = np.r_[0, np.cumsum(users.value_lengths().to_numpy())], users.flatten()
            names, user = np.unique(flat.field("item").to_numpy(), return_inverse=True)
            weight = flat.field("w").to_numpy()
            low, residual, missing = np.zeros((len(names), size), np.int64), np.zeros(len(names), np.int64), np.zeros((len(names), size), np.int64)
            rest_of = np.zeros(term.max() + 1, np.int64)
            rest_of[term[tiers == tier]] = rests[tiers == tier]
            for i in range(len(term)):
                u, w = user[user_spans[i] : user_spans[i + 1]], weight[user_spans[i] : user_spans[i + 1]]
                at, rest = doc[spans[i] : spans[i + 1]], rest_of[term[i]]
                if len(at):
                    low[np.ix_(u, at)] += w[:, None] * impact[spans[i] : spans[i + 1]]
                if rest and len(at):
                    missing[np.ix_(u, at)] += (w * rest)[:, None]
                if rest and tiers[i] == tier:
                    residual[u] += w * rest
            high = low + residual[:, None] - missing
            ids = doc_ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, doc_ids.is_null().to_numpy(zero_copy_only=False))) if by_doc else np.arange(size)
            for j, item in enumerate(names):
                worth = high[j, order]
                n = min(shown, size)
                # The best, ties to the smaller doc_id: all above the n-th value, then the first that equal it.
                nth = np.partition(worth, size - n)[size - n]
                best = np.r_[np.flatnonzero(worth > nth), np.flatnonzero(worth == nth)][:n]
                rest_high = np.delete(worth, best).max(initial=0)
                best = order[best[worth[best] > 0]]
                for column, values in zip(out, (np.full(len(best) + 1, item), np.r_[best, -1], np.r_[low[j, best], 0], np.r_[high[j, best], rest_high]), strict=False):
                    column.append(values)
        if not out[0]:
            return pa.table({n: pa.array([], t) for n, t in _SHOWN_TYPES.items()})
        item, at, low_, high_ = (np.concatenate(x) for x in out[:4])
        there = pa.array(at, pa.int32(), mask=at < 0)
        return pa.table([pa.array(item), pa.array(np.full(len(item), shard)), there, doc_ids.take(there), pa.array(low_), pa.array(high_)], list(_SHOWN_TYPES))

    return work


_SHOWN_TYPES = {"item": pa.int64(), "shard": pa.int64(), "doc": pa.int32(), "doc_id": pa.int64(), "low": pa.int64(), "high": pa.int64()}


def _shown(index: Index, weights: DataFrame, blocks: int, tier: int, shown: int, by_doc: bool) -> DataFrame:
    """What the shards show of the items in weights (item, term, w) by the tiers up to this one."""
    users = weights.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "w")).alias("users"))
    postings = index.postings.where(F.col("tier") <= tier).join(users, "term").select("shard", "block", "tier", "term", "docs", "impacts", "rest", "users")
    # A shard goes to every block of items: the stated queries meet all rows in blocks.
    shards = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", F.col("block").cast("long").alias("block"), "doc_ids")
    both = postings.groupBy("shard", "block").cogroup(shards.groupBy("shard", "block"))
    return materialize(both.applyInArrow(_score(tier, shown, by_doc), _SHOWN), "shown")


def _top(scored: DataFrame, k: int, tier: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc_id", "score", F.lit(tier).alias("tier"))


def _exact(index: Index, weights: DataFrame, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, doc_id, score) of candidates (item, shard, doc, doc_id), from the postings of all tiers; terms: those of weights."""
    there = candidates.groupBy("item", "shard").agg(F.collect_list(F.struct("doc", "doc_id")).alias("wanted"))
    asked = there.join(weights, "item").select("item", "shard", "term", "w", "wanted")
    # Few of the index's terms are asked for: the others go before postings are shuffled.
    postings = index.postings.select("shard", "term", "docs", "impacts").join(terms, "term", "left_semi")
    met = asked.join(postings, ["shard", "term"])
    each = met.select("item", "shard", "w", F.explode("wanted").alias("x"), "docs", "impacts")
    impact = F.coalesce(F.try_element_at("impacts", F.nullif(F.array_position("docs", F.col("x.doc")), F.lit(0)).cast("int")), F.lit(0))
    return each.groupBy("item", "shard", F.col("x.doc").alias("doc"), F.col("x.doc_id").alias("doc_id")).agg(F.sum(F.col("w") * impact).alias("score")).select("item", "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score and tier (from 0: the tier that proved the item) of each item's k best documents.

    A document's score is the sum over the item's terms, repeats included, of w * impact, in 64-bit integers: w is
    floor(1000 * ln((2N + 2) / (2 df + 1))), impact (10**9 tf) div (1000 tf + 8m), m = 25 + (75 n N) div L. Documents
    without a positive score aren't listed; equal scores go by doc_id, nulls last. Items without a term, and
    empty tables, give no rows; rows that share an item_id, null too, are one item.
    """
    asked = materialize(item_terms(items), "item-terms")
    names = materialize(asked.select("item_id").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id"), "items")
    terms = materialize(asked.select("term").distinct(), "terms")
    df = index.postings.where("tier = 0").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    numbered = asked.join(names, asked["item_id"].eqNullSafe(names["item_id"])).select("item", "term", "times")
    weights = materialize(numbered.join(df, "term").select("item", "term", (F.col("times") * weight).cast("long").alias("w")).where("w > 0"), "item-weights")
    blocks = max(1, -(-names.count() // ITEM_BLOCK))
    pending, found, last = weights, [], len(TIERS)
    for tier in range(last):
        shown = _shown(index, pending, blocks, tier, max(SHOWN, k), False)
        ranked = shown.where("doc is not null").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("r") <= k)
        floor = ranked.where(F.col("r") == k).select("item", F.col("low").alias("floor"))
        # Proven: nobody who isn't shown can reach the k-th lower bound, wherever it is.
        others = shown.where("doc is null").groupBy("item").agg(F.max("high").alias("others"))
        proven = materialize(floor.join(others, "item").where("others < floor").select("item", "floor"), "proven")
        candidates = shown.where("doc is not null").join(proven, "item").where("high >= floor").select("item", "shard", "doc", "doc_id")
        found.append(_top(_exact(index, weights, candidates, terms), k, tier))
        pending = materialize(pending.join(proven, "item", "left_anti"), "pending")
        if not pending.limit(1).count():
            break
    else:
        shown = _shown(index, pending, blocks, last, k, True).where("doc is not null")
        found.append(_top(shown.select("item", "doc_id", F.col("low").alias("score")), k, last))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score", "tier")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), s AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), p AS (
  SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(terms) AS term, len(terms) AS size FROM d) GROUP BY doc_id, term
), f AS (
  SELECT term, count(*) AS df FROM p GROUP BY term
), x AS (
  SELECT q.item_id, p.doc_id,
         sum(q.times * CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * f.df + 1 AS DOUBLE))) AS BIGINT)
             * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.size * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN p ON q.term = p.term JOIN f ON f.term = q.term CROSS JOIN s GROUP BY q.item_id, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""
