"""Station series in long form: (stn, time, value). NaN never enters; a missing value has no row or is null."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize


def reindex(obs: DataFrame, time: str = "d") -> DataFrame:
    """One row per station and day between the first and last day of the whole table; absent values are null."""
    span = obs.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))  # one row
    calendar = obs.select("stn").distinct().join(F.broadcast(span), how="cross").select("stn", F.explode(F.sequence("lo", "hi")).alias(time))
    return calendar.join(obs.select("stn", time, "value"), ["stn", time], "left")


def fill_with_mean(panel: DataFrame, digits: int = 2) -> DataFrame:
    """Null values become the station's mean, rounded."""
    mean = F.round(F.avg("value").over(Window.partitionBy("stn")), digits)
    return panel.withColumn("value", F.coalesce("value", mean))


def with_enough_values(obs: DataFrame, n: int) -> DataFrame:
    """Rows of stations that have at least n values."""
    return obs.withColumn("n_", F.count("value").over(Window.partitionBy("stn"))).where(F.col("n_") >= n).drop("n_")


def pairs_in_common(obs: DataFrame, time: str) -> DataFrame:
    """(a, b, time, va, vb) for stations a < b that both have a value."""
    left = obs.where("value is not null").select(F.col("stn").alias("a"), time, F.col("value").alias("va"))
    right = left.toDF("b", time, "vb")
    return left.join(right, time).where("a < b")


def average_rank(value: Column, *by: str) -> Column:
    """Rank with ties at their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def highest_rank(value: Column, *by: str) -> Column:
    """Rank with ties at the largest."""
    return F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))


def plotting_positions(obs: DataFrame) -> DataFrame:
    """obs with mean_rank, top_rank and p = mean_rank / (n + 1), by station."""
    ranked = obs.where("value is not null").withColumn("mean_rank", average_rank(F.col("value"), "stn")).withColumn("top_rank", highest_rank(F.col("value"), "stn"))
    return ranked.withColumn("p", F.col("mean_rank") / (F.count(F.lit(1)).over(Window.partitionBy("stn")) + 1))


def mixed_probabilities(obs: DataFrame, dry: float, damp: float) -> DataFrame:
    """obs with p for values that are partly discrete: dry up to `dry`, at a threshold up to `damp`, wet above.

    Dry values get half the dry share, threshold values the middle of theirs, wet ones their rank in the rest.
    """
    # Windows over stations and one order of their values, so that rows are shuffled once and sorted twice at most.
    all_ = Window.partitionBy("stn")
    order = all_.orderBy("value")
    v = F.col("value")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(all_)
    m, n = F.count(F.when(v > damp, 1)).over(all_), F.count(F.lit(1)).over(all_)
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    rows = obs.select("*", share(v <= dry).alias("p0_"), share(v <= damp).alias("p1_"), m.alias("m_"), n.alias("n_"), F.rank().over(order).alias("r_"), ties.alias("t_"))
    # Wet values are the last ones of the order: what stands before them isn't counted.
    rows = rows.withColumn("k_", F.col("r_") - (F.col("n_") - F.col("m_")) + (F.col("t_") - 1) / 2)
    p = F.when(v > damp, F.col("p1_") + (1 - F.col("p1_")) * F.col("k_") / (F.col("m_") + 1)).when(v <= dry, F.col("p0_") / 2).otherwise((F.col("p0_") + F.col("p1_")) / 2)
    return rows.select(*obs.columns, p.alias("p"))


def average_ranks(m: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each column, ties at their mean."""
    n = len(m)
    order = np.argsort(m, axis=0, kind="stable")
    ordered, place = np.take_along_axis(m, order, 0), np.arange(n)[:, None]
    new, last = np.ones(m.shape, bool), np.ones(m.shape, bool)
    new[1:] = last[:-1] = ordered[1:] != ordered[:-1]
    if new.all():
        out = np.empty(m.shape)
        np.put_along_axis(out, order, place + 1.0, 0)
        return out
    low = np.maximum.accumulate(np.where(new, place, 0), 0)
    high = np.minimum.accumulate(np.where(last, place, n)[::-1], 0)[::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (low + high) / 2 + 1, 0)
    return out


#: Fewest stations of a block, most blocks of a table whose blocks fit, and numbers that a block holds at most; a task holds two blocks.
BLOCK, BLOCKS, HELD = 128, 32, 8_000_000
#: Pairs that are worked on at a time, numbers of an array of them with their steps, and the most steps for which ranks are counted.
PAIRS, NUMBERS, STEPS = 1 << 18, 1 << 22, 128


def _moments(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations and numbers of common values of the columns of x with those of y; masks say where there are any."""
    n = mx.T @ my
    with np.errstate(all="ignore"):
        sx, sy = x.T @ my / n, mx.T @ y / n
        cov, vx, vy = x.T @ y / n - sx * sy, (x * x).T @ my / n - sx**2, mx.T @ (y * y) / n - sy**2
        flat = (vx <= 1e-13 * (1 + sx**2)) | (vy <= 1e-13 * (1 + sy**2)) | (n < 2)
        rho = np.where(flat, np.nan, cov / np.sqrt(vx * vy))
    return rho, n


def _compared(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(step, other, column): one where a step's value is above another's, a half where they are equal; none where either is missing."""
    some = m[:, None] * m[None]
    return ((x[:, None] > x[None]) + np.float32(0.5) * (x[:, None] == x[None])) * some


def _counted_moments(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank correlations of columns whose masks differ: a rank is a count of smaller values at the pair's common steps. Halves
    and their products are exact in single precision for up to STEPS steps."""
    t, rho, n = len(x), np.full((x.shape[1], y.shape[1]), np.nan), (mx.T @ my)
    mx, my = mx.astype(np.float32), my.astype(np.float32)
    wide = max(1, NUMBERS // (t * t))
    for low in range(0, y.shape[1], wide):
        b = slice(low, low + wide)
        cy, many = np.ascontiguousarray(_compared(y[:, b], my[:, b]).transpose(1, 0, 2)), my[:, b].shape[1]
        tall = max(1, NUMBERS // (t * max(many, t)))
        for first in range(0, x.shape[1], tall):
            a = slice(first, first + tall)
            common = mx[:, a].T[:, :, None] * my[None, :, b]
            middle = (n[a, b].astype(np.float32) / 2)[:, None, :]
            rx = (np.matmul(_compared(x[:, a], mx[:, a]).transpose(2, 0, 1), my[:, b]) - middle) * common
            ry = ((mx[:, a].T @ cy.reshape(t, -1)).reshape(-1, t, many) - middle) * common
            cov, vx, vy = (np.einsum("atb,atb->ab", p, q).astype(float) for p, q in ((rx, ry), (rx, rx), (ry, ry)))
            with np.errstate(all="ignore"):
                rho[a, b] = np.where((vx > 0) & (vy > 0), cov / np.sqrt(vx * vy), np.nan)
    return rho, n


def _kinds(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of masks, and which of them each column is."""
    rows = np.ascontiguousarray(np.packbits(m.T > 0, axis=1))
    _, first, which = np.unique(rows.view([("", np.void, rows.shape[1])]).ravel() if rows.shape[1] else np.zeros(len(rows)), return_index=True, return_inverse=True)
    return m[:, first], which.ravel()


#: What two kinds of masks cost, in pairs that are counted, at a step.
KINDS = 10_000


def _ranked_moments(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, kinds: tuple | None = None, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As _moments, of ranks within each pair's common values: columns with equal masks are ranked together, and where few are equal, ranks are
    counted. kinds: those of the columns of y, if they are known; known: the last ranks of each of them, kept from call to call with the same y."""
    (left, which), (right, other) = _kinds(mx), kinds or _kinds(my)
    if len(x) <= STEPS and KINDS * left.shape[1] * right.shape[1] > len(x) * x.shape[1] * y.shape[1]:
        return _counted_moments(x, y, mx, my)
    rho, n = np.full((x.shape[1], y.shape[1]), np.nan), np.zeros((x.shape[1], y.shape[1]))
    sides = [[np.flatnonzero(w == i) for i in range(k.shape[1])] for k, w in ((left, which), (right, other))]
    # Sums of products of halves are exact, in single precision for up to STEPS steps.
    exact, known = np.float32 if len(x) <= STEPS else float, {} if known is None else known

    def ranks(v, common, many):
        r = (average_ranks(v[common]) - (many + 1) / 2).astype(exact)
        return r, (r * r).sum(0, dtype=float) / many

    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            common = (left[:, i] * right[:, j]) > 0
            many = int(common.sum())
            at = np.ix_(a, b)
            n[at] = many
            if many < 2:
                continue
            steps = common.tobytes()
            if known.get(j, (None,))[0] != steps:
                known[j] = steps, ranks(y[:, b], common, many)
            (rx, vx), (ry, vy) = ranks(x[:, a], common, many), known[j][1]
            cov = (rx.T @ ry).astype(float) / many
            with np.errstate(all="ignore"):
                rho[at] = np.where((vx > 0)[:, None] & (vy > 0), cov / np.sqrt(vx[:, None] * vy), np.nan)
    return rho, n


def _blocks_met(obs: DataFrame, time: str, block: int) -> DataFrame:
    """(i_, j_, an, at, am, bn, bt, bm): places of two blocks of stations, with the names, steps and values (steps by stations, NaN for none) of both.

    Stations with values at the same steps are dealt to the same block, as far as they fit, since they are ranked together. A
    block is sent once for each block, and there are at most BLOCKS, unless their values wouldn't fit: what is shuffled grows with the rows.
    """
    known = obs.where("value is not null").select("stn", time, F.col("value").cast("double").alias("value"))
    masks = known.groupBy("stn").agg(F.count(F.lit(1)).alias("n_"), F.bit_xor(F.xxhash64(time)).alias("s_"))
    size = known.agg(F.count_distinct("stn").alias("stations"), F.count_distinct(time).alias("steps")).first()
    wide = max(block, min(-(-size["stations"] // BLOCKS), HELD // max(1, size["steps"])))
    last = max(1, -(-size["stations"] // wide)) - 1
    dealt = materialize(masks.repartitionByRange(last + 1, "n_", "s_", "stn").select("stn", F.spark_partition_id().alias("k_")), "dealt")
    kinds = dict(known.dtypes)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at, steps = pd.factorize(frame[time], sort=True)
        place, names = pd.factorize(frame["stn"], sort=True)
        x = np.full((len(steps), len(names)), np.nan)
        x[at, place] = frame["value"].to_numpy()
        return pd.DataFrame({"k_": [key[0]], "n": [list(names)], "t": [list(steps)], "m": [x.tobytes()]})

    packed = materialize(known.join(dealt, "stn").groupBy("k_").applyInPandas(pack, f"k_ int, n array<{kinds['stn']}>, t array<{kinds[time]}>, m binary"), "blocks")
    left = packed.select(F.col("k_").alias("i_"), *(F.col(c).alias(f"a{c}") for c in "ntm")).withColumn("j_", F.explode(F.sequence(F.col("i_"), F.lit(last))))
    right = packed.select(F.col("k_").alias("j_"), *(F.col(c).alias(f"b{c}") for c in "ntm")).withColumn("i_", F.explode(F.sequence(F.lit(0), F.col("j_"))))
    n, keys = (last + 1) * (last + 2) // 2, ["i_", "j_"]
    met = left.repartition(n, *keys).join(right.repartition(n, *keys).hint("shuffle_hash"), keys)
    return met.select(*keys, *(f"{s}{c}" for s in "ab" for c in "ntm"))


def _slices(batch: pa.RecordBatch, row: int, moments):
    """Of a place of two blocks: (own, names, names, at, rho, n), own: both are one block; for some of the first block's stations at a time, those at places
    at. For ranks, stations with values at the same steps come together."""
    names, steps, sides = [], [], []
    for c in (2, 5):
        names.append(batch.column(c)[row].values)
        steps.append(batch.column(c + 1)[row].values.to_numpy(zero_copy_only=False))
        x = np.frombuffer(batch.column(c + 2)[row].as_buffer()).reshape(len(steps[-1]), len(names[-1]))
        mask = ~np.isnan(x)
        # Correlations don't depend on the centre, their rounding does; ranks are of the values as they are.
        sides.append((np.where(mask, x - np.nanmean(x, 0) if moments is _moments else x, 0.0), mask.astype(float)))
    _, i, j = np.intersect1d(*steps, assume_unique=True, return_indices=True)
    (x, mx), (y, my) = [(v[at], m[at]) for (v, m), at in zip(sides, (i, j), strict=True)]
    own = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
    tall, order, more = max(1, PAIRS // max(1, y.shape[1])), np.arange(x.shape[1]), ()
    if moments is _ranked_moments:
        order, more = np.argsort(_kinds(mx)[1], kind="stable"), (_kinds(my), {})
    for low in range(0, x.shape[1] if len(i) else 0, tall):
        at = order[low : low + tall]
        yield own, *names, at, *moments(x[:, at], y, mx[:, at], my, *more)


def _block_pairs(obs: DataFrame, time: str, moments, block: int) -> DataFrame:
    """(a, b, rho, n) for stations a < b with common steps: a place of two blocks is a task's work, a product of two masked matrices."""
    kind = dict(obs.dtypes)["stn"]

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                for own, an, bn, at, rho, n in _slices(batch, row, moments):
                    keep = n > 0
                    if own:
                        keep &= np.arange(n.shape[1]) > at[:, None]
                    i, j = np.nonzero(keep)
                    left, right = (names.take(pa.array(k)).to_numpy(zero_copy_only=False) for names, k in ((an, at[i]), (bn, j)))
                    turn = left > right
                    value = rho[i, j]
                    columns = [pa.array(np.where(turn, right, left), an.type), pa.array(np.where(turn, left, right), an.type), pa.array(value, mask=np.isnan(value)), pa.array(n[i, j].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "rho", "n"])

    return _blocks_met(obs, time, block).mapInArrow(work, f"a {kind}, b {kind}, rho double, n long")


def correlations(obs: DataFrame, time: str, block: int = BLOCK) -> DataFrame:
    """(a, b, rho, n) for stations a < b over common steps; rho is null where either doesn't vary there."""
    return _block_pairs(obs, time, _moments, block)


def rank_correlations(obs: DataFrame, time: str, block: int = BLOCK) -> DataFrame:
    """As correlations, of mean ranks within each pair's common steps."""
    return _block_pairs(obs, time, _ranked_moments, block)


def correlated_neighbours(obs: DataFrame, time: str, most: int, least_rho: float, more_than: int, block: int = BLOCK) -> DataFrame:
    """Each station's `most` best neighbours by absolute rank correlation (to nine digits, then by id), those of at least least_rho over more
    than more_than steps. Of each place of two blocks only the best of either's stations come out."""
    kind = dict(obs.dtypes)["stn"]
    none = (1 << 31) - 1

    def best(rank, rho, n, axis):
        if rank.shape[axis] > most:
            at = np.argpartition(rank, rank.shape[axis] - most, axis)
            at = at[:, -most:] if axis else at[-most:]
            rank, rho, n = (np.take_along_axis(v, at, axis) for v in (rank, rho, n))
        return rank, rho, n

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                others = None
                for own, an, bn, at, rho, n in _slices(batch, row, _ranked_moments):
                    with np.errstate(invalid="ignore"):
                        good = (n > more_than) & (np.abs(rho) >= least_rho)
                    here, there = at[:, None], np.arange(n.shape[1])
                    if own:
                        good &= here != there
                    # One number for the order: nine digits of the correlation, then the place of the name in its block, smaller ones first.
                    digits = np.floor(np.abs(np.where(good, rho, 0.0)) * 1e9 + 0.5).astype(np.int64) << 31
                    rank, value, count = best(np.where(good, digits + (none - there), -1), rho, n, 1)
                    i, j = np.nonzero(rank >= 0)
                    yield rows(an, at[i], bn, none - (rank[i, j] & none), rank[i, j], value[i, j], count[i, j])
                    if not own:
                        fresh = (np.where(good, digits + (none - here), -1), rho, n)
                        others = best(*(fresh if others is None else (np.concatenate(p) for p in zip(others, fresh, strict=True))), 0)
                if others is not None:
                    i, j = np.nonzero(others[0] >= 0)
                    rank, value, count = (v[i, j] for v in others)
                    yield rows(bn, j, an, none - (rank & none), rank, value, count)

    def rows(names, i, others, j, rank, rho, n):
        columns = [names.take(pa.array(i)), others.take(pa.array(j)), pa.array(rho), pa.array(n.astype(np.int64)), pa.array(rank >> 31)]
        return pa.RecordBatch.from_arrays(columns, ["stn", "neighbour", "rho", "n", "digits_"])

    both = _blocks_met(obs, time, block).mapInArrow(work, f"stn {kind}, neighbour {kind}, rho double, n long, digits_ long")
    place = F.row_number().over(Window.partitionBy("stn").orderBy(F.desc("digits_"), "neighbour"))
    return both.withColumn("place", place).where(F.col("place") <= most).drop("digits_")


def valid_neighbours(obs: DataFrame, near: DataFrame, time: str, most: int, more_than: int, gaps: bool = False, first=None, last=None) -> DataFrame:
    """(stn, neighbour, place, n): of the neighbours (stn, neighbour, place) those with values at more than more_than steps at which the
    station has one too, the `most` first of them in their order; n: those steps. gaps: only neighbours that have a
    value at some step at which the station has none count. first, last: only those with a common step from first to last."""
    known = obs.where("value is not null").select("stn", time)
    met = near.select("stn", "neighbour", F.col("place").alias("p_")).join(known.select(F.col("stn").alias("neighbour"), time), "neighbour")
    both = met.join(known.withColumn("own_", F.lit(1)), ["stn", time], "left")
    inside = F.col("own_").isNotNull()
    for edge in ((F.col(time) >= F.lit(first)) if first is not None else None, (F.col(time) <= F.lit(last)) if last is not None else None):
        inside = inside if edge is None else inside & edge
    counts = both.groupBy("stn", "neighbour", "p_").agg(F.count("own_").alias("n"), F.count_if(F.col("own_").isNull()).alias("free_"), F.count_if(inside).alias("in_"))
    kept = counts.where((F.col("n") > more_than) & (F.col("in_") > 0) & ((F.col("free_") > 0) if gaps else F.lit(True)))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("stn").orderBy("p_", "neighbour"))).where(F.col("place") <= most).select("stn", "neighbour", "place", "n")


def mean_values(rows: DataFrame, *by: str, digits: int = 2) -> DataFrame:
    """(by, value): means of the values that there are, rounded; null where there is none."""
    return rows.groupBy(*by).agg(F.round(F.avg("value"), digits).alias("value"))
