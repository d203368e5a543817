"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, and only histograms leave a task:
first by the power of two of the score, then in up to 1,024 bins over the bin that holds the kth
score, until a bin is one integer wide. A last pass emits the rows above the kth score and, of
those equal to it, as many of the smallest ids as are still wanted, so ties of any number cost a
task no more than k rows a query. A task sends the bins from its best score down to its own kth
only: lower bins cannot hold the global kth.

Queries are handled in blocks of about ``block`` rows, each broadcast (block x dimension
integers); candidates are never collected, shuffled or replicated.

Defined results: a vector that is null, or holds a null or a non-finite component, and a row
without an id take no part; vectors of another dimension than the query's are no candidates for
it; rows with the query's own id are its own; a query id that occurs more than once is searched
once, for its least vector; repeated candidate rows count as often as they occur; fewer
candidates than k give fewer rows. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OWN = np.iinfo(np.int64).min
BINS = 1024
_POWERS = np.array([1 << i for i in range(63)], np.int64)


def quantised(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and integer vectors of the rows that take part, by dimension."""
    vectors = batch.column("embedding")
    batch = batch.filter(pc.and_(vectors.is_valid(), batch.column("vec_id").is_valid()))
    if not batch.num_rows:
        return {}
    vectors, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    out = {}
    for dim in np.unique(size):
        if dim == 0:
            continue
        rows = np.flatnonzero(size == dim)
        x = values[begin[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1)
        out[int(dim)] = ids[rows[ok]], np.floor(scale * x[ok])
    return out


def products(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where they are exact there, else in 64-bit integers."""
    if not len(candidates):
        return np.zeros((0, len(queries)), np.int64)
    bound = np.abs(candidates).max() * np.abs(queries).max() * candidates.shape[1]
    if bound < 2**53:
        return (candidates @ queries.T).astype(np.int64)
    return candidates.astype(np.int64) @ queries.astype(np.int64).T


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidate ids, scores by query) of blocks of candidates; a query's own row scores OWN. ids are sorted."""
    step = max(16, (1 << 20) // len(ids))
    for b in batches:
        own_ids, x = quantised(b, scale).get(queries.shape[1], (np.zeros(0, np.int64), None))
        for at in range(0, len(own_ids), step):
            c = own_ids[at : at + step]
            s = products(x[at : at + step], queries)
            where = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
            own = ids[where] == c
            s[own, where[own]] = OWN
            yield c, s


def _power_bin(s: np.ndarray) -> np.ndarray:
    """63 + the bit length of a score with its sign: it orders scores."""
    size = np.searchsorted(_POWERS, np.abs(s), "right")
    return 64 + np.where(s < 0, -size, size)


def _window_of(power: int) -> tuple[int, int]:
    size = power - 64
    if size == 0:
        return 0, 1
    low, high = 1 << (abs(size) - 1), 1 << abs(size)
    return (low, high) if size > 0 else (-high + 1, -low + 1)


def _counter(ids, queries, scale, low, high, width, bins, want):
    """A task's histogram of each query, from the top down to its own kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), bins), np.int64)
        base = np.arange(len(ids)) * bins
        for _, s in _scores(batches, ids, queries, scale):
            ok = s != OWN
            if low is None:
                at = _power_bin(s)
            else:
                at = (s - low) // width
                ok &= (s >= low) & (s < high)
            total += np.bincount((at + base)[ok], minlength=total.size).reshape(total.shape)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < want[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], names=["q", "bin", "n"])

    return run


def _taker(ids, queries, scale, kth, ties):
    """Rows above the kth score and, of those equal to it, the smallest ids that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_q, kept_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for c, s in _scores(batches, ids, queries, scale):
            row, q = np.nonzero((s > kth) & (s != OWN))
            yield _rows(ids[q], c[row], s[row, q])
            row, q = np.nonzero((s == kth) & (s != OWN))
            if len(q):
                q, v = np.concatenate([kept_q, q]), np.concatenate([kept_c, c[row]])
                order = np.lexsort((v, q))
                q, v = q[order], v[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                kept_q, kept_c = q[place < ties[q]], v[place < ties[q]]
        yield _rows(ids[kept_q], kept_c, kth[kept_q])

    return run


def _rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


def _search(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: float) -> DataFrame:
    order = np.argsort(ids)
    ids, queries = ids[order], queries[order]
    n = len(ids)
    want = np.full(n, k, np.int64)  # of the rows still unplaced, the one looked for
    kth = np.full(n, OWN + 1, np.int64)  # fewer than k candidates: all of them
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    open_ = np.ones(n, bool)
    while open_.any():
        if low is None:
            width, bins = np.ones(n, np.int64), 129
        else:
            bins = BINS
            width = np.array([max(1, -(-(int(b) - int(a)) // BINS)) for a, b in zip(low, high, strict=True)], np.int64)
        at = np.flatnonzero(open_)
        found = vectors.mapInArrow(_counter(ids[at], queries[at], scale, None if low is None else low[at], None if high is None else high[at], width[at], bins, want[at]), "q int, bin int, n long")
        found = found.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        found = found.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        found = found.withColumn("above", F.col("upto") - F.col("n"))
        held: dict[int, list] = {}
        for r in found.where(F.col("above") < k).toLocalIterator():  # at most k rows a query of the block
            held.setdefault(r.q, []).append((r.bin, r.above, r.upto))
        new_low, new_high = (np.zeros(n, np.int64), np.ones(n, np.int64)) if low is None else (low.copy(), high.copy())
        for j, i in enumerate(at):
            hit = next(((b, above) for b, above, upto in sorted(held.get(j, []), reverse=True) if upto >= want[i]), None)
            if hit is None:  # fewer candidates than wanted
                open_[i] = False
                continue
            b, above = hit
            want[i] -= above
            if low is None:
                lo, hi = _window_of(b)
            else:
                lo = int(low[i]) + b * int(width[i])
                hi = min(lo + int(width[i]), int(high[i]))
            new_low[i], new_high[i] = lo, min(hi, 2**63 - 1)
            if hi - lo == 1:
                kth[i], open_[i] = lo, False
        low, high = new_low, new_high
    return vectors.mapInArrow(_taker(ids, queries, scale, kth, want), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (vectors, queries))
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        for dim, (ids, x) in quantised(pa.RecordBatch.from_struct_array(pa.Table.to_struct_array(own.toArrow()).combine_chunks()), scale).items() if own.take(1) else ():
            order = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[order], x[order]
            once = np.r_[True, ids[1:] != ids[:-1]]
            if len(ids):
                parts.append(_search(vectors.where(F.size("embedding") == dim), ids[once], x[once], k, scale))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
