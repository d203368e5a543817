"""Importance resampling towards a target distribution of hashed n-grams, over a persisted sparse count matrix.

The matrix has a row for each document and a column for each bucket (crc32 of an n-gram modulo ``buckets``). It is written
once, as CSR blocks of about ``BLOCK`` bytes of text: row pointers, column indices and counts of some hundred documents,
with their ids, hashes and sizes. Texts are read once, to make it. Its column sums, and those of the target's matrix, are the
two distributions; a bucket's gain is the logarithm of their ratio in thousandths; the product of the matrix with the gains
gives every document's weight. Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

At most ``buckets`` numbers leave a task or reach the driver, whatever the corpus holds. The draw deals (score, doc_id) out
by range; a row's rank is its place in its range and the size of the ranges before it, so no task sees all rows.

Defined results: a null text has no words; a document without words has weight 0; ``n_words`` counts words, ``n_features``
n-grams of all lengths; a null doc_id is hashed as an empty text and comes first among equal scores; rows that share a doc_id
are scored and drawn one by one, equal ones in any order; other columns are not read; an empty target or corpus counts as
zeros in its sums; an empty corpus gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.scratch import dropped, written
from chartspark.llm.words import raw, slices

#: Bytes of text of a block of the matrix, about.
BLOCK = 4 << 20
#: Longer n-grams are hashed one by one.
LONG = 64
POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``, byte by byte over all spans at once."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    longest = int(np.searchsorted(-size[order], -LONG, "left"))
    for i in order[:longest]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
    order = order[longest:]
    at, left, crc = starts[order], size[order], out[order]
    for j in range(int(left[0]) if len(order) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # spans with more than j bytes come first
        crc[:n] = table[(crc[:n] ^ data[at[:n] + j]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


class Counter:
    """CSR blocks of text columns: n-grams of 1 to ``n`` words, lower-cased in A-Z, joined by one space."""

    def __init__(self, n: int, buckets: int) -> None:
        self.n, self.buckets, self.table = n, buckets, crc_table()
        byte = np.arange(256)
        self.word = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
        self.folded = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words' bytes, each followed by one space; their starts and ends there; and the row offsets of the words."""
        data, offsets = raw(column)
        base, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        inside = self.word[base]
        begins, ends = inside.copy(), inside.copy()
        first = np.zeros(len(base) + 1, bool)
        first[at] = True
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = ends - begins
        starts = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = self.folded[base[inside]]
        return joined, starts, starts + size, np.searchsorted(begins, at)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each row, row pointers, buckets, counts)."""
        joined, starts, ends, offsets = self.words(column)
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        cells = []
        for n in range(1, self.n + 1):
            if len(row) < n:
                break
            same = row[: len(row) - n + 1] == row[n - 1 :]
            h = crc32(joined, starts[: len(row) - n + 1][same], ends[n - 1 :][same], self.table)
            cells.append(row[: len(row) - n + 1][same] * self.buckets + h % np.uint32(self.buckets))
        cell, count = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return np.diff(offsets), np.searchsorted(cell, np.arange(rows + 1) * self.buckets), cell % self.buckets, count


CSR = "pointers binary, buckets binary, counts binary, n_words binary"


def count_matrix(documents: DataFrame, key: str | None, n: int, buckets: int) -> DataFrame:
    """CSR blocks of ``documents``: ``ids`` (the values of ``key``, if any) and CSR arrays in little-endian bytes."""
    ids = documents.select(key).schema[0].dataType.simpleString() if key else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(n, buckets)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                n_words, pointers, bucket, count = counter(part.column("text"))
                own = part.column("key")
                lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                arrays = (pointers.astype("<i8"), bucket.astype("<i4"), count.astype("<i4"), n_words.astype("<i8"))
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["ids", "pointers", "buckets", "counts", "n_words"])

    rows = documents.select((F.col(key) if key else F.lit(None).cast("int")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"ids array<{ids}>, {CSR}")


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket: summed up in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                total += np.bincount(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<i4"), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed distributions, rounded down."""
    k = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + k) / ((source + 1.0) * (float(target.sum()) + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """``key, n_words, n_features, weight``: the product of the matrix with the gains, block by block."""
    ids = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pointers, bucket, count, n_words = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("pointers", "<i8"), ("buckets", "<i4"), ("counts", "<i4"), ("n_words", "<i8")))
                upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[pointers]
                cols = [n_words, np.diff(upto(count)), np.diff(upto(count * gain[bucket]))]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *map(pa.array, cols)], names=["key", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"key {ids}, n_words long, n_features long, weight long")


def noisy(weighted: DataFrame, seed: str) -> DataFrame:
    """Adds ``score``: the weight plus Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """Adds ``rank`` (1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N eligible rows, else null)."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_first()]
    dealt = scored.where(eligible).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the place in it in the lower 33
    placed = written(dealt.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, total = {}, 0
    for r in sorted(sizes):
        before[r.part], total = total, total + r.n
    drawn = total * percent // 100
    offsets = scored.sparkSession.createDataFrame([*before.items()], "part long, before long")  # a row for each range
    rank = F.col("before") + F.col("place") + 1
    names = scored.columns
    out = placed.join(F.broadcast(offsets), "part").select(*names, F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(f"not ({eligible})").select(*names, F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)


def resampled(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, min_words: int = 20, key: str = "doc_id") -> DataFrame:
    """``key`` of every document with ``n_words, n_features, weight, score`` and its ``rank`` in the draw."""
    matrix = written(count_matrix(documents, key, n, buckets), "csr")
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, None, n, buckets), buckets))
    scored = written(noisy(weights(matrix, gain), seed), "weights")
    dropped(matrix)
    return ranked(scored, f"n_words >= {min_words}", percent).withColumnRenamed("key", key)
