"""Winnowed anchors of word windows, shared by the two operators that find repeated passages.

A window is ``size`` consecutive words. Its anchor is the least hash among the ``seed``-word
shingles inside it, a function of the window's words alone, so equal windows have equal anchors
wherever they lie. Consecutive windows with one anchor form a run; a run is one row, about one
for every (size - seed) / 2 words, and its span hash covers all words of all its windows. Two
runs with equal (anchor, span) hold the same windows, so copies of any length are compared by
whole runs; single windows are compared only where runs with a common anchor differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.words import BASE, U, Hasher, grams, mix, powers, rows_of, signed, slices

SEED = 16
RUNS = "anchor long, span long, doc_id long, text_hash long, first int, last int"
WINDOWS = "anchor long, window long, doc_id long, text_hash long, first int"


def keyed_columns() -> list[Column]:
    """doc_id, text and a hash of the text, which tells rows with one doc_id apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text")]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*keyed_columns())


def _window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums with which the hash of any stretch of words is two reads, and their powers."""
    pw, inv = powers(len(words) + 1, BASE ^ 0x5DEECE66C)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(mix(words, 77) * pw[:-1], out=sums[1:])
    return sums, pw, inv


def _stretch(sums: np.ndarray, inv: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(U) * U(BASE), 5)


def _anchors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The anchor of the window that starts at each word (of the whole array; rows not separated)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    g, width, least = grams(words, seed, 11), size - seed + 1, None
    step, got = g, 1  # minima of runs of 1, 2, 4, ... shingles
    at = 0
    while width:
        if width & 1:
            part = step[at : at + n]
            least = part.copy() if least is None else np.minimum(least, part)
            at += got
        width >>= 1
        if width:
            step = np.minimum(step[:-got], step[got:])
            got *= 2
    return least


def runs_of(docs: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """One row for each run of windows; ``docs`` as ``keyed`` gives them. Rows without a doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                words, offsets = hasher(part.column("text"))
                anchor = _anchors(words, size, seed)
                if not len(anchor):
                    continue
                row = rows_of(offsets)[: len(anchor)]
                inside = np.arange(len(anchor)) + size <= offsets[row + 1]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])] & inside
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                stop = np.r_[first[1:], len(anchor)]
                ends = np.minimum(stop, offsets[row[first] + 1] - size + 1)
                sums, _, inv = _window_hashes(words, size)
                span = _stretch(sums, inv, first, ends + size - 1)
                at = row[first]
                yield pa.RecordBatch.from_arrays(
                    [signed(anchor[first]), signed(span), part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array((first - offsets[at]).astype(np.int32)), pa.array((ends - 1 - offsets[at]).astype(np.int32))],
                    names=["anchor", "span", "doc_id", "text_hash", "first", "last"],
                )

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, RUNS)


def windows_of(docs: DataFrame, size: int, spans: bool = False) -> DataFrame:
    """One row for each window of the runs in ``runs`` (an array of anchor, first, last) of each row; others give none.
    With ``spans``, the runs have a fourth field, ``span``, which their windows carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch.filter(batch.column("runs").is_valid()), "text"):
                words, offsets = hasher(part.column("text"))
                runs = part.column("runs")
                count = np.diff(np.asarray(runs.offsets))
                row = np.repeat(np.arange(len(runs)), count)
                flat = runs.flatten()
                anchor, first, last = (flat.field(i).to_numpy() for i in range(3))
                size_of = (last - first + 1).astype(np.int64)
                which = np.repeat(np.arange(len(row)), size_of)
                step = np.arange(len(which)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
                begin = (first[which] + step).astype(np.int64)
                sums, _, inv = _window_hashes(words, size)
                at = offsets[row[which]] + begin
                took = pa.array(row[which])
                span = [pa.array(flat.field(3).to_numpy()[which])] if spans else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[which]), signed(_stretch(sums, inv, at, at + size)), part.column("doc_id").take(took), part.column("text_hash").take(took), pa.array(begin.astype(np.int32)), *span],
                    names=["anchor", "window", "doc_id", "text_hash", "first", *["span"] * spans],
                )

    return docs.mapInArrow(run, WINDOWS + ", span long" * spans)


def listed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``doc_id, text_hash`` and the list of what ``rows`` have for them; equal rows count once, so equal documents do not multiply."""
    return rows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*columns)).alias(name))


def texts_with(docs: DataFrame, rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row of ``docs`` for each key that ``rows`` have, and their list. Keys that have no rows are not read further."""
    found = docs.join(listed(rows, name, columns), ["doc_id", "text_hash"])
    return found.dropDuplicates(["doc_id", "text_hash"])
