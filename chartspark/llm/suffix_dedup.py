"""Sparse suffix array dedup.

Suffixes are retained where a window of ``size`` words has a new minimiser, that is at
content-selected positions, about one in 17 words. They are sorted over the whole corpus, by the
words of the minimiser, then the words of the run of windows it stands for, then doc_id, in ranges
of equal size, so a group of any number of copies lies in as many ranges as it fills. Each suffix
is compared with its neighbours: equal neighbours show a repeat, found in the neighbourhood's
first document; suffixes with a common minimiser that then differ are unfolded into their windows,
which are sorted and compared in the same way. Neighbouring windows extend each match left and
right to its full length. What a range needs to know of the ranges beside it, at its two edges, is
a few numbers a range; the driver merges these and the ranges are read once more with them, so
groups at edges cost no shuffle and no join.

Defined results: a null text or doc_id takes no part; rows with one doc_id are one document and do
not match each other; equal rows give equal matches; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.passages import keyed, runs_of, texts_with, windows_of
from chartspark.llm.scratch import written

#: The most rows of one minimiser that a task holds; a longer group is settled as those at the edges of ranges are.
HELD = 1 << 18


def _neighbours(batches: Iterator[pa.RecordBatch], tail: str) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes with ``low`` (the first doc_id among equal neighbours), ``kinds`` (whether suffixes of the
    same minimiser differ) and ``edge`` (neighbours elsewhere may count too); those alone with their minimiser are left
    out. Every edge group adds a row with a ``note`` instead: least and greatest tail and document of the minimiser, and
    the lows of its first and last tail."""
    held: list[pa.RecordBatch] = []
    first, rows = True, 0

    def settle(group: list[pa.RecordBatch], edge: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(group).combine_chunks()
        anchor, key, doc = (t.column(c).to_numpy() for c in ("anchor", tail, "doc_id"))
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new_key = new_anchor | np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new_key)
        low = np.repeat(doc[at], np.diff(np.r_[at, len(doc)]))
        start = np.flatnonzero(new_anchor)
        size = np.diff(np.r_[start, len(doc)])
        most = np.repeat(np.maximum.reduceat(doc, start), size)
        least = np.repeat(np.minimum.reduceat(doc, start), size)
        kinds = np.repeat(np.add.reduceat(new_key.astype(np.int64), start), size) > 1
        keep = np.ones(len(doc), bool) if edge else most > least
        if not keep.any():
            return
        none = pa.nulls(len(doc), pa.list_(pa.int64()))
        for name, column in (("low", pa.array(low)), ("kinds", pa.array(kinds)), ("edge", pa.array(np.full(len(doc), edge))), ("note", none)):
            t = t.append_column(name, column)
        yield from t.filter(pa.array(keep)).to_batches()
        if edge:
            for i, j in zip(start, start + size - 1, strict=True):
                note = [anchor[i], key[i], key[j], least[i], most[i], low[i], low[j]]
                one = {f.name: pa.nulls(1, f.type) for f in t.schema} | {"note": pa.array([[int(x) for x in note]], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([one[f.name] for f in t.schema], schema=t.schema)

    for b in batches:
        if not b.num_rows:
            continue
        anchor = b.column("anchor").to_numpy()
        change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if held and held[-1].column("anchor")[-1].as_py() != anchor[0]:
            yield from settle(held, first)
            held, rows, first = [], 0, False
        if len(change):
            if held or first:  # what began before ends here
                yield from settle([*held, b.slice(0, int(change[0]))], first)
                first = False
                if len(change) > 1:
                    yield from settle([b.slice(int(change[0]), int(change[-1] - change[0]))], False)
            else:
                yield from settle([b.slice(0, int(change[-1]))], False)
            held, rows, b = [], 0, b.slice(int(change[-1]))
        held.append(b)
        rows += b.num_rows
        if rows > HELD:
            yield from settle(held, True)
            held, rows, first = [], 0, True
    if held:
        yield from settle(held, True)


def _across(notes: list[list[int]], tail: str):
    """Settles edge groups by the notes of all ranges: the scan's carry from one range to the next."""
    groups: dict[int, list[int]] = {}
    lows: dict[tuple[int, int], int] = {}
    for anchor, tail_a, tail_b, least, most, low_a, low_b in notes:
        g = groups.setdefault(anchor, [tail_a, tail_b, least, most])
        groups[anchor] = [min(g[0], tail_a), max(g[1], tail_b), min(g[2], least), max(g[3], most)]
        for key, low in ((tail_a, low_a), (tail_b, low_b)):
            lows[anchor, key] = min(lows.get((anchor, key), low), low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edge = b.column("edge").to_numpy(zero_copy_only=False)
            if not edge.any():
                yield b
                continue
            anchor, key, low, kinds = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("anchor", tail, "low", "kinds"))
            keep = np.ones(len(anchor), bool)
            begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (edge[1:] != edge[:-1])])
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(anchor)], strict=True):
                if edge[i]:
                    a = int(anchor[i])
                    tail_a, tail_b, least, most = groups[a]
                    keep[i:j], kinds[i:j] = most > least, tail_a != tail_b
                    low[i:j] = np.minimum(low[i:j], lows.get((a, int(key[i])), low[i]))
            out = {f.name: b.column(f.name) for f in b.schema} | {"low": pa.array(low), "kinds": pa.array(kinds.astype(bool))}
            yield pa.RecordBatch.from_arrays([out[f.name] for f in b.schema], schema=b.schema).filter(pa.array(keep))

    return run


def _compared(suffixes: DataFrame, tail: str) -> DataFrame:
    """Suffixes (a written table, dropped here) of minimisers met in more than one document, with ``low`` and ``kinds``."""
    ordered = suffixes.repartitionByRange("anchor", tail, "doc_id").sortWithinPartitions("anchor", tail, "doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in suffixes.schema) + ", low long, kinds boolean, edge boolean"
    seen = written(ordered.mapInArrow(lambda it: _neighbours(it, tail), schema + ", note array<long>"), f"neighbours-{tail}", suffixes)
    # Two notes for each range, and one for each HELD rows of one minimiser: bounded by the number of tasks, not by groups.
    notes = [r.note for r in seen.where("note is not null").select("note").toLocalIterator()]
    return seen.where("note is null").drop("note").mapInArrow(_across(notes, tail), schema).drop("edge")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row that touch or overlap become one; its match is the least document among theirs."""
    for b in batches:
        out = []
        for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True):
            at = None
            for s in sorted((x["first"], x["end"], x["low"]) for x in spans):
                if at is not None and s[0] <= at[1]:
                    at = [at[0], max(at[1], s[1]), min(at[2], s[2])]
                    continue
                if at is not None:
                    out.append((doc, at[0], at[1] - at[0], at[2]))
                at = list(s)
            out.append((doc, at[0], at[1] - at[0], at[2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start_word", "n_words", "match_doc_id"])


def repeats(documents: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, start_word, n_words, match_doc_id``: the maximal stretches, of ``size`` words or more, each window of
    which a document with a smaller doc_id has too; ``match_doc_id`` is the least such document of any of its windows."""
    docs = keyed(documents)
    seen = _compared(written(runs_of(docs, size), "suffixes"), "span")
    by_run = seen.where("doc_id > low").select("anchor", "span", "doc_id", "text_hash", "first", (F.col("last") + size).alias("end"), "low")
    unsure = seen.where("doc_id = low and kinds")
    windows = written(windows_of(texts_with(docs, unsure, "runs", ["anchor", "first", "last", "span"]), size, spans=True), "windows")
    found = _compared(windows, "window").where("doc_id > low")
    found = written(found.select("anchor", "span", "doc_id", "text_hash", "first", (F.col("first") + size).alias("end"), "low"), "found")
    # What the first document of a kind of run found for its windows holds for all others of the kind.
    least = written(found.groupBy("anchor", "span").agg(F.min("low").alias("least")), "least")
    columns = ["doc_id", "text_hash", "first", "end"]
    by_run = by_run.join(least, ["anchor", "span"], "left").select(*columns, F.least("low", "least").alias("low"))
    by_window = found.select(*columns, "low")
    spans = by_run.unionByName(by_window).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "end", "low")).alias("spans"))
    return spans.select("doc_id", "spans").mapInArrow(_merged, "doc_id long, start_word long, n_words long, match_doc_id long")
