"""Substring dedup by seed and extend.

Seeds are the winnowed anchors of ``passages``. Documents are joined on the anchors that occur
under more than one doc_id; from each such seed the match is extended both ways, by whole runs of
windows where the surroundings are equal, and window by window (all offsets of the seed inside
the window) where they differ. Windows found under a smaller doc_id are merged into maximal
repeats, and their words go.

Shuffles: the runs (about one row for 17 words) twice, rows of repeated runs, and the texts twice,
by doc_id: for runs whose windows must be compared, and for the removal. Groups of any size are met
by partial aggregates (minimum doc_id), written, and by joins of rows with them, whose partitions
adaptive execution splits; no group is gathered in one task and no pairs are made.

Defined results: a null text has no words; a null doc_id is never a source and keeps all words;
rows with one doc_id are one document as a source, and are judged row by row; equal texts under
one doc_id do not remove each other; an empty table gives an empty table; other columns are
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.passages import keyed, keyed_columns, listed, runs_of, texts_with, windows_of
from chartspark.llm.scratch import written

KEY = ["doc_id", "text_hash"]


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, text_hash, first, end``: stretches of words of windows that a smaller doc_id has too. They may overlap."""
    runs = written(runs_of(docs, size), "runs")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    seeds = written(runs.join(written(shared, "shared"), "anchor", "left_semi"), "seeds", runs)
    kinds = written(seeds.groupBy("anchor", "span").agg(F.min("doc_id").alias("low")), "kinds")
    judged = written(seeds.join(kinds, ["anchor", "span"]), "judged", seeds)
    by_run = judged.where("doc_id > low").select(*KEY, "first", (F.col("last") + size).alias("end"))
    # Runs that are the first of their kind may still share single windows with another kind.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    unsure = judged.where("doc_id = low").join(written(mixed, "mixed"), "anchor", "left_semi")
    windows = written(windows_of(texts_with(docs, unsure, "runs", ["anchor", "first", "last"]), size), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    by_window = windows.join(written(least, "least"), ["anchor", "window"]).where("doc_id > low").select(*KEY, "first", (F.col("first") + size).alias("end"))
    return by_run.unionByName(by_window)


def cover(n: int, spans: list | None) -> np.ndarray | None:
    """A mask of the words that the spans cover; None where there are none."""
    if not spans:
        return None
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """``carried, n_words, n_removed, kept``: a row of ``docs``, and its kept words joined by one space, as bytes of UTF-8."""
    schema = f"carried {docs.select(F.struct('*').alias('c')).schema[0].dataType.simpleString()}, n_words long, n_removed long, kept binary"
    rows = docs.select(F.struct("*").alias("carried"), *keyed_columns()[:2])
    docs = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carried, spans, out = b.column("carried"), b.column("spans"), []
            texts = pc.struct_field(carried, "text").cast(pa.large_binary())
            for at in range(b.num_rows):
                words = (texts[at].as_py() or b"").split()
                gone = cover(len(words), spans[at].as_py())
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
                if len(out) == 512:
                    yield _rows(carried.slice(at + 1 - len(out), len(out)), out)
                    out = []
            if out:
                yield _rows(carried.slice(b.num_rows - len(out)), out)

    def _rows(carried: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        n, gone, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([carried, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["carried", "n_words", "n_removed", "kept"])

    spans = listed(repeated_spans(docs, size), "spans", ["first", "end"])
    return rows.join(spans, KEY, "left").select("carried", "spans").mapInArrow(run, schema)


def digests(cleaned: DataFrame) -> DataFrame:
    """The kept words as a SHA-256."""
    return cleaned.select("carried.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


