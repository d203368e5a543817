"""Ranked lexical search: exact top-k by impacts, over an index of one dual-sorted wavelet tree a shard.

A shard is some ``SHARD`` bytes of consecutive texts. Its terms are counted once and written (postings and sizes); the
corpus-wide number of documents and terms then fixes the impact of each posting, and the shard's lists are written as a
wavelet tree (wavelet.py), of every term and row of the table. Neither step shuffles anything.

Items are searched in blocks (``BLOCK_ITEMS`` items or ``BLOCK_BYTES`` of text, one item at least). The lengths of a
block's lists in all shards are summed up to document frequencies. Every task searches its shards one after another and
keeps k rows an item, so that each shard starts with the kth score so far. One shard of 16 goes first: the kth scores found
there are the floors of the others, which then visit only nodes that could hold better ones, and send few rows.

Scores are 64-bit integers: weight floor(1000 ln((2N+2)/(2df+1))) times (10**9 tf) div (1000 tf + 12 m), summed over an
item's terms with repeats; m = 75 + (25 n N) div L.

Defined results: a null or empty text has no terms and is never found; an item without terms has no rows; ids of documents
are integers, rows without one count in N, L and df and are never returned; rows that share a doc_id are ranked one by one;
an item_id that occurs more than once is searched once, with its least text; other columns are not read; an empty table of
documents or items gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chartspark.llm.scratch import dropped, written
from chartspark.llm.wavelet import NO_ID, Best, Tree, build_bits, levels_of
from chartspark.llm.words import slices

SHARD = 8 << 20
BLOCK_ITEMS, BLOCK_BYTES = 2048, 4 << 20
#: One shard of so many is searched first.
SEEDS = 16
#: Bytes of terms, A-Z in lower case; every other ASCII character ends a term.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

COUNTED = "shard string, n_docs long, n_terms long, docs binary, sizes binary, terms binary, pointers binary, lists binary, times binary"
INDEX = "shard string, docs binary, terms binary, starts binary, impacts binary, bits binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def _row(schema: str, values: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    of = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], of[k]) for v, k in zip(values, kinds, strict=True)], names=list(names))


def _numbers(batch: pa.RecordBatch, column: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def counted(documents: DataFrame) -> DataFrame:
    """A row for each shard: ids and numbers of terms of its documents, its terms, and how often each document has which."""

    def shard(part: pa.RecordBatch, name: str) -> pa.RecordBatch:
        ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        known: dict[bytes, int] = {}
        sizes, found, lists, times = [], [], [], []
        texts = part.column("text")
        for i in order.tolist():
            words = terms_of(texts[i].as_py())
            counts = Counter(words)
            sizes.append(len(words))
            found.append(len(counts))
            lists += [known.setdefault(t, len(known)) for t in counts]
            times += counts.values()
        pack = lambda x, kind: np.array(x, kind).tobytes()
        whole = [name, sum(n > 0 for n in sizes), sum(sizes), pack(ids[order], "<i8"), pack(sizes, "<i8"), b" ".join(known), pack(np.cumsum([0, *found]), "<i8"), pack(lists, "<i4"), pack(times, "<i4")]
        return _row(COUNTED, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in slices(batch, "text", SHARD):
                yield shard(part, f"{TaskContext.get().partitionId()}-{n}")
                n += 1

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def indexed(shards: DataFrame) -> DataFrame:
    """The index of written ``counted`` shards: a wavelet tree for each."""
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, pointers = _numbers(batch, "sizes", i, "<i8"), _numbers(batch, "pointers", i, "<i8")
                lists, tf = _numbers(batch, "lists", i, "<i4"), _numbers(batch, "times", i, "<i4").astype(np.int64)
                if not len(lists):
                    continue
                m = 75 + np.array([25 * int(n) * n_docs // n_terms for n in sizes], np.int64)
                doc = np.repeat(np.arange(len(sizes)), np.diff(pointers))
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                order = np.lexsort((doc, -impact, lists))
                terms = batch.column("terms")[i].as_py()
                starts = np.searchsorted(lists[order], np.arange(terms.count(b" ") + 2))
                yield _row(INDEX, [batch.column("shard")[i].as_py(), batch.column("docs")[i].as_py(), terms, starts.astype("<i8").tobytes(), impact[order].astype("<i4").tobytes(), build_bits(doc[order], levels_of(len(sizes)))])

    return shards.mapInArrow(run, INDEX)


def _lists(batch: pa.RecordBatch, row: int, asked: dict[bytes, int]) -> list[tuple[int, int]]:
    """(number among ``asked``, number in the shard) of the terms that the shard has."""
    return [(asked[t], i) for i, t in enumerate(batch.column("terms")[row].as_py().split(b" ")) if t in asked]


def frequencies(index: DataFrame, asked: dict[bytes, int]) -> np.ndarray:
    """Documents that hold each of the terms ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                size = np.diff(_numbers(batch, "starts", i, "<i8"))
                for term, own in _lists(batch, i, asked):
                    total[term] += size[own]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(len(asked), np.int64)
    for r in index.select("terms", "starts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n  # a row for each term of the block
    return out


def _searcher(asked: dict[bytes, int], items: list[tuple[np.ndarray, np.ndarray]], k: int, floors: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, floors.get(i)) for i in range(len(items))]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(_numbers(batch, "docs", i, "<i8"), _numbers(batch, "starts", i, "<i8"), _numbers(batch, "impacts", i, "<i4"), batch.column("bits")[i].as_py())
                own = np.full(len(asked), -1, np.int64)
                for term, there in _lists(batch, i, asked):
                    own[term] = there
                for (terms, weights), top in zip(items, best, strict=True):
                    there = own[terms] >= 0
                    tree.search(own[terms[there]], weights[there], top)
        rows = [(item, -doc, score) for item, top in enumerate(best) for score, doc in top.rows]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of items in blocks of bounded size."""
    block, size = [], 0
    for r in items.groupBy("item_id").agg(F.min("text").alias("text")).where("text <> ''").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r.text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.text)
    if block:
        yield block


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of a written ``index`` for each of ``items`` (item_id, text)."""
    spark, kind = index.sparkSession, items.schema["item_id"].dataType
    out = None
    for block in _blocks(items):
        texts = [Counter(terms_of(r.text)) for r in block]
        asked = {t: i for i, t in enumerate(dict.fromkeys(t for c in texts for t in c))}
        df = frequencies(index, asked)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        numbers = [(np.array([asked[t] for t in c], np.int64), np.array([*c.values()], np.int64)) for c in texts]
        scored = [(t, weight[t] * n) for t, n in numbers]
        seed = F.pmod(F.xxhash64("shard"), F.lit(SEEDS)) == 0
        schema = "item int, doc_id long, score long"
        first = written(_top(index.where(seed).mapInArrow(_searcher(asked, scored, k, {}), schema), k), "seeds")
        floors = {r.item: (r.score, r.doc_id) for r in first.where(F.col("rank") == k).toLocalIterator()}  # a row for each item of the block
        rest = index.where(~seed).mapInArrow(_searcher(asked, scored, k, floors), schema)
        best = _top(rest.unionByName(first.drop("rank")), k)
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(block)), pa.int32()), "item_id": pa.array([r.item_id for r in block], to_arrow_type(kind))}))
        best = written(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "hits", first)  # at most k rows an item
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


def top_documents(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``documents`` (doc_id, text) and search it: see ``search``."""
    shards = written(counted(documents), "counted")
    n_docs = shards.agg(F.sum("n_docs")).first()[0] or 0
    index = written(indexed(shards), "wavelets", shards)
    found = search(index, n_docs, items, k)
    dropped(index)
    return found
