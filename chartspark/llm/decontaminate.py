"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

The index is a table of postings: one for each occurrence of a benchmark term in the corpus, as
(row, term, pos), and one end posting for each document, which holds its word count and ids. Texts
are tokenised once, while it is written, and not read again.

Windows are 13 consecutive words of an item (an item of fewer is one window). Each is looked up by
its rarest term, as counted over the index; a window with a term that the corpus lacks is dropped.
A posting of such a term gives an alignment: the offset between places in the document and in the
item. Its list is intersected, adjusted by that offset, with the list of the second rarest term,
and for alignments that are left, with the lists of all other terms: a window occurs where all its
places are left. The same lists, shifted by up to ``slop`` places, give proximity matches. Windows of an item with the same
words are looked up once, and windows are read off runs of places, so repeated words and long items cost their length.

Shuffles: postings of documents that have an alignment, and what is asked of them; texts never.
Terms and alignments are joined by size: the planner broadcasts a side only when its written bytes
are under Spark's threshold; the terms are broadcast also where their bytes, counted, are under
BROADCAST_BYTES. A term, item or document of any frequency is met in partial aggregates and in
sort-merge joins that adaptive execution splits.

Defined results: a null text has no words; a null item_id is not listed, but its windows count as
hits; items of one item_id are one item; rows with one doc_id are judged row by row, equal rows
alike; other columns are not read; an empty benchmark leaves every document clean; an empty corpus
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.llm.scratch import dropped, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every ASCII character that is neither a letter nor a digit.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
BROADCAST_BYTES = 16 << 20
END = ""


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and all beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def text_key() -> Column:
    """With doc_id, tells rows of different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _fits(df: DataFrame, column: str) -> bool:
    """Whether a list of terms may be broadcast."""
    return (df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0) <= BROADCAST_BYTES


def item_places(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, place, term, size``: the words of every item text; ``item`` numbers distinct texts of an item_id."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = items.select(F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(), "w").alias("item"), "item_id", "w")
    return items.select("item", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("place", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``row, pos, term`` of each occurrence of ``terms``, and an END posting for each row, at its word count,
    with ``doc_id`` and ``text_hash``. Rows are numbered as they are written; write the index before using it twice."""
    asked = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct()
    asked = F.broadcast(asked) if _fits(terms, "term") else asked
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key().alias("text_hash"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
    found = rows.select("row", "doc_id", "text_hash", F.posexplode("w").alias("pos", "term")).join(asked, "term")
    end = F.col("term") == END
    return found.select("row", "pos", "term", F.when(end, F.col("doc_id")).alias("doc_id"), F.when(end, F.col("text_hash")).alias("text_hash"))


def rarest(index: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """``item, at, width, of, term, of2, term2``: for each window (by its first place ``at``), places and terms of its two
    rarest words (of a window of one word, the second is null); only where the corpus has all its terms. Of the windows of
    an item that have the same words, the first stands for all: they occur in the same places of a document."""
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = places.join(counts, "term", "left")
    first, last = F.greatest(F.col("place") - size + 1, F.lit(0)), F.least("place", F.greatest(F.col("size") - size, F.lit(0)))
    parts = counted.select("item", "size", "place", "term", "n", F.explode(F.sequence(first, last)).alias("at"))
    known = F.when(F.col("n").isNotNull(), F.struct("n", "term", "place"))
    ranked = parts.groupBy("item", "at").agg(F.array_sort(F.collect_list(known)).alias("by"), F.array_sort(F.collect_list(F.struct("place", "term"))).alias("words"), F.least(F.first("size"), F.lit(size)).alias("width"))
    one = lambda i, what: F.get("by", F.lit(i))[what]
    window = F.struct("at", "width", one(0, "place").alias("of"), one(0, "term").alias("term"), one(1, "place").alias("of2"), one(1, "term").alias("term2"))
    kept = ranked.where(F.size("by") == F.col("width")).groupBy("item", F.transform("words", lambda x: x["term"]).alias("words"))
    return kept.agg(F.min(window).alias("window")).select("item", "window.*")


def _shifted(slop: int) -> Column:
    return F.explode(F.sequence(F.lit(-slop), F.lit(slop)))


def alignments(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """``row, item, shift, low, high, width``: where the lists of the two rarest terms of a window meet, and the places in the item of all such windows."""
    looked = windows.select("term", "item", "at", "width", "of", "of2", "term2")
    first = index.join(looked, "term").select("row", "item", "at", "width", "of2", "term2", (F.col("pos") - F.col("of")).alias("shift"))
    second = index.join(windows.where("term2 is not null").select(F.col("term2").alias("term")).distinct(), "term").select("row", F.col("term").alias("term2"), "pos")
    asked = first.where("term2 is not null").withColumn("off", _shifted(slop))
    asked = asked.withColumn("pos", F.col("shift") + F.col("of2") + F.col("off"))
    met = asked.join(second, ["row", "term2", "pos"], "left_semi").select("row", "item", "shift", "at", "width")
    both = met.unionByName(first.where("term2 is null").select("row", "item", "shift", "at", "width"))
    return both.groupBy("row", "item", "shift").agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("width")).alias("high"), F.max("width").alias("width"))


def matches(index: DataFrame, places: DataFrame, size: int = 13, slop: int = 0) -> DataFrame:
    """``row, item, shift, at, width, exact``: windows of items that occur in a row, the first word at ``shift + at``.
    ``exact`` is false for those of which words stand up to ``slop`` places off (the rarest is in place). ``index`` and ``places`` as written tables."""
    windows = written(rarest(index, places, size), "windows")
    aligned = written(alignments(index, windows, slop), "aligned")
    near = index.where(F.col("term") != END).join(aligned.select("row").distinct(), "row", "left_semi").select("row", "pos", "term")
    asked = aligned.join(places.select("item", "place", "term"), "item").where("place >= low and place < high").withColumn("off", _shifted(slop))
    asked = asked.select("row", "item", "shift", "width", "term", "place", "off", (F.col("shift") + F.col("place") + F.col("off")).alias("pos"))
    at, same = ["row", "item", "shift"], F.col("same")
    placed = asked.join(near, ["row", "term", "pos"]).repartition(*at).groupBy(*at, "width", "place").agg(F.max(F.col("off") == 0).alias("same"))
    # Places that follow each other have one difference to their number in order: they are a run, and a run holds the windows
    # that begin up to ``width`` before its end.
    by = Window.partitionBy(*at).orderBy("place")
    placed = written(placed.select(*at, "width", "place", "same", (F.col("place") - F.row_number().over(by)).alias("around"), (F.col("place") - F.sum(same.cast("int")).over(by)).alias("exact")), "placed")
    around, exact = _begun(placed, at, "around"), _begun(placed.where(same), at, "exact").select(*at, "at", F.lit(True).alias("exact"))
    found = around.join(windows.select("item", "at", "of"), ["item", "at"])
    # Merge joins: these tables grow with the corpus, and compress so well that their files look small enough to broadcast.
    found = found.join(placed.where(same).select(*at, F.col("place").alias("of")).hint("merge"), [*at, "of"], "left_semi")
    return found.join(exact.hint("merge"), [*at, "at"], "left").select(*at, "at", "width", F.coalesce("exact", F.lit(False)).alias("exact"))


def _begun(placed: DataFrame, key: list[str], run: str) -> DataFrame:
    """The first places of the windows that lie in runs of places."""
    runs = placed.groupBy(*key, "width", run).agg(F.min("place").alias("low"), (F.max("place") - F.col("width") + 1).alias("high"))
    return runs.where("low <= high").select(*key, "width", F.explode(F.sequence("low", "high")).alias("at"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, slop: int = 2) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, items, n_near`` and the verdict ``contaminated``: words in exact
    matches are at least 1/share of all. ``n_near`` counts the items of which a window occurs with words up to ``slop`` places off, exact ones included."""
    places = written(item_places(benchmark), "places")
    index = written(postings(documents.select("doc_id", "text"), places.select("term").distinct()), "index")
    found = written(matches(index, places, size, slop), "matches")
    exact = found.where("exact")
    covered = exact.select("row", F.explode(F.sequence(F.col("shift") + F.col("at"), F.col("shift") + F.col("at") + F.col("width") - 1)).alias("pos"))
    hit = covered.groupBy("row").agg(F.count_distinct("pos").alias("hit"))
    names = places.select("item", F.col("item_id").cast("string").alias("id")).distinct()
    named = exact.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("items"))
    near = found.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.count_distinct("id").alias("near"))
    ends = index.where(F.col("term") == END).select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(hit, "row", "left").join(named, "row", "left").join(near, "row", "left")
    items, zero = F.coalesce("items", F.array().cast("array<string>")), F.lit(0).cast("long")
    out = out.select("doc_id", "text_hash", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("near", zero).alias("n_near"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))
