"""A training-corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input.

Stages judge rows, not ids: rows that share a doc_id are scored, linked, cut and removed one by one.
A null text has no words, so it is no near duplicate, repeats nothing and is not contaminated; it
stays where the quality model keeps the empty text. A row without a doc_id is scored, is no near
duplicate, keeps its passages, and is decontaminated and packed as others are. An empty table gives
no rows. Every stage but the last returns the columns of its input, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.llm import decontaminate, jaccard_join, quality_gam, substring_dedup, tokens, vector_packing
from chartspark.llm.queries import PACK_LIMITS, table, tokenizer_file
from chartspark.llm.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score of 0.3 or more)."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.scored(docs, model).where("score >= 0.3").select("carried.*")


def keyed(docs: DataFrame, text_hash: Column) -> DataFrame:
    """``carried`` (the row, whatever its columns are called) and what tells rows apart: ``row_id`` and ``row_hash``."""
    return docs.select(F.struct("*").alias("carried"), F.col("doc_id").alias("row_id"), text_hash.alias("row_hash"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows with equal or linked shingle sets: that with the smallest doc_id, then the smallest hash
    of its text, then the least of its other columns. Rows are judged one by one, also where they share a doc_id; rows
    without a doc_id or without words stay."""
    found = written(jaccard_join.linked_rows(docs), "linked")
    counts = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    # A root's best key comes back by that key, not by the root: a group of any size stays spread out.
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("b")).select("root", "b.doc_id", "b.text_hash", F.lit(True).alias("best"))
    judged = counts.join(best, ["root", "doc_id", "text_hash"], "left").where("best is null or n > 1")
    judged = written(judged.select(F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"), F.coalesce("best", F.lit(False)).alias("best")), "judged")
    # One merge join at every size: what is judged grows with the corpus, and texts cross the network once.
    rows = keyed(docs, jaccard_join.text_key()).withColumn("row_id", F.col("row_id").cast("long"))
    met = rows.join(judged.hint("merge"), ["row_id", "row_hash"], "left")
    place = F.row_number().over(Window.partitionBy("row_id", "row_hash").orderBy("carried"))
    return met.withColumn("place", place).where("best is null or (best and place = 1)").select("carried.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller doc_id has; a document of which nothing is left goes."""
    found = substring_dedup.remove_repeats(docs, size=50).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("carried.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("carried.n_chars"))}
    return found.select(*[(new[c] if c in new else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = written(found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    same = F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_hash") == F.col("bad_hash"))
    return keyed(docs, decontaminate.text_key()).join(bad, same, "left_anti").select("carried.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 1,024 tokens."""
    return vector_packing.pack(docs, tokens.byte_bpe(tokenizer_file()), PACK_LIMITS)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", packed),
]

#: A fitted model and token ids are beyond SQL; the tests hold the run against a plain Python version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
