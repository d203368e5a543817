"""The landing zone: fetched pages and documents as files, read in batches and as streams.

A file lies at ``<zone>/kind=<kind>/day=<yyyy-mm-dd>/<name>``; ``kind`` says which page it is (a chart, listeners, totals, a
metadata document) and ``day`` when it was fetched. Both are partition columns, so a condition on them leaves other folders
unopened, and the stream's checkpoint keeps which files it has read. Spark's own file source does this from any store that
it can read, with many small files to a task; readers of pages take what it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "value string, kind string, day date"


def _landed(files: DataFrame) -> DataFrame:
    """``url`` (the file's name, decoded), ``html``, ``kind``, ``day``."""
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return files.select(F.url_decode(name).alias("url"), F.col("value").alias("html"), "kind", "day")


def read(spark: SparkSession, zone: str, *conditions: Column) -> DataFrame:
    """Landed pages that meet conditions on ``kind`` and ``day``."""
    files = spark.read.schema(SCHEMA).text(zone, wholetext=True)
    for c in conditions:
        files = files.where(c)
    return _landed(files)


def stream(spark: SparkSession, zone: str, *conditions: Column, files_a_batch: int = 1000) -> DataFrame:
    """The same as a stream: each file once, at most so many in a batch."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).text(zone, wholetext=True)
    for c in conditions:
        files = files.where(c)
    return _landed(files)


def file_name(url: Column) -> Column:
    """The name under which a page of ``url`` lands."""
    return F.url_encode(url)
