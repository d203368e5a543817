"""Read models as they are served: stored in parts by the columns that every question names first, sorted within by the order
that it asks for. A question reads the files of its part and the first rows of them; nothing is computed again.

A part is a value of columns with few values (a chart and territory, a day), or a bucket of a column with many (an artist).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.plans.staging import Log

NULL = "__none__"


@dataclass(frozen=True)
class Layout:
    """Parts by the values of ``parts`` (as text), or by ``buckets`` of a hash of ``bucketed``; ``order`` within."""

    parts: tuple[str, ...] = ()
    bucketed: str | None = None
    buckets: int = 64
    order: tuple[str, ...] = ()


#: name -> (view, layout): the ways in which the views are asked for.
LAYOUTS: dict[str, tuple[str, Layout]] = {
    "songs_by_chart": ("song_chart_summary", Layout(("chart_territory", "chart_name"), order=("-weeks_at_number_1", "peak_position", "song_id"))),
    "songs_by_artist": ("song_chart_summary", Layout(bucketed="artist_id", order=("artist_id", "song_id", "chart_name", "chart_territory"))),
    "current_charts": ("chart_latest_leaderboard", Layout(("chart_territory", "chart_name"), order=("position", "-chart_week", "song_id"))),
    "current_by_artist": ("chart_latest_leaderboard", Layout(bucketed="artist_id", order=("artist_id", "entry_id"))),
    "certified": ("artist_certification_summary", Layout(("territory", "body"), order=("-total_platinum_units", "-total_certifications", "artist_id"))),
    "chart_artists": ("artist_chart_summary", Layout(("role", "chart_territory"), order=("-total_chart_weeks", "best_peak_position", "artist_id"))),
    "artist_growth": ("artist_growth_summary", Layout(("snapshot_date",), order=("-daily_growth", "artist_id"))),
    "artist_momentum": ("artist_trending_summary", Layout(("snapshot_date",), order=("-momentum_score", "artist_id"))),
    "song_growth": ("song_growth_summary", Layout(("snapshot_date",), order=("-daily_growth", "song_id"))),
    "song_momentum": ("song_trending_summary", Layout(("snapshot_date",), order=("-momentum_score", "song_id"))),
    "country_streams": ("artist_country_summary", Layout(("origin_country",), order=("-total_streams", "artist_id"))),
}


def _order(layout: Layout) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in layout.order]


def _part(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL))


def _bucket(layout: Layout, value: Column) -> Column:
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(layout.buckets)).cast("int")


def publish(rows: DataFrame, folder: str, layout: Layout) -> None:
    """A new version of a served table; readers see it when its entry is in the log.

    Rows are dealt out by ranges of the part and the order, so a part of any size is spread over files that follow each
    other, and a small one is one file.
    """
    log = Log(rows.sparkSession, f"{folder}/_log")
    number = len(log.entries())
    path = f"{folder}/version={number}"
    if layout.bucketed:
        rows, keys = rows.withColumn("part_bucket", _bucket(layout, F.col(layout.bucketed))), ["part_bucket"]
    else:
        keys = [f"part_{c}" for c in layout.parts]
        rows = rows.withColumns({f"part_{c}": _part(c) for c in layout.parts})
    by = [*map(F.col, keys), *_order(layout)]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy(*keys).parquet(path)
    log.commit({"path": path}, number)


def served(spark: SparkSession, folder: str, layout: Layout, **equal: object) -> DataFrame:
    """Rows of the current version where columns have these values (None is null), from the files of their part only; with the
    order of the layout, ``orderBy`` and ``limit`` read what is sorted."""
    last = Log(spark, f"{folder}/_log").last()
    if last is None:
        raise LookupError(f"{folder} has no version yet")
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(last["path"])
    for c, value in equal.items():
        if c in layout.parts:
            rows = rows.where(F.col(f"part_{c}").cast("string") == F.lit(NULL if value is None else str(value)))
        elif c == layout.bucketed and value is not None:
            rows = rows.where(F.col("part_bucket") == _bucket(layout, F.lit(value)))
        rows = rows.where(F.col(c).isNull() if value is None else F.col(c) == F.lit(value))
    return rows.drop("part_bucket", *[f"part_{c}" for c in layout.parts])


def top(rows: DataFrame, layout: Layout, k: int) -> DataFrame:
    return rows.orderBy(*_order(layout)).limit(k)
