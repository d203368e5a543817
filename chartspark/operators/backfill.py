"""Backfills of weekly charts that end in tables and can be broken off.

A backfill works in its own folder. First it names every artist and song of all its weeks at once, so that what a row refers
to does not depend on where a run broke off; then it takes the weeks in batches. Each batch is written and then committed to
the folder's log; a run that starts again reads what is committed, does over the batch that was not, and goes on. Within a
week entries are accepted one after another, and weeks do not conflict, so the batches add up to what one run would give.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.operators import charts
from chartspark.plans.staging import Log, stored


@dataclass(frozen=True)
class Source:
    """A weekly chart: how its rows are persisted. ``slash``: whether "/" stands between artists of a credit."""

    chart_name: str
    chart_territory: str
    slash: bool = False
    provisional: bool = True
    featured_provisional: bool = True
    source: str | None = None


#: Names under which the two weekly charts are kept.
HOT_100 = Source("billboard_hot_100", "US", featured_provisional=False)
UK_SINGLES = Source("uk_official_singles", "UK", slash=True, source="uk_afrobeats_chart")


def weekly(rows: DataFrame, source: Source) -> DataFrame:
    """Canonical rows of weekly pages (week, this_week, artist, song, peak_position, weeks_on_chart): ``seq`` is the week, the
    place and the words of the row, as one text that orders rows by them."""
    place = F.concat_ws("\u0001", "week", F.lpad(F.col("this_week").cast("string"), 6, "0"), "artist", "song").alias("seq")
    out = rows.select(
        place, F.lit(source.chart_name).alias("chart_name"), F.lit(source.chart_territory).alias("chart_territory"), F.col("week").alias("chart_week"), F.col("this_week").alias("rank"),
        "artist", F.col("song").alias("title"), "peak_position", "weeks_on_chart", F.lit(source.source).cast("string").alias("source"),
    )
    return charts.weekly_rows(out, source.slash)


def percent(done: int, total: int) -> int:
    """Whole percent, half up."""
    return int(100 * done / total + 0.5) if total else 100


def run(
    rows: DataFrame, source: Source, tables: Mapping[str, DataFrame], folder: str, weeks_a_batch: int = 520, progress: Callable[[dict], None] | None = None
) -> dict[str, DataFrame]:
    """Backfill weekly pages into ``folder``: ``entries`` and ``features`` to add, ``mentions`` and ``titles`` as resolved.

    ``tables``: artists, songs, chart_entries, song_features and, where there are, aliases and external ids (see
    ``charts.resolved``). ``progress`` is called after each batch with totalDates, totalCharts, totalEntries, currentDate and
    percent; an error in it breaks the run off, as a lost driver would, and the same call goes on from there.
    """
    spark = rows.sparkSession
    log = Log(spark, f"{folder}/_log")
    done = log.entries()
    names = {k: f"{folder}/{k}" for k in ("mentions", "titles", "credited", "features")}
    if not done:
        found = charts.resolved(
            weekly(rows, source), tables["artists"], tables["songs"], source.provisional, source.featured_provisional,
            **{k: v for k, v in tables.items() if k.endswith(("aliases", "external_ids"))},
        )
        for k in ("mentions", "titles", "credited"):
            stored(found[k], names[k])
        stored(charts.credited_features(found["credited"], found["mentions"], tables["song_features"]), names["features"])
        weeks = [str(r[0]) for r in rows.select("week").distinct().orderBy(F.col("week").desc()).toLocalIterator()]  # one number for each week
        done = [{"step": "resolved", "weeks": weeks}]
        log.commit(done[0], 0)
    read = {k: spark.read.parquet(p) for k, p in names.items()}
    pending = done[0]["weeks"][sum(len(b["weeks"]) for b in done[1:]) :]
    total, entries = len(done[0]["weeks"]), sum(b["entries"] for b in done[1:])
    while pending:
        batch, pending = pending[:weeks_a_batch], pending[weeks_a_batch:]
        within = F.col("chart_week").between(F.lit(batch[-1]).cast("date"), F.lit(batch[0]).cast("date"))
        mine = charts.accepted(read["credited"].where(within), _chart(tables["chart_entries"], source).where(within))
        path = f"{folder}/entries/batch={len(done):08d}"
        count = stored(mine.drop("seq"), path).count()
        done.append({"step": "entries", "weeks": batch, "entries": count, "path": path})
        log.commit(done[-1], len(done) - 1)
        entries += count
        if progress:
            dates = total - len(pending)
            progress({"totalDates": dates, "totalCharts": total, "totalEntries": entries, "currentDate": batch[-1], "percent": percent(dates, total)})
    paths = [b["path"] for b in done[1:]]
    read["entries"] = spark.read.parquet(*paths) if paths else charts.accepted(read["credited"], _chart(tables["chart_entries"], source)).drop("seq")
    return read


def _chart(entries: DataFrame, source: Source) -> DataFrame:
    this: Column = (F.col("chart_name") == source.chart_name) & (F.col("chart_territory") == source.chart_territory)
    return entries.where(this)


def counters(rows: DataFrame, result: Mapping[str, DataFrame]) -> DataFrame:
    """``dates, entries`` of a finished backfill."""
    dates = rows.agg(F.count_distinct("week").alias("dates"))
    return dates.crossJoin(result["entries"].agg(F.count(F.lit(1)).alias("entries")))  # one row each
