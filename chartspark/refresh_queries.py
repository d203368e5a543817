"""Queries of read models that follow changes and of jobs that go by pages; and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators import store
from chartspark.operators.job_state import Job
from chartspark.plans import incremental, views
from chartspark.plans.fixtures import Tables, with_fixtures
from chartspark.plans.staging import shared_dir, staged
from chartspark.store_queries import ROWS

Query = Callable[[SparkSession, str], DataFrame]

#: Before the changes: rows of some songs are missing, others stand at other positions, weeks and levels, and some are there that go.
ENTRIES_BEFORE = """SELECT song_id, artist_id, chart_name, chart_territory, weeks_on_chart + song_id % 3 AS weeks_on_chart,
 CASE WHEN song_id % 11 = 4 THEN position + 30 ELSE position END AS position, CASE WHEN song_id % 11 = 4 THEN chart_week + 7 ELSE chart_week END AS chart_week FROM chart_entries WHERE song_id % 7 <> 3"""
ENTRIES_AFTER = "SELECT song_id, artist_id, chart_name, chart_territory, weeks_on_chart, position, chart_week FROM chart_entries WHERE song_id % 13 <> 6"
FEATURES_BEFORE = "SELECT song_id, featured_artist_id FROM song_features WHERE (song_id + featured_artist_id) % 4 <> 1"
FEATURES_AFTER = "SELECT song_id, featured_artist_id FROM song_features WHERE (song_id + featured_artist_id) % 5 <> 2"
AWARDS_BEFORE = "SELECT artist_id, territory, body, CASE WHEN song_id % 6 = 1 THEN 'gold' ELSE level END AS level, units, certified_at FROM certifications WHERE song_id % 9 <> 2"
AWARDS_AFTER = "SELECT artist_id, territory, body, level, units, certified_at FROM certifications WHERE song_id % 10 <> 7"


def _changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went and that came, with how many copies as ``sign`` (below 0: went); both tables are met in one grouping."""
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    return both.groupBy(*before.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def _stored(t: Tables, model: incremental.Model) -> incremental.Stored:
    return incremental.Stored(t.spark, f"{shared_dir(t.spark)}/models/{uuid.uuid4().hex}", model, 16)


def _tables(spark: SparkSession, d: str, *names: str) -> Tables:
    """The tables, those that are read before and after the changes written once."""
    t = Tables(spark, d)
    for name in names:
        t.made[name] = staged(t[name], name)
    return t


def _songs(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "chart_entries")
    before, after = t.sql(ENTRIES_BEFORE), t.sql(ENTRIES_AFTER)
    kept = _stored(t, incremental.SONG_CHARTS)
    kept.build(incremental.song_chart_rows(before))
    kept.apply(incremental.song_chart_rows(_changes(before, after)))
    return views.song_chart_dimensions(kept.read(), t)


def _artists(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "chart_entries", "song_features")
    entries, features = (t.sql(ENTRIES_BEFORE), t.sql(ENTRIES_AFTER)), (t.sql(FEATURES_BEFORE), t.sql(FEATURES_AFTER))
    kept = _stored(t, incremental.ARTIST_CHARTS)
    kept.build(incremental.artist_chart_rows(entries[0], features[0]))
    kept.apply(incremental.artist_chart_changes(entries[1], features[0], _changes(*entries), _changes(*features)))
    return views.artist_dimensions(kept.read(), t)


def _certifications(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "certifications")
    before, after = t.sql(AWARDS_BEFORE), t.sql(AWARDS_AFTER)
    kept = _stored(t, incremental.CERTIFICATIONS)
    kept.build(incremental.certification_rows(before))
    kept.apply(incremental.certification_rows(_changes(before, after)))
    return views.artist_dimensions(kept.read(), t)


def _job(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of the enrichment of songs, a hundred a run."""
    t = Tables(spark, d)
    rows = store.unenriched_songs(t.sql(ROWS["song_rows"])).select("id", "slug", "title")
    job = Job(spark, f"{shared_dir(spark)}/jobs/{uuid.uuid4().hex}", "id", 100)
    for _ in range(3):
        job.run(rows, lambda page: page.withColumn("ok", F.when(F.col("id") % 6 > 0, F.col("id") % 4 > 0)))
    return job.results()


QUERIES: dict[str, Query] = {
    "refreshed_song_charts": _songs,
    "refreshed_artist_charts": _artists,
    "refreshed_certifications": _certifications,
    "enrichment_job": _job,
}

_PAGED = f"SELECT id, slug, title, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS total FROM ({ROWS['song_rows']}) WHERE spotify_track_id IS NOT NULL AND (album_id IS NULL OR release_date IS NULL OR duration_ms IS NULL OR image_url IS NULL)"


def sql(view_sql: dict[str, str]) -> dict[str, str]:
    """The views over the tables after the changes; a job of few rows starts over within its three runs."""
    after = {"chart_entries": ENTRIES_AFTER, "song_features": FEATURES_AFTER, "certifications": AWARDS_AFTER}

    def over(view: str) -> str:
        text = view_sql[view]
        for name, rows in after.items():
            text = text.replace(f"FROM {name} ", f"FROM ({rows}) ").replace(f"JOIN {name} ", f"JOIN ({rows}) ")
        return with_fixtures(text)

    runs = "SELECT id, slug, title, CASE WHEN id % 6 > 0 THEN id % 4 > 0 END AS ok FROM p, (SELECT unnest([0, 1, 2]) AS run) WHERE place // 100 = run % CAST(ceil(total / 100.0) AS BIGINT)"
    return {
        "refreshed_song_charts": over("song_chart_summary"),
        "refreshed_artist_charts": over("artist_chart_summary"),
        "refreshed_certifications": over("artist_certification_summary"),
        "enrichment_job": with_fixtures(f"WITH p AS ({_PAGED}) {runs}"),
    }
