"""The library's queries, ``name -> function(spark, sf_dir)``, and the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.chart_queries import QUERIES as CHART_QUERIES
from chartspark.chart_queries import SQL as CHART_SQL
from chartspark.functions import parse, text
from chartspark.job_queries import QUERIES as JOB_QUERIES
from chartspark.job_queries import SQL as JOB_SQL
from chartspark.operators import relational as rel
from chartspark.persist_queries import QUERIES as PERSIST_QUERIES
from chartspark.persist_queries import SQL as PERSIST_SQL
from chartspark.plans import views
from chartspark.plans.fixtures import Tables, with_fixtures
from chartspark.refresh_queries import QUERIES as REFRESH_QUERIES
from chartspark.refresh_queries import sql as refresh_sql
from chartspark.source_queries import QUERIES as SOURCE_QUERIES
from chartspark.source_queries import SQL as SOURCE_SQL
from chartspark.store_queries import QUERIES as STORE_QUERIES
from chartspark.store_queries import SQL as STORE_SQL

AS_OF = date(2001, 11, 4)
#: The day of the leaderboards by day: within the events table.
DAY = date(2024, 1, 15)
Query = Callable[[SparkSession, str], DataFrame]


def _view(name: str) -> Query:
    if name == "artist_recent_chart_summary":
        return lambda spark, d: views.artist_recent_chart_summary(Tables(spark, d), AS_OF)
    return lambda spark, d: views.VIEWS[name](Tables(spark, d))


def _order(by: str) -> Column:
    column, *words = by.split(" ")
    c = F.col(column)
    return (c.desc_nulls_last() if "NULLS" in words else c.desc()) if "DESC" in words else c.asc()


def _top(view: str, order: str, columns: str, where: str = "true", k: int = 20) -> Query:
    """The first ``k`` rows of a read model that meet a condition."""
    return lambda spark, d: _view(view)(spark, d).where(where).orderBy(*map(_order, order.split(", "))).limit(k).select(*columns.split(", "))


#: name -> (view, order, columns, condition, rows); conditions and orders are read by Spark and by DuckDB alike.
LEADERBOARDS: dict[str, tuple[str, str, str, str, int]] = {
    "top_songs_weeks_at_1": ("song_chart_summary", "weeks_at_number_1 DESC, song_id, chart_name, chart_territory", "song_id, chart_name, chart_territory, weeks_at_number_1", "true", 20),
    "chart_songs": ("song_chart_summary", "song_id", "song_id, artist_id, peak_position, total_chart_weeks", "chart_territory = 'ASIA' AND chart_name = '2-HIGH'", 100000),
    "top_songs_peak": ("song_chart_summary", "peak_position, song_id", "song_id, peak_position", "chart_territory = 'GLOBAL' AND chart_name = '1-URGENT'", 50),
    "top_songs_weeks": ("song_chart_summary", "max_weeks_on_chart DESC, song_id", "song_id, max_weeks_on_chart", "chart_territory = 'EUROPE' AND chart_name = '3-MEDIUM'", 50),
    "songs_of_artist": ("song_chart_summary", "song_id, chart_name, chart_territory", "song_id, chart_name, chart_territory, peak_position", "artist_id = 3", 100000),
    "flagged_chart_songs": ("song_chart_summary", "song_id", "song_id, artist_id", "artist_is_afrobeats AND chart_territory = 'AFRICA' AND chart_name = '1-URGENT'", 100000),
    "top_artists_streams": ("artist_stream_summary", "total_streams DESC NULLS LAST, artist_id", "artist_id, artist_name, total_streams", "true", 20),
    "top_artists_daily": ("artist_stream_summary", "daily_streams DESC NULLS LAST, artist_id", "artist_id, daily_streams, total_streams_as_lead", "true", 20),
    "top_flagged_artists": ("artist_stream_summary", "total_streams DESC NULLS LAST, artist_id", "artist_id, total_streams", "is_afrobeats", 20),
    "current_chart": ("chart_latest_leaderboard", "position, chart_week DESC, song_id", "position, song_id, chart_week, trend", "chart_name = '1-URGENT' AND chart_territory = 'ASIA'", 100),
    "current_chart_flagged": ("chart_latest_leaderboard", "position, chart_week DESC, song_id", "position, song_id, artist_id", "is_afrobeats AND chart_name = '1-URGENT' AND chart_territory = 'AFRICA'", 100),
    "current_chart_of_artist": ("chart_latest_leaderboard", "entry_id", "entry_id, position, peak_position, delta", "artist_id = 4", 100000),
    "top_certified": ("artist_certification_summary", "total_platinum_units DESC, total_certifications DESC, artist_id", "artist_id, total_platinum_units, total_certifications", "territory = '1-URGENT' AND body = 'RIAA'", 20),
    "top_certified_flagged": ("artist_certification_summary", "total_certifications DESC, artist_id", "artist_id, total_certifications, gold_count", "is_afrobeats AND territory = '2-HIGH' AND body = 'BPI'", 20),
    "top_momentum_on_date": ("artist_trending_summary", "momentum_score DESC, artist_id", "artist_id, snapshot_date, momentum_score", "snapshot_date = DATE '2024-01-15'", 20),
    "top_artist_growth_on_date": ("artist_growth_summary", "daily_growth DESC NULLS LAST, artist_id", "artist_id, daily_growth, growth_7d", "snapshot_date = DATE '2024-01-15'", 20),
    "top_artist_week_on_date": ("artist_growth_summary", "growth_7d DESC NULLS LAST, artist_id", "artist_id, growth_7d", "is_afrobeats AND snapshot_date = DATE '2024-01-15'", 20),
    "top_song_growth_on_date": ("song_growth_summary", "daily_growth DESC NULLS LAST, song_id", "song_id, daily_growth, growth_7d", "snapshot_date = DATE '2024-01-15'", 20),
    "top_song_momentum_on_date": ("song_trending_summary", "momentum_score DESC, song_id", "song_id, momentum_score", "snapshot_date = DATE '2024-01-15'", 20),
    "top_listeners": ("artist_monthly_listener_summary", "monthly_listeners DESC, artist_id", "artist_id, monthly_listeners, daily_change", "true", 20),
    "top_listener_change": ("artist_monthly_listener_summary", "daily_change DESC NULLS LAST, artist_id", "artist_id, daily_change, origin_country", "true", 20),
    "top_song_streams": ("song_stream_summary", "total_spotify_streams DESC NULLS LAST, song_id", "song_id, song_title, total_spotify_streams", "song_is_afrobeats", 20),
    "top_song_daily": ("song_stream_summary", "daily_streams DESC NULLS LAST, song_id", "song_id, daily_streams", "true", 20),
    "newest_songs": ("song_stream_summary", "release_date DESC NULLS LAST, song_id", "song_id, release_date", "true", 20),
    "songs_of_artist_by_streams": ("song_stream_summary", "total_spotify_streams DESC NULLS LAST, song_id", "song_id, total_spotify_streams", "artist_id = 5", 20),
    "top_chart_artists": ("artist_chart_summary", "total_chart_weeks DESC, best_peak_position, artist_id, chart_name", "artist_id, chart_name, total_chart_weeks, best_peak_position", "role = 'primary' AND chart_territory = 'GLOBAL'", 20),
    "top_featured_artists": ("artist_chart_summary", "weeks_at_number_1 DESC, artist_id, chart_name", "artist_id, chart_name, weeks_at_number_1, distinct_songs_charted", "role = 'feature' AND chart_territory = 'ASIA'", 20),
    "top_recent_artists": ("artist_recent_chart_summary", "top_10s DESC, artist_id, chart_name, chart_territory", "artist_id, chart_name, chart_territory, top_10s", "true", 20),
    "best_recent_artists": ("artist_recent_chart_summary", "best_peak, artist_id, chart_name", "artist_id, chart_name, best_peak", "chart_territory = 'EUROPE'", 20),
}


def _chart_trend(spark: SparkSession, d: str) -> DataFrame:
    return rel.chart_trend(Tables(spark, d)["chart_entries"])


def _by_country(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("origin_country").orderBy(F.col("total_streams").desc_nulls_last(), "artist_id")
    return views.artist_country_summary(Tables(spark, d)).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("origin_country", "rank", "artist_id", "total_streams")


def _career(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    charts = views.artist_chart_summary(t).where("role = 'primary'").groupBy("artist_id").agg(F.sum("total_chart_weeks").alias("chart_weeks"), F.min("best_peak_position").alias("best_peak"), F.sum("weeks_at_number_1").alias("weeks_at_number_1"))
    certs = views.artist_certification_summary(t).groupBy("artist_id").agg(F.sum("total_certifications").alias("certifications"))
    return t["artists"].select(F.col("id").alias("artist_id"), "name").join(views.artist_stream_summary(t).select("artist_id", "total_streams"), "artist_id", "left").join(charts, "artist_id", "left").join(certs, "artist_id", "left").join(views.artist_monthly_listener_summary(t).select("artist_id", "monthly_listeners"), "artist_id", "left")


def _fastest(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    reached = t["song_stats_snapshots"].where("spotify_streams >= 100000").groupBy("song_id").agg(F.min("snapshot_date").alias("reached"))
    s = reached.join(t["songs"].where("release_date is not null").select(F.col("id").alias("song_id"), "title", "release_date"), "song_id")
    return s.select("song_id", "title", F.datediff("reached", "release_date").cast("long").alias("days")).orderBy("days", "song_id").limit(20)


def _words(column: str, source: str, form: Callable, out: str) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/{source}.parquet").select(F.col(column).alias("raw"), form(F.col(column)).alias(out))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["part"].select("p_partkey", parse.units(F.concat(F.col("p_size").cast("string"), F.lit("x Platinum"))).alias("units"), parse.signed_number(F.concat(F.lit("-"), F.format_number("p_retailprice", 0))).alias("signed"), parse.unsigned_number("p_brand").alias("plain"), parse.level(F.col("p_type")).alias("level"))


def _fridays(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["orders"].select("o_orderkey", parse.friday(F.to_date("o_orderdate")).alias("friday"), parse.source_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("day"))


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    ends = Tables(spark, d)["orders"].agg(parse.friday(F.to_date(F.max("o_orderdate"))).alias("hi"), F.to_date(F.min("o_orderdate")).alias("lo"))
    return ends.select(F.explode(F.expr("sequence(hi, lo, interval -7 days)")).alias("friday"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["chart_entries"].select("id", rel.points(F.col("position"), 50).cast("long").alias("points"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["songs"].where("spotify_track_id is not null and (release_date is null or image_url is null)").select("id", "slug")


def _page(spark: SparkSession, d: str) -> DataFrame:
    return rel.keyset_page(Tables(spark, d)["songs"].where("image_url is null").select("id", "title"), "id", 20, 100)


def _two_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = Tables(spark, d)["events"].select(F.col("user_id").alias("artist_id"), F.to_date("ts").alias("snapshot_date"), F.round(F.col("value") * 100).cast("long").alias("daily_streams"), F.lit("load").alias("source"), "event_id")
    old = rel.latest_by(e.where("event_id % 3 <> 0"), ["artist_id", "snapshot_date"], [F.col("event_id").desc()]).drop("event_id")
    return old, e.where("event_id % 3 = 0").withColumn("source", F.lit("again"))


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two_batches(spark, d)
    return rel.upsert(old, new, ["artist_id", "snapshot_date"], ["daily_streams"], seq="event_id")


def _ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two_batches(spark, d)
    return rel.insert_ignore(old, new, ["artist_id", "snapshot_date"], seq="event_id")


def _links(spark: SparkSession, d: str) -> DataFrame:
    found = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_at"))


QUERIES: dict[str, Query] = {
    **{name: _view(name) for name in views.VIEWS},
    "chart_trend": _chart_trend,
    **{name: _top(*spec) for name, spec in LEADERBOARDS.items()},
    "top_artists_by_country": _by_country,
    "artist_career_card": _career,
    "fastest_to_n": _fastest,
    "normalize_name_c": _words("p_name", "part", text.name_c, "name"),
    "normalize_name_a": _words("text", "documents", text.name_a, "name"),
    "normalize_name_b": _words("text", "documents", text.name_b, "name"),
    "normalize_title": _words("text", "documents", text.title_form, "title"),
    "slugs": lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_type", F.lit(" Straße Жар Étoile "), "p_brand", F.lit("%"))).alias("slug")),
    "album_slug": lambda spark, d: Tables(spark, d)["part"].select("p_partkey", text.album_slug(F.concat("p_name", F.lit("'s & "), "p_type"), F.sha2(F.col("p_partkey").cast("string"), 256)).alias("slug")),
    "parse_values": _units,
    "friday_align": _fridays,
    "weekly_dates": _weekly,
    "points_score": _points,
    "enrichment_candidates": _candidates,
    "keyset_page": _page,
    "upsert_snapshot": _upsert,
    "insert_ignore": _ignore,
    "page_links": _links,
    **STORE_QUERIES,
    **CHART_QUERIES, **PERSIST_QUERIES, **REFRESH_QUERIES, **SOURCE_QUERIES,
    **JOB_QUERIES,
}

_A = "a.id AS artist_id, a.name AS artist_name, a.slug AS artist_slug, a.image_url AS artist_image_url"
_G = "coalesce(chart_territory,'GLOBAL')"
_GROWTH = """SELECT {cols}, x.snapshot_date, x.daily_streams, x.{total} AS total_streams, x.daily_streams - y.daily_streams AS daily_growth, x.{total} - z.{total} AS growth_7d
FROM {tab} x {dims} LEFT JOIN {tab} y ON y.{id} = x.{id} AND y.snapshot_date = x.snapshot_date - 1 LEFT JOIN {tab} z ON z.{id} = x.{id} AND z.snapshot_date = x.snapshot_date - 7"""
_AG = _GROWTH.format(cols="a.id AS artist_id, a.name AS artist_name, a.slug AS artist_slug, a.image_url, a.is_afrobeats, a.origin_country", total="total_streams", tab="artist_stats_snapshots", id="artist_id", dims="JOIN artists a ON a.id = x.artist_id")
_SG = _GROWTH.format(cols="s.id AS song_id, s.title AS song_title, s.slug AS song_slug, a.id AS artist_id, a.name AS artist_name, a.slug AS artist_slug", total="spotify_streams", tab="song_stats_snapshots", id="song_id", dims="JOIN songs s ON s.id = x.song_id JOIN artists a ON a.id = s.artist_id")
_MOM = "SELECT *, CAST(coalesce(daily_growth, 0) * {d} + coalesce(growth_7d, 0) * {w} AS DOUBLE) AS momentum_score FROM ({v})"
_LATEST = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY snapshot_date DESC) AS rn FROM {t})"
_BATCH = """WITH e AS (SELECT user_id AS artist_id, CAST(ts AS DATE) AS snapshot_date, CAST(round(value*100) AS BIGINT) AS daily_streams, event_id FROM events),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, snapshot_date ORDER BY event_id DESC) AS rn FROM e WHERE event_id % 3 <> 0) WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, snapshot_date ORDER BY event_id {dir}) AS rn FROM e WHERE event_id % 3 = 0) WHERE rn = 1)
SELECT coalesce(o.artist_id, n.artist_id) AS artist_id, coalesce(o.snapshot_date, n.snapshot_date) AS snapshot_date, coalesce({first}.daily_streams, {then}.daily_streams) AS daily_streams,
 CASE WHEN o.artist_id IS NULL THEN 'again' ELSE 'load' END AS source FROM o FULL JOIN n ON o.artist_id = n.artist_id AND o.snapshot_date = n.snapshot_date"""
_CHARTS = """SELECT {a}, a.is_afrobeats, a.origin_country, chart_name, {g} AS chart_territory, count(DISTINCT chart_week) AS total_chart_weeks, count(DISTINCT c.song_id) AS distinct_songs_charted, min(position) AS best_peak_position,
 count(*) FILTER (WHERE position = 1) AS weeks_at_number_1, count(*) FILTER (WHERE position <= 10) AS weeks_in_top_10, min(chart_week) AS first_chart_appearance, max(chart_week) AS latest_chart_appearance, '{role}' AS role
 FROM {f} GROUP BY ALL"""

_VIEW_SQL: dict[str, str] = {
    "song_chart_summary": f"""SELECT s.id AS song_id, s.title AS song_title, s.slug AS song_slug, s.spotify_track_id, s.is_afrobeats AS song_is_afrobeats, s.release_date, {_A}, a.is_afrobeats AS artist_is_afrobeats, a.origin_country, chart_name, {_G} AS chart_territory,
 min(position) AS peak_position, max(weeks_on_chart) AS max_weeks_on_chart, count(*) AS total_chart_weeks, count(*) FILTER (WHERE position = 1) AS weeks_at_number_1, count(*) FILTER (WHERE position <= 10) AS weeks_in_top_10, count(*) FILTER (WHERE position <= 40) AS weeks_in_top_40, min(chart_week) AS first_charted, max(chart_week) AS last_charted
 FROM chart_entries c JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = c.artist_id GROUP BY ALL""",
    "chart_latest_leaderboard": f"""SELECT c.id AS entry_id, s.id AS song_id, chart_name, territory AS chart_territory, position, peak_position, weeks_on_chart, chart_week, prev_rank, delta, trend, s.title AS song_title, s.slug AS song_slug, s.spotify_track_id, s.image_url AS song_image_url, {_A}, a.is_afrobeats
 FROM (SELECT *, {_G} AS territory, row_number() OVER (PARTITION BY chart_name, {_G}, song_id ORDER BY chart_week DESC, id) AS rn FROM chart_entries) c
 JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = c.artist_id LEFT JOIN chart_entry_snapshots t ON t.entry_id = c.id WHERE rn = 1""",
    "artist_stream_summary": f"SELECT {_A}, total_streams, total_streams_as_lead, total_streams_as_feature, daily_streams, track_count, snapshot_date, a.is_afrobeats, a.origin_country, a.spotify_id, a.popularity FROM {_LATEST.format(k='artist_id', t='artist_stats_snapshots')} x JOIN artists a ON a.id = x.artist_id WHERE rn = 1",
    "song_stream_summary": f"SELECT s.id AS song_id, spotify_streams AS total_spotify_streams, daily_streams, snapshot_date, s.title AS song_title, s.slug AS song_slug, s.spotify_track_id, s.release_date, s.is_afrobeats AS song_is_afrobeats, s.image_url AS song_image_url, {_A}, a.is_afrobeats AS artist_is_afrobeats, a.origin_country FROM {_LATEST.format(k='song_id', t='song_stats_snapshots')} x JOIN songs s ON s.id = x.song_id JOIN artists a ON a.id = s.artist_id WHERE rn = 1",
    "artist_certification_summary": f"""SELECT {_A}, a.is_afrobeats, a.origin_country, territory, body, count(*) AS total_certifications, count(*) FILTER (WHERE level='diamond') AS diamond_count, count(*) FILTER (WHERE level='platinum') AS platinum_count, count(*) FILTER (WHERE level='gold') AS gold_count, count(*) FILTER (WHERE level='silver') AS silver_count,
 CAST(coalesce(sum(units), 0) AS BIGINT) AS total_platinum_units, max(certified_at) AS latest_certification, min(certified_at) AS earliest_certification FROM certifications c JOIN artists a ON a.id = c.artist_id GROUP BY ALL""",
    "artist_chart_summary": _CHARTS.format(a=_A, g=_G, role="primary", f="chart_entries c JOIN artists a ON a.id = c.artist_id") + " UNION ALL " + _CHARTS.format(a=_A, g=_G, role="feature", f="song_features f JOIN artists a ON a.id = f.featured_artist_id JOIN chart_entries c ON c.song_id = f.song_id"),
    "artist_growth_summary": _AG,
    "artist_trending_summary": _MOM.format(d="0.6", w="0.4", v=_AG),
    "song_growth_summary": _SG,
    "song_trending_summary": _MOM.format(d="0.7", w="0.3", v=_SG),
    "artist_country_summary": f"SELECT a.origin_country, a.id AS artist_id, a.name AS artist_name, a.slug AS artist_slug, a.image_url, a.is_afrobeats, total_streams, daily_streams FROM {_LATEST.format(k='artist_id', t='artist_stats_snapshots')} x JOIN artists a ON a.id = x.artist_id WHERE rn = 1",
    "artist_recent_chart_summary": f"SELECT a.id AS artist_id, a.name AS artist_name, a.slug AS artist_slug, a.image_url, a.is_afrobeats, chart_name, {_G} AS chart_territory, count(*) AS chart_entries, count(*) FILTER (WHERE position <= 10) AS top_10s, count(*) FILTER (WHERE position = 1) AS number_1s, min(position) AS best_peak, min(chart_week) AS first_recent_entry, max(chart_week) AS latest_recent_entry FROM chart_entries c JOIN artists a ON a.id = c.artist_id WHERE chart_week >= DATE '2001-11-04' - 90 GROUP BY ALL",
    "artist_monthly_listener_summary": f"SELECT {_A}, x.spotify_id, snapshot_date, monthly_listeners, daily_change, peak_rank, peak_listeners, a.is_afrobeats, a.origin_country FROM {_LATEST.format(k='artist_id', t='artist_monthly_listener_snapshots')} x JOIN artists a ON a.id = x.artist_id WHERE rn = 1",
}


def _topped(view: str, columns: str, order: str, where: str = "true", k: int = 20) -> str:
    return f"SELECT {columns} FROM ({_VIEW_SQL[view]}) WHERE {where} ORDER BY {order} LIMIT {k}"


_OTHER_SQL: dict[str, str] = {
    "chart_trend": """WITH p AS (SELECT id AS entry_id, position, CASE WHEN chart_territory IS NOT NULL THEN lag(position) OVER (PARTITION BY song_id, chart_name, chart_territory ORDER BY chart_week) END AS prev FROM chart_entries)
SELECT entry_id, CAST(prev AS SMALLINT) AS prev_rank, CAST(abs(position - prev) AS SMALLINT) AS delta, CASE WHEN prev IS NULL THEN 'NEW' WHEN position < prev THEN 'UP' WHEN position > prev THEN 'DOWN' ELSE 'SAME' END AS trend FROM p""",
    **{name: _topped(view, columns, order, where, k) for name, (view, order, columns, where, k) in LEADERBOARDS.items()},
    "top_artists_by_country": f"SELECT origin_country, CAST(r AS INTEGER) AS rank, artist_id, total_streams FROM (SELECT *, row_number() OVER (PARTITION BY origin_country ORDER BY total_streams DESC NULLS LAST, artist_id) AS r FROM ({_VIEW_SQL['artist_country_summary']})) WHERE r <= 3",
    "artist_career_card": f"""SELECT a.id AS artist_id, a.name, s.total_streams, c.chart_weeks, c.best_peak, c.weeks_at_number_1, k.certifications, l.monthly_listeners FROM artists a
 LEFT JOIN ({_VIEW_SQL['artist_stream_summary']}) s ON s.artist_id = a.id
 LEFT JOIN (SELECT artist_id, CAST(sum(total_chart_weeks) AS BIGINT) AS chart_weeks, min(best_peak_position) AS best_peak, CAST(sum(weeks_at_number_1) AS BIGINT) AS weeks_at_number_1 FROM ({_VIEW_SQL['artist_chart_summary']}) WHERE role = 'primary' GROUP BY 1) c ON c.artist_id = a.id
 LEFT JOIN (SELECT artist_id, CAST(sum(total_certifications) AS BIGINT) AS certifications FROM ({_VIEW_SQL['artist_certification_summary']}) GROUP BY 1) k ON k.artist_id = a.id
 LEFT JOIN ({_VIEW_SQL['artist_monthly_listener_summary']}) l ON l.artist_id = a.id""",
    "fastest_to_n": "SELECT song_id, title, date_diff('day', s.release_date, reached) AS days FROM (SELECT song_id, min(snapshot_date) AS reached FROM song_stats_snapshots WHERE spotify_streams >= 100000 GROUP BY 1) r JOIN songs s ON s.id = r.song_id WHERE s.release_date IS NOT NULL ORDER BY days, song_id LIMIT 20",
    "normalize_name_c": "SELECT p_name AS raw, regexp_replace(trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g') AS name FROM part",
    "normalize_name_a": r"""SELECT text AS raw, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '\bfeat\b\.?', 'featuring', 'g'), '[^\p{L}\p{N} \t\n\r]', '', 'g'), '\s+', ' ', 'g')) AS name FROM documents""",
    "normalize_name_b": r"""SELECT text AS raw, trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), '&', 'and'), '[''"`’‘]', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM documents""",
    "normalize_title": r"""SELECT text AS raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\(feat[^)]*\)|\(ft[^)]*\)|\[feat[^\]]*\]', '', 'g'), '[^\p{L}\p{N} \t\n\r]', '', 'g'), '\s+', ' ', 'g')) AS title FROM documents""",
    "slugs": """SELECT p_partkey, regexp_replace(lower(p_name), ' +', '-', 'g') || '-and-' || regexp_replace(replace(lower(p_type), '%', 'percent'), '[ -]+', '-', 'g') || '-strasse-zhar-etoile-' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || 'percent' AS slug FROM part""",
    "album_slug": "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(p_name, '''s & ', p_type))), '''', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || left(sha256(CAST(p_partkey AS VARCHAR)), 8) AS slug FROM part",
    "parse_values": "SELECT p_partkey, CAST(p_size AS BIGINT) AS units, -CAST(round_even(p_retailprice, 0) AS BIGINT) AS signed, CAST(coalesce(nullif(regexp_replace(p_brand, '[^0-9]', '', 'g'), ''), '0') AS BIGINT) AS plain, CASE WHEN lower(p_type) LIKE '%diamond%' THEN 'diamond' WHEN lower(p_type) LIKE '%platinum%' THEN 'platinum' WHEN lower(p_type) LIKE '%gold%' THEN 'gold' WHEN lower(p_type) LIKE '%silver%' THEN 'silver' ELSE lower(p_type) END AS level FROM part",
    "friday_align": "SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 2) % 7 AS INTEGER) AS friday, CAST(o_orderdate AS DATE) AS day FROM orders",
    "weekly_dates": "WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) - CAST((dayofweek(max(o_orderdate)) + 2) % 7 AS INTEGER) AS hi, CAST(min(o_orderdate) AS DATE) AS lo FROM orders) SELECT hi - CAST(7 * i AS INTEGER) AS friday FROM (SELECT hi, lo, unnest(range(0, (hi - lo) // 7 + 1)) AS i FROM e)",
    "points_score": "SELECT id, CASE WHEN position BETWEEN 1 AND 50 THEN CAST(51 - position AS BIGINT) ELSE 0 END AS points FROM chart_entries",
    "enrichment_candidates": "SELECT id, slug FROM songs WHERE spotify_track_id IS NOT NULL AND (release_date IS NULL OR image_url IS NULL)",
    "keyset_page": "SELECT id, title FROM songs WHERE image_url IS NULL AND id > 20 ORDER BY id LIMIT 100",
    "upsert_snapshot": _BATCH.format(dir="DESC", first="n", then="o"),
    "insert_ignore": _BATCH.format(dir="ASC", first="o", then="n"),
    "page_links": "SELECT page_id, href, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_at FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)) GROUP BY page_id, href",
}
SQL: dict[str, str] = {k: with_fixtures(v) for k, v in (_VIEW_SQL | _OTHER_SQL).items()} | STORE_SQL | CHART_SQL | PERSIST_SQL | refresh_sql(_VIEW_SQL) | SOURCE_SQL | JOB_SQL
