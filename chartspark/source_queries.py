"""Queries of the readers over pages and documents that are made from the test tables, and what they must find, in SQL.

Each page is put together from rows of the music model, as its site writes them; the reader takes it apart again. The SQL
never sees a page: it states the rows that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators import jobs
from chartspark.plans.fixtures import Tables, with_fixtures
from chartspark.sources import documents, pages

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of pages: ``page`` (what one page holds together), ``seq`` and the values in a row.
CHART = """
SELECT concat(chart_name, '/', chart_territory, '/', CAST(chart_week AS VARCHAR(20))) AS page, CAST(chart_week AS VARCHAR(20)) AS day, position AS seq, a.name AS artist, a.spotify_id,
 s.title AS title, s.id % 3 AS form, CAST(s.id % 7 AS VARCHAR(20)) AS guest
FROM chart_entries c JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = s.artist_id WHERE chart_territory IS NOT NULL"""
LISTENERS = """
SELECT CAST(snapshot_date AS VARCHAR(20)) AS page, l.artist_id AS seq, l.spotify_id, a.name, monthly_listeners, daily_change, l.artist_id % 90 + 1 AS peak_rank, peak_listeners
FROM artist_monthly_listener_snapshots l JOIN artists a ON a.id = l.artist_id"""
TOTALS = """
SELECT concat(CAST(artist_id AS VARCHAR(20)), '/', CAST(snapshot_date AS VARCHAR(20))) AS page, a.name, replace(CAST(snapshot_date AS VARCHAR(20)), '-', '/') AS updated, snapshot_date, total_streams, total_streams_as_lead,
 coalesce(total_streams_as_feature, 0) AS total_streams_as_feature, daily_streams, track_count FROM artist_stats_snapshots t JOIN artists a ON a.id = t.artist_id"""
SONGS = "SELECT CAST(artist_id AS VARCHAR(20)) AS page, id AS seq, title, spotify_track_id, id * 1234 AS streams, id * 7 AS daily, (id % 4 = 1) AS featured FROM songs"
AWARDS = """
SELECT CAST(artist_id AS VARCHAR(20)) AS page, song_id AS seq, territory, title, level, units, CASE level WHEN 'platinum' THEN CASE WHEN song_id % 2 = 0 THEN 1 ELSE CAST(units AS INT) END END AS shown
FROM certifications WHERE artist_id IS NOT NULL AND level <> 'silver'"""
WEEKLY = """
SELECT CAST(chart_week AS VARCHAR(20)) AS page, position AS seq, s.id % 3 AS form, a.name AS artist, s.title AS title, peak_position AS peak, CASE WHEN s.id % 2 = 0 THEN weeks_on_chart END AS weeks
FROM chart_entries c JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = s.artist_id WHERE chart_territory = 'EUROPE'  AND chart_name = '2-HIGH'"""
ARTISTS = "SELECT id, spotify_id, name, image_url, popularity FROM artists"
SEARCHES = "SELECT id, name, CASE WHEN id % 4 = 0 THEN 50 ELSE 90 END AS score, CASE WHEN id % 3 = 0 THEN upper(name) ELSE concat('Not ', name) END AS other, CASE WHEN id % 5 = 0 THEN 'X' ELSE 'ng' END AS code FROM artists"


def _page(rows: DataFrame, row: str, head: str = "''", tail: str = "''", order: str = "seq") -> DataFrame:
    """``url, html``: the rows of each page (SQL of one row, of what is before and after) in order."""
    made = rows.selectExpr("page", f"{order} AS seq", f"{row} AS row", f"{head} AS head", f"{tail} AS tail")
    g = made.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "row"))).alias("rows"), F.first("head").alias("head"), F.first("tail").alias("tail"))
    return g.select(F.col("page").alias("url"), F.concat("head", F.array_join(F.transform("rows", lambda x: x["row"]), ""), "tail").alias("html"))


_CREDIT = """CASE form WHEN 0 THEN concat(artist, ' - ', title, ' (feat. G', guest, ' &amp; H)') WHEN 1 THEN concat('<a>', artist, '</a> <a>', title, '</a>') ELSE concat(artist, '&nbsp; - ', title) END"""


def _chart_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).sql(CHART)
    return _page(rows, f"concat('<tr><td>', seq, '.</td><td>', {_CREDIT}, '</td></tr>')", "concat('<h1>Chart - ', day, ' | x</h1><table><tr><td>as of today</td></tr><tr><th>Pos</th><th>Artist and Title</th></tr>')", "'<tr><td>-</td><td>none - none</td></tr></table>'")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    out = pages.daily_chart(_chart_pages(spark, d), limit=20)
    return out.select("url", "page_date", "rank", "artist", "title", F.array_join("featured", "|").alias("featured"))


def _link_pages(spark: SparkSession, d: str) -> DataFrame:
    return _page(Tables(spark, d).sql(CHART), """concat('<a href="/spotify/artist/', spotify_id, '.html">', CASE WHEN seq % 2 = 0 THEN '' ELSE artist END, '</a><a href="/about.html">', artist, '</a>')""")


def _listener_pages(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: f"format_number({c}, 0)"
    row = f"""concat('<tr><td>', seq, '<td><a href="artist/', spotify_id, '_songs.html">', name, '</a><td>', {number('monthly_listeners')}, '<td>', coalesce({number('daily_change')}, ''), '<td>', peak_rank, '<td>', {number('peak_listeners')}, '</tr>')"""
    return _page(Tables(spark, d).sql(LISTENERS), row, "'<table>'", "'</table>'")


def _listeners(spark: SparkSession, d: str) -> DataFrame:
    return pages.listener_page(_listener_pages(spark, d)).drop("seq")


def _discovered(spark: SparkSession, d: str) -> DataFrame:
    found = pages.discover_all(_link_pages(spark, d), _listener_pages(spark, d))
    return jobs.merge_discovered(found).drop("seq")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    body = """concat('<body><h1>', name, ' - Spotify Top Songs</h1>Last updated: ', updated, '<table><tr><td>Streams<td>', format_number(total_streams, 0), '<td>', total_streams_as_lead, '<td>1<td>', total_streams_as_feature,
 '</tr><tr><td>Daily<td>', daily_streams, '<td>2<td>3<td>4</tr><tr><td>Tracks<td>', track_count, '<td><td><td></tr></table></body>')"""
    return pages.artist_totals(Tables(spark, d).sql(TOTALS).selectExpr("page AS url", f"{body} AS html"))


def _song_totals(spark: SparkSession, d: str) -> DataFrame:
    row = """concat('<tr><td>', CASE WHEN featured THEN '* ' ELSE '' END, '<a href="https://open.spotify.com/track/', spotify_track_id, '">', title, '</a><td>', format_number(streams, 0), '<td>', daily, '</tr>')"""
    return pages.song_totals(_page(Tables(spark, d).sql(SONGS), row, "'<table></table><table>'", "'</table>'")).drop("seq")


def _awards(spark: SparkSession, d: str) -> DataFrame:
    share = "concat('earned RIAA ', CASE WHEN level = 'platinum' AND seq % 2 = 1 THEN concat(shown, 'x Platinum') ELSE initcap(level) END, ' Award for Gold')"
    row = f"""concat('<tr class="table_award_row" id="default_', seq, territory, '"><td class="artists_cell">A', page, '</td><td class="others_cell">', title, '</td><td class="others_cell">May 1, 2020</td><td class="others_cell">L</td>
<td class="format_cell">SINGLE MORE DETAILS</td><td><i class="share_text" data-share-desc="', {share}, '"></i></td></tr>')"""
    return pages.award_rows(_page(Tables(spark, d).sql(AWARDS), row, "'<table>'", "'</table>'", "struct(seq, territory)")).drop("seq")


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    more = """concat('<i class="peak">Peak: ', peak, '</i>', coalesce(concat('<i class="weeks">', weeks, '</i>'), ''))"""
    row = f"""CASE form WHEN 0 THEN concat('<div class="chart-item"><b class="position">', seq, '</b><h3>New ', upper(title), '</h3><p> </p><p>', artist, '</p>', {more}, '</div>')
 WHEN 1 THEN concat('<li data-chart-position="', seq, '"><span class="title">', title, '</span><span class="artist">', upper(title), ' ', artist, '</span>', {more}, '</li>')
 ELSE concat('<article><b class="chart-key">No. ', seq, '</b><h4>', title, '</h4><p>', artist, '</p>', {more}, '</article>') END"""
    return pages.weekly_chart(_page(Tables(spark, d).sql(WEEKLY), row)).drop("seq")


def _bodies(rows: DataFrame, field: str, item: str, size: int = 50) -> DataFrame:
    """Documents with a list of ``size`` items each, in the order of ids."""
    made = rows.selectExpr(f"id DIV {size} AS page", f"{item} AS x")
    return made.groupBy("page").agg(F.to_json(F.struct(F.collect_list("x").alias(field))).alias("body"))


def _artist_documents(spark: SparkSession, d: str) -> DataFrame:
    item = "named_struct('id', spotify_id, 'name', name, 'images', CASE WHEN image_url IS NOT NULL THEN array(named_struct('url', image_url)) END, 'popularity', popularity, 'followers', named_struct('total', id * 9), 'genres', array('pop', concat('g', id % 3)))"
    return documents.artists(_bodies(Tables(spark, d).sql(ARTISTS), "artists", item)).withColumn("genres", F.array_join("genres", "|"))


def _track_documents(spark: SparkSession, d: str) -> DataFrame:
    item = "named_struct('id', spotify_track_id, 'name', title, 'duration_ms', int(id % 300 * 1000), 'explicit', id % 2 = 0, 'album', CASE WHEN id % 5 > 0 THEN named_struct('id', concat('alb', id % 40), 'name', concat('Album ', id % 40), 'release_date', '2020-01-01', 'total_tracks', 9) END)"
    return documents.tracks(_bodies(Tables(spark, d)["songs"], "tracks", item))


def _week_documents(spark: SparkSession, d: str) -> DataFrame:
    item = "named_struct('song', title, 'artist', artist, 'this_week', seq, 'peak_position', peak, 'weeks_on_chart', weeks)"
    made = Tables(spark, d).sql(WEEKLY).selectExpr("page AS chart_week", f"{item} AS x").groupBy("chart_week").agg(F.to_json(F.struct(F.collect_list("x").alias("data"))).alias("body"))
    return documents.weekly_entries(made)


def _dates(spark: SparkSession, d: str) -> DataFrame:
    days = Tables(spark, d).sql("SELECT DISTINCT CAST(chart_week AS VARCHAR(20)) AS day, year(chart_week) AS y FROM chart_entries")
    return documents.chart_dates(days.groupBy("y").agg(F.to_json(F.collect_list("day")).alias("body")), "1994-01-01", "1996-12-31")


def _origins(spark: SparkSession, d: str) -> DataFrame:
    first, last = "named_struct('name', other, 'score', string(score), 'country', code)", "named_struct('name', name, 'score', '40', 'country', 'ZZ')"
    return documents.origin_country(Tables(spark, d).sql(SEARCHES).selectExpr("name", f"to_json(named_struct('artists', array({last}, {first}, {last}))) AS body"))


QUERIES: dict[str, Query] = {
    "landed_daily_chart": _daily,
    "landed_chart_artists": lambda spark, d: pages.discovered_on_charts(_link_pages(spark, d)).drop("seq"),
    "landed_listeners": _listeners,
    "landed_discovery": _discovered,
    "landed_artist_totals": _totals,
    "landed_song_totals": _song_totals,
    "landed_awards": _awards,
    "landed_weekly_chart": _weekly,
    "landed_artist_documents": _artist_documents,
    "landed_track_documents": _track_documents,
    "landed_week_documents": _week_documents,
    "landed_chart_dates": _dates,
    "landed_origins": _origins,
}

_SQL: dict[str, str] = {
    "landed_daily_chart": f"""SELECT page AS url, CAST(day AS DATE) AS page_date, seq AS rank, artist, title, CASE WHEN form = 0 THEN 'G' || guest || '|H' ELSE '' END AS featured
FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq) AS n FROM ({CHART})) WHERE n <= 20""",
    "landed_chart_artists": f"SELECT DISTINCT page AS url, spotify_id, artist AS name FROM ({CHART}) WHERE seq % 2 = 1",
    "landed_listeners": f"SELECT page AS url, spotify_id, name, monthly_listeners, daily_change, CAST(peak_rank AS INTEGER) AS peak_rank, peak_listeners FROM ({LISTENERS})",
    "landed_discovery": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY spotify_id ORDER BY page) AS n, count(*) OVER (PARTITION BY spotify_id) AS c FROM ({LISTENERS})),
k AS (SELECT spotify_id, min(artist) AS name, count(DISTINCT page) AS c FROM ({CHART}) WHERE seq % 2 = 1 GROUP BY spotify_id)
SELECT coalesce(k.spotify_id, l.spotify_id) AS spotify_id, coalesce(k.name, l.name) AS name, CAST(coalesce(k.c, 0) + coalesce(l.c, 0) AS BIGINT) AS appeared, monthly_listeners, daily_change, CAST(peak_rank AS INTEGER) AS peak_rank, peak_listeners
FROM k FULL JOIN (SELECT * FROM l WHERE n = 1) l ON l.spotify_id = k.spotify_id""",
    "landed_artist_totals": f"""SELECT page AS url, name AS artist_name, snapshot_date AS source_updated_at, total_streams, total_streams_as_lead, CAST(1 AS BIGINT) AS total_streams_solo, total_streams_as_feature, daily_streams, CAST(2 AS BIGINT) AS daily_streams_as_lead,
 CAST(4 AS BIGINT) AS daily_streams_as_feature, track_count FROM ({TOTALS})""",
    "landed_song_totals": f"SELECT page AS url, spotify_track_id AS track_id, title, streams AS spotify_streams, daily AS daily_streams, featured AS is_feature FROM ({SONGS})",
    "landed_awards": f"SELECT page AS url, seq || territory AS riaa_id, 'A' || page AS artist, title, level, shown AS units, 'May 1, 2020' AS certified_at, 'L' AS label, 'SINGLE' AS format FROM ({AWARDS})",
    # The source takes "new" and "re" off the front of any title, of "red" too; in form 0 it takes the "New" that the page adds.
    "landed_weekly_chart": f"""WITH w AS (SELECT *, CASE WHEN form = 0 THEN title ELSE trim(regexp_replace(title, '^(new|re)', '')) END AS bare FROM ({WEEKLY}))
SELECT page AS url, seq AS position, array_to_string(list_transform(string_split(bare, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS song, artist, peak AS peak_position, weeks AS weeks_on_chart FROM w""",
    "landed_artist_documents": f"SELECT spotify_id, name, image_url, id * 9 AS followers, popularity, 'pop|g' || id % 3 AS genres FROM ({ARTISTS})",
    "landed_track_documents": """SELECT spotify_track_id, title, CASE WHEN id % 5 > 0 THEN 'alb' || id % 40 ELSE '' END AS spotify_album_id, CASE WHEN id % 5 > 0 THEN 'Album ' || id % 40 ELSE '' END AS album_name, CASE WHEN id % 5 > 0 THEN '2020-01-01' ELSE '' END AS release_date,
 'album' AS album_type, CAST(NULL AS VARCHAR) AS album_image_url, CASE WHEN id % 5 > 0 THEN 9 ELSE 0 END AS total_tracks, CAST(id % 300 * 1000 AS INTEGER) AS duration_ms, id % 2 = 0 AS explicit FROM songs""",
    "landed_week_documents": f"SELECT page AS chart_week, title AS song, artist, seq AS this_week, peak AS peak_position, weeks AS weeks_on_chart FROM ({WEEKLY})",
    "landed_chart_dates": "SELECT DISTINCT CAST(chart_week AS VARCHAR) AS chart_week FROM chart_entries WHERE CAST(chart_week AS VARCHAR) BETWEEN '1994-01-01' AND '1996-12-31'",
    "landed_origins": f"SELECT name, CASE WHEN (id % 3 = 0 OR score >= 95) AND code = 'ng' THEN 'NG' END AS origin_country FROM ({SEARCHES})",
}
SQL: dict[str, str] = {k: with_fixtures(v) for k, v in _SQL.items()}
