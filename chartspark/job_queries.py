"""Queries of the jobs over batches derived from the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.functions import parse
from chartspark.operators import jobs, store
from chartspark.plans.fixtures import Tables, with_fixtures
from chartspark.store_queries import ROWS

Query = Callable[[SparkSession, str], DataFrame]
DAY = "2024-03-01"
#: Artists whose slug is that of their neighbour's name, some under another name: a profile's name and slug point to different ones.
SEED_ARTISTS = f"""SELECT id, CASE WHEN id % 6 = 5 THEN concat(name, ' Jr') ELSE name END AS name, concat('supplier-', lpad(CAST(id + 1 AS VARCHAR(20)), 9, '0')) AS slug,
 CASE WHEN id % 4 = 1 THEN NULL ELSE spotify_id END AS spotify_id FROM ({ROWS['artist_rows']})"""

ARTIST_METADATA = "SELECT concat(name, ' & The Band') AS name, spotify_id, image_url, popularity FROM artists WHERE id % 3 > 0"
#: Batches as the sources land them. Names of profiles repeat in other casing; some ids are unknown.
BATCHES: dict[str, str] = {
    "found": """SELECT event_id AS seq, concat('sp', user_id) AS spotify_id, CASE WHEN user_id % 2 = 0 THEN concat('Supplier#', lpad(CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 40 ELSE user_id % 130 END AS VARCHAR(20)), 9, '0')) ELSE concat('SUPPLIER  ', lpad(CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 40 ELSE user_id % 130 END AS VARCHAR(20)), 9, '0')) END AS name, CAST(user_id % 3 AS INT) AS appeared,
 CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) END AS monthly_listeners, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS BIGINT) END AS daily_change, CAST(event_id % 90 AS INT) AS peak_rank, CAST(event_id AS BIGINT) AS peak_listeners FROM events""",
    "totals": "SELECT concat('sp', CAST(id AS VARCHAR(20))) AS spotify_id, CASE WHEN id % 6 = 1 THEN 404 WHEN id % 6 = 2 THEN 500 ELSE 200 END AS status, id * 1000 AS total_streams, id * 10 AS daily_streams, CAST(id % 30 AS INT) AS track_count, CASE WHEN id % 5 = 0 THEN '2024/02/29' ELSE 'soon' END AS updated FROM artists WHERE id % 7 <> 6",
    "song_pages": "SELECT s.id AS seq, concat('sp', CAST(s.artist_id AS VARCHAR(20))) AS spotify_id, CASE WHEN s.id % 2 = 0 THEN concat('trk', CAST(s.id AS VARCHAR(20))) ELSE concat('new', CAST(s.id AS VARCHAR(20))) END AS track_id, CASE WHEN s.id % 5 = 0 THEN concat('Unheard ', s.title) ELSE upper(s.title) END AS title, s.id * 5 AS streams, s.id AS daily FROM songs s",
    "metadata": """SELECT artist_id, spotify_track_id, concat(title, ' (feat. X)') AS title, DATE '2022-01-01' AS release_date, 1000 AS duration_ms, true AS explicit, 'm.png' AS image_url, CASE WHEN id % 5 > 0 THEN concat('alb', CAST(id % 250 AS VARCHAR(20))) END AS spotify_album_id,
 concat('Album ', CAST(id % 250 AS VARCHAR(20))) AS album_title, CASE WHEN id % 2 = 0 THEN 'single' END AS album_type, 9 AS total_tracks FROM songs""",
    "awards": """SELECT id AS seq, artist_id, CASE WHEN id % 3 = 0 THEN concat(title, ' unknown') ELSE upper(title) END AS title, CASE id % 4 WHEN 0 THEN 'Multi-Platinum' WHEN 1 THEN 'GOLD' WHEN 2 THEN 'Diamond Award' ELSE 'Latin' END AS level, CASE WHEN id % 2 = 0 THEN concat(CAST(id % 9 AS VARCHAR(20)), 'x Platinum') END AS units,
 CASE id % 3 WHEN 0 THEN 'January 5, 2024' WHEN 1 THEN '2023-12-31' ELSE 'n/a' END AS certified_at FROM songs""",
    "origins": "SELECT name, CASE id % 3 WHEN 0 THEN ' ng ' WHEN 1 THEN 'GBR' ELSE 'us' END AS country FROM artists",
}


def _batch(t: Tables, name: str) -> DataFrame:
    return t.sql(BATCHES[name])


def _on() -> F.Column:
    return F.lit(DAY).cast("date")


def _seed(part: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        found = jobs.unique_discovered(jobs.merge_discovered(_batch(t, "found")))
        rows = found.withColumn("seq", F.expr("cast(substr(spotify_id, 3) as bigint)"))
        return jobs.seed(rows, t.sql(SEED_ARTISTS), _on())[part]

    return run


def _report(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.duplicate_report(jobs.merge_discovered(_batch(Tables(spark, d), "found")))
    return out.withColumn("rejected", F.array_join(F.transform("rejected", lambda x: F.concat_ws(":", x["spotify_id"], x["appeared"].cast("string"))), "|"))


def _sync(i: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        return jobs.listener_sync(jobs.unique_discovered(jobs.merge_discovered(_batch(t, "found"))), t.sql(ROWS["artist_rows"]), _on())[i]

    return run


def _totals(i: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        return jobs.artist_snapshots(t.sql(ROWS["artist_rows"]), _batch(t, "totals"), _on())[i]

    return run


def _song_days(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return jobs.song_snapshots(t.sql(ROWS["artist_rows"]), t["songs"], _batch(t, "song_pages"), _on())


def _enriched(i: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        songs, albums, batch = t["songs"], t.sql(ROWS["album_rows"]), _batch(t, "metadata")
        made, patches = jobs.enriched_songs(songs, albums, batch)
        return made if i == 0 else patches

    return run


def _header(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d)["orders"]
    zone = F.element_at(F.array(*map(F.lit, [*parse.ZONES, "PST"])), (F.col("o_orderkey") % 8 + 1).cast("int"))
    heading = F.concat(F.lit("Chart - "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30  "), zone)
    meta = parse.header_meta(heading, _on())
    return o.select("o_orderkey", meta["chart_date"].alias("chart_date"), F.date_format(meta["page_time"], "yyyy-MM-dd HH:mm").alias("page_time"))


def _progress(nothing: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = Tables(spark, d)["orders"]
        return o.select("o_orderkey", store.progress(F.col("o_orderkey") % 70, F.col("o_orderkey") % 71, nothing).cast("long").alias("percent"))

    return run


QUERIES: dict[str, Query] = {
    "discovery_merge": lambda spark, d: jobs.unique_discovered(jobs.merge_discovered(_batch(Tables(spark, d), "found"))),
    "discovery_duplicates": _report,
    "listener_sync": _sync(0),
    "listener_sync_counts": _sync(1),
    "seed_routes": lambda spark, d: _seed("routes")(spark, d).withColumn("artist_id", F.when(F.col("route") != "create", F.col("artist_id"))),
    "seed_linked": _seed("linked"),
    "seed_created": _seed("created"),
    "seed_external_ids": _seed("external"),
    "seed_snapshots": _seed("snapshots"),
    "artist_snapshot_job": _totals(0),
    "artist_snapshot_unknown": _totals(1),
    "artist_snapshot_counts": _totals(2),
    "song_snapshot_job": _song_days,
    "enriched_albums": _enriched(0),
    "enriched_songs": _enriched(1),
    "enriched_artists": lambda spark, d: jobs.enriched_artists(Tables(spark, d).sql(ARTIST_METADATA)),
    "certification_job": lambda spark, d: (lambda t: jobs.certified_rows(_batch(t, "awards"), t["songs"]))(Tables(spark, d)),
    "origin_job": lambda spark, d: (lambda t: jobs.origin_patches(t.sql(ROWS["artist_rows"]), _batch(t, "origins")))(Tables(spark, d)),
    "lost_references": lambda spark, d: (lambda t: jobs.validated(t["song_stats_snapshots"], "song_id", t["songs"].where("id % 3 > 0")).select("song_id", "snapshot_date"))(Tables(spark, d)),
    "header_meta": _header,
    "job_progress": _progress(100),
    "artist_job_progress": _progress(0),
    "job_counters": lambda spark, d: store.counters(Tables(spark, d)["events"].select((F.col("event_type") == "view").alias("ok"))),
}

_FOUND = f"""WITH found AS ({BATCHES['found']}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id ORDER BY seq) AS n FROM found WHERE monthly_listeners IS NOT NULL) WHERE n = 1),
m AS (SELECT f.spotify_id, arg_min(f.name, f.seq) AS name, min(f.seq) AS seq, CAST(sum(greatest(f.appeared, 1)) AS BIGINT) AS appeared FROM found f GROUP BY f.spotify_id),
g AS (SELECT m.*, l.monthly_listeners, l.daily_change, l.peak_rank, l.peak_listeners, regexp_replace(trim(regexp_replace(lower(m.name), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g') AS normalized FROM m LEFT JOIN l USING (spotify_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY appeared DESC, seq) AS place FROM g),
u AS (SELECT * FROM p WHERE place = 1), artist_rows AS ({ROWS['artist_rows']}) """
_LAST = "monthly_listeners, daily_change, peak_rank, peak_listeners"
_B = "trim(regexp_replace(regexp_replace(replace(lower({c}), '&', 'and'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_A = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_SLUG = "regexp_replace(trim(regexp_replace(replace(lower(trim(regexp_replace({c}, ' +', ' ', 'g'))), '&', 'and'), '[^a-z0-9 -]', '', 'g')), '[ -]+', '-', 'g')"
#: The route of each profile: by spotify id, else by normal form B of the name, else by slug.
_ROUTED = _FOUND + f""", seed_artists AS ({SEED_ARTISTS}),
k AS (SELECT u.*, CAST(substr(u.spotify_id, 3) AS BIGINT) AS at_, {_SLUG.format(c='u.name')} AS slug, {_B.format(c='u.name')} AS nb FROM u),
known AS (SELECT spotify_id, min(CAST(id AS VARCHAR)) AS id FROM seed_artists WHERE spotify_id IS NOT NULL GROUP BY 1),
by_name AS (SELECT {_B.format(c='name')} AS nb, min({{'i': CAST(id AS VARCHAR), 'has': spotify_id IS NOT NULL}}) AS hit FROM seed_artists GROUP BY 1),
by_slug AS (SELECT slug, min({{'i': CAST(id AS VARCHAR), 'has': spotify_id IS NOT NULL}}) AS hit FROM seed_artists GROUP BY 1),
r AS (SELECT k.*, known.id AS known_id, coalesce(by_name.hit, by_slug.hit) AS hit FROM k LEFT JOIN known USING (spotify_id) LEFT JOIN by_name ON by_name.nb = k.nb LEFT JOIN by_slug ON by_slug.slug = k.slug),
z AS (SELECT *, CASE WHEN known_id IS NOT NULL THEN 'known' WHEN hit IS NULL THEN 'create' WHEN hit.has THEN 'drop' ELSE 'link' END AS route FROM r),
y AS (SELECT *, coalesce(known_id, CASE WHEN route = 'link' THEN hit.i END) AS artist_id, CASE WHEN route = 'create' AND slug <> '' THEN sha256(slug) END AS new_id FROM z) """
_TRACK = "spotify_id IS NOT NULL AND (kworb_status IS NULL OR kworb_status <> 'not_found') AND entity_status <> 'merged'"
_TOTALS = f"WITH artist_rows AS ({ROWS['artist_rows']}), totals AS ({BATCHES['totals']}), m AS (SELECT a.id AS artist_id, t.* FROM artist_rows a LEFT JOIN totals t ON t.spotify_id = a.spotify_id WHERE a.{_TRACK.replace('(kworb', '(a.kworb').replace('OR kworb', 'OR a.kworb').replace('AND entity', 'AND a.entity')}) "
_META = f"WITH metadata AS ({BATCHES['metadata']}), album_rows AS ({ROWS['album_rows']}) "
_SQL: dict[str, str] = {
    "discovery_merge": _FOUND + f"SELECT spotify_id, name, appeared, {_LAST} FROM u",
    "discovery_duplicates": _FOUND + "SELECT normalized, min(spotify_id) FILTER (WHERE place = 1) AS kept_id, min(name) FILTER (WHERE place = 1) AS kept_name, string_agg(spotify_id || ':' || appeared, '|' ORDER BY place) FILTER (WHERE place > 1) AS rejected FROM p GROUP BY normalized HAVING count(*) > 1",
    "listener_sync": _FOUND + f"SELECT a.id AS artist_id, spotify_id, DATE '{DAY}' AS snapshot_date, {_LAST} FROM u JOIN (SELECT spotify_id, min(id) AS id FROM artist_rows WHERE spotify_id IS NOT NULL GROUP BY 1) a USING (spotify_id) WHERE monthly_listeners IS NOT NULL",
    "listener_sync_counts": _FOUND + "SELECT count(*) FILTER (WHERE a.spotify_id IS NOT NULL AND monthly_listeners IS NOT NULL) AS updated, count(*) FILTER (WHERE a.spotify_id IS NULL) AS not_found, count(*) FILTER (WHERE a.spotify_id IS NOT NULL AND monthly_listeners IS NULL) AS no_data FROM u LEFT JOIN (SELECT DISTINCT spotify_id FROM artist_rows) a ON a.spotify_id = u.spotify_id",
    "seed_routes": _ROUTED + "SELECT at_ AS seq, spotify_id, name, route, artist_id FROM y",
    "seed_linked": _ROUTED + "SELECT artist_id AS id, arg_min(spotify_id, at_) AS spotify_id FROM y WHERE route = 'link' GROUP BY artist_id",
    "seed_created": _ROUTED + "SELECT new_id AS id, arg_min(name, at_) AS name, slug, arg_min(spotify_id, at_) AS spotify_id FROM y WHERE new_id IS NOT NULL GROUP BY ALL",
    "seed_external_ids": _ROUTED + ", c AS (SELECT new_id, arg_min(spotify_id, at_) AS external_id FROM y WHERE new_id IS NOT NULL GROUP BY new_id) SELECT new_id AS artist_id, unnest(['spotify', 'kworb']) AS source, external_id FROM c",
    "seed_snapshots": _ROUTED + f"SELECT coalesce(artist_id, new_id) AS artist_id, spotify_id, DATE '{DAY}' AS snapshot_date, {_LAST} FROM y WHERE coalesce(artist_id, new_id) IS NOT NULL AND monthly_listeners IS NOT NULL",
    "artist_snapshot_job": _TOTALS + f"SELECT artist_id, DATE '{DAY}' AS snapshot_date, total_streams, daily_streams, track_count, CASE WHEN updated = '2024/02/29' THEN DATE '2024-02-29' END AS source_updated_at FROM m WHERE status = 200",
    "artist_snapshot_unknown": _TOTALS + "SELECT artist_id AS id FROM m WHERE status = 404",
    "artist_snapshot_counts": _TOTALS + "SELECT count(*) FILTER (WHERE status = 200) AS succeeded, count(*) FILTER (WHERE status IS NULL OR status <> 200) AS failed FROM m",
    "song_snapshot_job": f"""WITH artist_rows AS ({ROWS['artist_rows']}), pages AS ({BATCHES['song_pages']}), q AS (SELECT p.*, CAST(a.id AS VARCHAR) AS artist_id, a.slug AS artist_slug FROM pages p JOIN artist_rows a ON a.spotify_id = p.spotify_id WHERE a.{_TRACK.replace('(kworb', '(a.kworb').replace('OR kworb', 'OR a.kworb').replace('AND entity', 'AND a.entity')}),
 tr AS (SELECT spotify_track_id, min(CAST(id AS VARCHAR)) AS id FROM songs GROUP BY 1), ti AS (SELECT CAST(artist_id AS VARCHAR) AS artist_id, lower(title) AS t, min(CAST(id AS VARCHAR)) AS id FROM songs GROUP BY 1, 2),
 s AS (SELECT q.*, coalesce(tr.id, ti.id, sha256(q.artist_slug || '-' || replace(lower(q.title), ' ', '-'))) AS song_id, CASE WHEN tr.id IS NOT NULL THEN 'track' WHEN ti.id IS NOT NULL THEN 'title' ELSE 'created' END AS matched_by FROM q LEFT JOIN tr ON tr.spotify_track_id = q.track_id LEFT JOIN ti ON ti.artist_id = q.artist_id AND ti.t = lower(q.title))
 SELECT song_id, DATE '{DAY}' AS snapshot_date, streams AS spotify_streams, daily AS daily_streams, matched_by FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY seq DESC) AS n FROM s WHERE song_id IS NOT NULL) WHERE n = 1""",
    "enriched_albums": _META + """SELECT coalesce(CAST(a.id AS VARCHAR), sha256(m.spotify_album_id)) AS id, m.artist_id, m.spotify_album_id, m.album_title AS title, coalesce(a.slug, regexp_replace(lower(m.album_title), '[^a-z0-9]+', '-', 'g') || '-' || left(m.spotify_album_id, 8)) AS slug, coalesce(m.album_type, 'album') AS album_type, m.release_date, m.image_url, m.total_tracks
 FROM (SELECT *, row_number() OVER (PARTITION BY spotify_album_id ORDER BY spotify_track_id DESC) AS n FROM metadata WHERE spotify_album_id IS NOT NULL) m LEFT JOIN album_rows a ON a.spotify_album_id = m.spotify_album_id WHERE m.n = 1""",
    "enriched_songs": _META + """SELECT s.id, m.artist_id, CASE WHEN m.spotify_album_id IS NOT NULL THEN coalesce(CAST(a.id AS VARCHAR), sha256(m.spotify_album_id)) END AS album_id, m.title, lower(s.title) AS normalized_title, m.title AS canonical_title, m.spotify_track_id, m.release_date, m.duration_ms, m.explicit, m.image_url, 'spotify' AS source_of_truth, false AS needs_review
 FROM metadata m JOIN songs s ON s.spotify_track_id = m.spotify_track_id LEFT JOIN album_rows a ON a.spotify_album_id = m.spotify_album_id""",
    "enriched_artists": f"SELECT name, spotify_id, image_url, popularity, {_SLUG.format(c='name')} AS slug, {_B.format(c='name')} AS normalized_name, name AS canonical_name, 'spotify' AS source_of_truth FROM ({ARTIST_METADATA})",
    "certification_job": f"""WITH awards AS ({BATCHES['awards']}), ti AS (SELECT artist_id, lower(title) AS t, min(CAST(id AS VARCHAR)) AS id FROM songs GROUP BY 1, 2), s AS (SELECT w.*, ti.id AS song_id, row_number() OVER (PARTITION BY w.artist_id, w.title ORDER BY w.seq DESC) AS n FROM awards w LEFT JOIN ti ON ti.artist_id = w.artist_id AND ti.t = lower(w.title))
 SELECT artist_id, song_id, 'US' AS territory, 'RIAA' AS body, title, CASE seq % 4 WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' WHEN 2 THEN 'diamond' ELSE 'latin' END AS level, CASE WHEN seq % 2 = 0 THEN CAST(seq % 9 AS BIGINT) END AS units, CASE seq % 3 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2023-12-31' END AS certified_at,
 CASE WHEN song_id IS NULL THEN 'artist_only' ELSE 'matched' END AS resolution_status FROM s WHERE n = 1""",
    "origin_job": f"SELECT id, CASE id % 3 WHEN 0 THEN 'NG' ELSE 'US' END AS origin_country FROM ({ROWS['artist_rows']}) WHERE origin_country IS NULL AND id % 3 <> 1",
    "lost_references": "SELECT song_id, snapshot_date FROM song_stats_snapshots WHERE song_id NOT IN (SELECT id FROM songs WHERE id % 3 > 0)",
    "header_meta": f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS chart_date, CASE WHEN o_orderkey % 8 < 6 THEN strftime(TIMESTAMP '{DAY} 00:30:00' + to_hours(CAST(o_orderkey % 24 + CASE o_orderkey % 8 WHEN 0 THEN -4 WHEN 1 THEN -5 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS INTEGER)), '%Y-%m-%d %H:%M') END AS page_time FROM orders""",
    "job_progress": "SELECT o_orderkey, CASE WHEN o_orderkey % 71 > 0 THEN CAST(floor(100.0 * (o_orderkey % 70) / (o_orderkey % 71) + 0.5) AS BIGINT) ELSE 100 END AS percent FROM orders",
    "artist_job_progress": "SELECT o_orderkey, CASE WHEN o_orderkey % 71 > 0 THEN CAST(floor(100.0 * (o_orderkey % 70) / (o_orderkey % 71) + 0.5) AS BIGINT) ELSE 0 END AS percent FROM orders",
    "job_counters": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS succeeded, count(*) FILTER (WHERE event_type <> 'view') AS failed FROM events",
}
SQL: dict[str, str] = {k: with_fixtures(v) for k, v in _SQL.items()}
