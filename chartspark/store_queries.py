"""Queries of the keyed writes and lookups, and the same in SQL. Both sides read the batches below, in portable SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators import store
from chartspark.operators.relational import latest_by
from chartspark.plans.fixtures import Tables, with_fixtures
from chartspark.plans.staging import staged

Query = Callable[[SparkSession, str], DataFrame]

#: The day on which the writes run.
NOW = date(2024, 5, 1)
#: Targets and batches of writes. Ids of batches are shifted, so some of their keys are new.
ROWS: dict[str, str] = {
    "artist_rows": """SELECT id, name, lower(name) AS normalized_name, name AS canonical_name, CASE WHEN id % 9 = 0 THEN NULL ELSE spotify_id END AS spotify_id, slug,
 CASE WHEN id % 4 = 0 THEN NULL ELSE origin_country END AS origin_country, image_url, popularity, is_afrobeats, CASE WHEN id % 8 = 3 THEN 'merged' ELSE 'canonical' END AS entity_status,
 'kworb' AS source_of_truth, (id % 2 = 0) AS needs_review, CASE WHEN id % 5 = 0 THEN 'not_found' WHEN id % 5 = 1 THEN 'found' END AS kworb_status, DATE '2020-02-02' AS updated_at FROM artists""",
    "artist_batch": """SELECT id + 1000000 AS id, concat(name, ' II') AS name, concat(lower(name), ' ii') AS normalized_name, concat(name, '!') AS canonical_name,
 CASE WHEN id % 7 = 0 THEN NULL ELSE concat('sp', CAST(id + 3 AS VARCHAR(20))) END AS spotify_id, concat('supplier-', CAST(id AS VARCHAR(20))) AS slug, 'X' AS origin_country, concat(name, '.jpg') AS image_url,
 CASE WHEN id % 3 = 0 THEN NULL ELSE 7 END AS popularity, (id % 2 = 0) AS is_afrobeats, CASE WHEN id % 2 = 0 THEN 'provisional' END AS entity_status, CASE WHEN id % 5 > 0 THEN 'editor' END AS source_of_truth FROM artists""",
    "genre_rows": "SELECT id AS artist_id, CASE WHEN id % 2 = 0 THEN 'pop' ELSE 'soul' END AS genre, (id % 3 = 0) AS is_primary FROM artists",
    "genre_batch": "SELECT id + 2 AS artist_id, 'pop' AS genre, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 3 = 1) END AS is_primary FROM artists",
    "listener_rows": "SELECT artist_id, spotify_id, snapshot_date, monthly_listeners, daily_change, peak_rank, peak_listeners, 'load' AS source, DATE '2020-02-02' AS updated_at FROM artist_monthly_listener_snapshots",
    "listener_batch": "SELECT artist_id, 'other' AS spotify_id, snapshot_date + 2 AS snapshot_date, monthly_listeners * 2 AS monthly_listeners, CAST(NULL AS BIGINT) AS daily_change, 5 AS peak_rank, peak_listeners FROM artist_monthly_listener_snapshots",
    "album_rows": """SELECT p_partkey AS id, p_partkey % 7 AS artist_id, p_name AS title, concat('al-', CAST(p_partkey AS VARCHAR(20))) AS slug, concat('alb', CAST(p_partkey AS VARCHAR(20))) AS spotify_album_id, 'album' AS album_type,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '2019-05-03' END AS release_date, CAST(NULL AS VARCHAR(20)) AS image_url, p_size AS total_tracks, (p_partkey % 2 = 0) AS is_afrobeats FROM part""",
    "album_batch": """SELECT p_partkey + 5000000 AS id, p_partkey % 5 AS artist_id, concat(p_name, ' (Deluxe)') AS title, concat('dx-', CAST(p_partkey AS VARCHAR(20))) AS slug, concat('alb', CAST(p_partkey + 20 AS VARCHAR(20))) AS spotify_album_id, 'single' AS album_type,
 DATE '2020-01-01' AS release_date, 'a.png' AS image_url, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 3 END AS total_tracks, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 3 = 0) END AS is_afrobeats FROM part""",
    "song_rows": """SELECT id, artist_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 50 END AS album_id, title, lower(title) AS normalized_title, title AS canonical_title, slug, CASE WHEN id % 10 = 0 THEN NULL ELSE spotify_track_id END AS spotify_track_id, release_date,
 CASE WHEN id % 4 = 0 THEN NULL ELSE 1000 * (id % 300) END AS duration_ms, (id % 5 = 0) AS explicit, is_afrobeats, image_url, 'provisional' AS entity_status, 'kworb' AS source_of_truth, (id % 2 = 0) AS needs_review FROM songs""",
    "song_batch": """SELECT id + 3000000 AS id, artist_id + 1 AS artist_id, id % 9 AS album_id, concat(title, ' (Live)') AS title, lower(title) AS normalized_title, concat(title, '*') AS canonical_title, concat(slug, CASE WHEN id % 2 = 0 THEN '' ELSE '-live' END) AS slug,
 CASE WHEN id % 8 = 0 THEN NULL ELSE concat('trk', CAST(id + 30 AS VARCHAR(20))) END AS spotify_track_id, DATE '2021-07-01' AS release_date, CASE WHEN id % 6 = 0 THEN NULL ELSE 180000 END AS duration_ms, (id % 2 = 0) AS explicit,
 CASE WHEN id % 3 > 0 THEN (id % 3 = 1) END AS is_afrobeats, 's.png' AS image_url, CASE WHEN id % 2 = 0 THEN 'merged' END AS entity_status, 'spotify' AS source_of_truth, CASE WHEN id % 5 > 0 THEN false END AS needs_review FROM songs""",
    "artist_day_rows": """SELECT artist_id, snapshot_date, total_streams, total_streams_as_lead, total_streams AS total_streams_solo, total_streams_as_feature, daily_streams, daily_streams AS daily_streams_as_lead, CAST(NULL AS BIGINT) AS daily_streams_as_feature,
 track_count, snapshot_date AS source_updated_at FROM artist_stats_snapshots""",
    "artist_day_batch": "SELECT artist_id, snapshot_date + 1 AS snapshot_date, total_streams + 9 AS total_streams, daily_streams + 1 AS daily_streams, track_count FROM artist_stats_snapshots",
    "song_day_rows": "SELECT song_id, snapshot_date, spotify_streams, daily_streams FROM song_stats_snapshots",
    "song_day_batch": "SELECT song_id, snapshot_date + 1 AS snapshot_date, CASE WHEN song_id % 2 = 0 THEN NULL ELSE spotify_streams + 1 END AS spotify_streams, daily_streams FROM song_stats_snapshots",
    "award_rows": "SELECT song_id AS id, artist_id, song_id, territory, body, title, level, units, certified_at, 'http://a' AS source_url FROM certifications",
    "award_batch": "SELECT song_id + 7000000 AS id, artist_id, -1 AS song_id, territory, CASE WHEN song_id % 3 = 0 THEN 'BPI' ELSE body END AS body, title, 'diamond' AS level, units + 1 AS units, DATE '2022-02-02' AS certified_at, CAST(NULL AS VARCHAR(20)) AS source_url FROM certifications",
    "trend_rows": "SELECT entry_id, prev_rank, delta, trend FROM chart_entry_snapshots",
    "trend_batch": "SELECT concat(entry_id, CASE WHEN delta > 3 THEN 'x' ELSE '' END) AS entry_id, delta AS prev_rank, CAST(NULL AS SMALLINT) AS delta, 'SAME' AS trend FROM chart_entry_snapshots",
    "alias_rows": "SELECT id AS artist_id, lower(name) AS normalized_alias, name AS alias, 'kworb' AS source FROM artists WHERE id % 2 = 0",
    "alias_batch": "SELECT artist_id, alias AS normalized_alias, alias, 'chart' AS source, seq FROM (SELECT id % 12 AS artist_id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN NULL ELSE lower(name) END AS alias, id AS seq FROM artists)",
    "external_rows": "SELECT id AS artist_id, 'spotify' AS source, spotify_id AS external_id FROM artists WHERE id % 3 > 0",
    "external_batch": "SELECT id + 1 AS artist_id, CASE WHEN id % 7 = 0 THEN '' ELSE 'spotify' END AS source, CASE WHEN id % 4 = 0 THEN NULL ELSE spotify_id END AS external_id, id AS seq FROM artists",
}


def _in(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({ROWS[n]})" for n in names)


def _rows(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    t = Tables(spark, d)
    return [t.sql(ROWS[n]) for n in names]


def _merge(rule: str, target: str, batch: str) -> Query:
    return lambda spark, d: store.merge(*_rows(spark, d, target, batch), store.RULES[rule], now=F.lit(NOW))


def _merge_sql(target: str, batch: str, on: str, assigned: str, kept: str, insert: str = "") -> str:
    """INSERT ... ON CONFLICT (``on``) DO UPDATE SET ``assigned``, as a query. ``kept``: the other columns. ``insert``: column=default."""
    keys = on.split(",")
    default = dict(p.split("=") for p in insert.split(",") if p)
    given = lambda c: f"coalesce(s.{c}, {default[c]})" if c in default else f"s.{c}"
    hit, old = f"t.{keys[0]} IS NOT NULL AND s.{keys[0]} IS NOT NULL", "t.there"
    columns = [f"CASE WHEN {old} THEN t.{k} ELSE s.{k} END AS {k}" for k in keys]
    for c in assigned.split(","):
        c, *fill = c.split("?")
        new = f"coalesce(s.{c}, t.{c})" if fill else given(c)
        columns.append(f"CASE WHEN {hit} THEN {new} WHEN {old} THEN t.{c} ELSE {given(c)} END AS {c}")
    for c in kept.split(",") if kept else ():
        if c in ("updated_at", "updated_at*"):  # with a star: a conflict renews it
            columns.append(f"CASE WHEN {old} AND NOT ({hit if c[-1] == '*' else 'false'}) THEN t.updated_at ELSE DATE '{NOW}' END AS updated_at")
            continue
        c, *none = c.split("!")
        columns.append(f"CASE WHEN {old} THEN t.{c} ELSE {default.get(c, 'NULL') if none else given(c)} END AS {c}")
    join = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    return f"{_in(target, batch)} SELECT {', '.join(columns)} FROM (SELECT *, true AS there FROM {target}) t FULL JOIN {batch} s ON {join}"


_PATCH = """SELECT id AS id, concat(name, ' (new)') AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'ZZ' END AS origin_country FROM artists WHERE id % 3 = 0"""
_GONE = "SELECT id FROM songs WHERE id % 4 = 1"
_GONE_ARTISTS = "SELECT id FROM artists WHERE id % 5 = 2"


def _patch(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return store.patch(t.sql(ROWS["artist_rows"]), t.sql(_PATCH)).select("id", "name", "normalized_name", "canonical_name", "origin_country", "slug")


def _not_found(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = t.sql(ROWS["artist_rows"]).withColumn("kworb_last_checked_at", F.lit(None).cast("timestamp"))
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    marked = store.mark_not_found(rows, t.sql("SELECT id FROM artists WHERE id % 4 = 2"), now)
    return marked.select("id", "kworb_status", F.col("kworb_last_checked_at").cast("string").alias("checked"))


def _link_id(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return store.patch(t.sql(ROWS["artist_rows"]), t.sql("SELECT id, concat('new', spotify_id) AS spotify_id FROM artists WHERE id % 9 = 0")).select("id", "spotify_id", "name")


_LEFT_BY_SONGS = ("songs", "song_features", "song_stats_snapshots", "certifications", "chart_entries", "chart_entry_snapshots")
_LEFT_BY_ARTISTS = (*_LEFT_BY_SONGS, "artists", "artist_stats_snapshots", "artist_monthly_listener_snapshots", "award_records", "records")
#: What tells the rows of a table apart.
_ROW = {
    "songs": "id", "artists": "id", "records": "id", "chart_entries": "id", "chart_entry_snapshots": "entry_id", "song_features": "song_id || '/' || featured_artist_id",
    "song_stats_snapshots": "song_id || '/' || snapshot_date", "artist_stats_snapshots": "artist_id || '/' || snapshot_date", "artist_monthly_listener_snapshots": "artist_id || '/' || snapshot_date",
    "certifications": "title || '/' || territory || '/' || body", "award_records": "coalesce(CAST(song_id AS VARCHAR(20)), '-') || '/' || award_name || '/' || coalesce(CAST(artist_id AS VARCHAR(20)), '-')",
}


def _deleted(name: str, gone: str, among: tuple[str, ...]) -> Query:
    """The rows that are left of all tables after some of one go, as one list of (name, row)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        t.made["chart_entries"] = staged(t["chart_entries"], "chart_entries")
        left = store.delete({n: t[n] for n in among}, name, t.sql(gone))
        out = None
        for table, df in sorted(left.items()):
            rows = df.select(F.lit(table).alias("name"), F.expr(f"CAST({_ROW[table]} AS STRING)").alias("row"))
            out = rows if out is None else out.unionByName(rows)
        return out

    return run


def _album_lost(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    tables = {"albums": t.sql(ROWS["album_rows"]), "songs": t.sql(ROWS["song_rows"])}
    return store.delete(tables, "albums", t.sql("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0"))["songs"].select("id", "album_id")


def _lookup(of: str, pick: Callable[[Tables, DataFrame], DataFrame], columns: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        return pick(t, t.sql(ROWS[of]) if of in ROWS else t[of]).select(*columns.split(", "))

    return run


def _ids(column: str, text: str) -> Callable[[Tables, DataFrame], DataFrame]:
    return lambda t, rows: store.find_in(rows, column, t.sql(text))


_SOME_ARTISTS = "SELECT CASE WHEN id % 2 = 0 THEN spotify_id ELSE slug END AS k FROM artists WHERE id % 3 = 0"
_SOME_TRACKS = "SELECT concat('trk', CAST(id * 2 AS VARCHAR(20))) AS k FROM songs"
_SOME_ALBUMS = "SELECT concat('alb', CAST(p_partkey * 3 AS VARCHAR(20))) AS k FROM part"
_DAY = "DATE '2024-01-15'"

#: A title as a page may write it: the first of artist 3, in capitals and with a credit.
_FIRST_TITLE = lambda rows: rows.where("artist_id = 3").agg(F.concat(F.upper(F.min("title")), F.lit(" (feat. X)")).alias("title"))
#: name -> (table, lookup, columns, SQL condition and order)
LOOKUPS: dict[str, tuple] = {
    "artists_unenriched": ("artist_rows", lambda t, r: store.missing(r, "image_url", 100), "id, spotify_id", "WHERE image_url IS NULL ORDER BY id LIMIT 100"),
    "artist_by_spotify_id": ("artist_rows", lambda t, r: store.find(r, spotify_id="sp4"), "id, name, slug", "WHERE spotify_id = 'sp4' ORDER BY id LIMIT 1"),
    "artist_by_name": ("artist_rows", lambda t, r: store.find(r, normalized_name="supplier#000000005"), "id, name", "WHERE normalized_name = 'supplier#000000005' ORDER BY id LIMIT 1"),
    "artists_by_spotify_ids": ("artist_rows", _ids("spotify_id", _SOME_ARTISTS), "id, spotify_id, name", f"WHERE spotify_id IN ({_SOME_ARTISTS})"),
    "artists_existing_ids": ("artist_rows", _ids("spotify_id", _SOME_ARTISTS), "spotify_id", f"WHERE spotify_id IS NOT NULL AND spotify_id IN ({_SOME_ARTISTS})"),
    "artists_basic": ("artist_rows", lambda t, r: r, "id, name, slug, spotify_id, image_url, origin_country", ""),
    "artists_missing_country": ("artist_rows", lambda t, r: store.missing(r, "origin_country", 200), "id, name", "WHERE origin_country IS NULL ORDER BY id LIMIT 200"),
    "artists_missing_country_all": ("artist_rows", lambda t, r: store.missing(r, "origin_country"), "id, name, origin_country", "WHERE origin_country IS NULL"),
    "artists_trackable": ("artist_rows", lambda t, r: store.trackable(r), "id, spotify_id", "WHERE spotify_id IS NOT NULL AND (kworb_status IS NULL OR kworb_status <> 'not_found') AND entity_status <> 'merged'"),
    "artists_unenriched_page": ("artist_rows", lambda t, r: store.next_page(store.missing(r, "image_url"), "id", 3, 2), "id, spotify_id", "WHERE image_url IS NULL AND id > 3 ORDER BY id LIMIT 2"),
    "artists_page_wraps": ("artist_rows", lambda t, r: store.next_page(store.missing(r, "image_url"), "id", 10**9, 2), "id, spotify_id", "WHERE image_url IS NULL ORDER BY id LIMIT 2"),
    "song_by_track_id": ("song_rows", lambda t, r: store.find(r, spotify_track_id="trk7"), "id, title", "WHERE spotify_track_id = 'trk7' ORDER BY id LIMIT 1"),
    "songs_by_track_ids": ("song_rows", _ids("spotify_track_id", _SOME_TRACKS), "id, spotify_track_id", f"WHERE spotify_track_id IN ({_SOME_TRACKS})"),
    "songs_by_artist": ("song_rows", lambda t, r: store.find_all(r, artist_id=3), "id, title, slug, spotify_track_id", "WHERE artist_id = 3"),
    "song_by_artist_and_title": ("song_rows", lambda t, r: store.titled(r, 3, _FIRST_TITLE(r)), "id, title, normalized_title", "WHERE artist_id = 3 AND normalized_title = (SELECT min(lower(title)) FROM songs WHERE artist_id = 3) ORDER BY id LIMIT 1"),
    "songs_unenriched": ("song_rows", lambda t, r: store.unenriched_songs(r, 100), "id, slug", "WHERE spotify_track_id IS NOT NULL AND (album_id IS NULL OR release_date IS NULL OR duration_ms IS NULL OR image_url IS NULL) ORDER BY id LIMIT 100"),
    "album_by_spotify_id": ("album_rows", lambda t, r: store.find(r, spotify_album_id="alb9"), "id, title", "WHERE spotify_album_id = 'alb9' ORDER BY id LIMIT 1"),
    "albums_by_spotify_ids": ("album_rows", _ids("spotify_album_id", _SOME_ALBUMS), "id, title", f"WHERE spotify_album_id IN ({_SOME_ALBUMS})"),
    "certifications_by_artist": ("award_rows", lambda t, r: store.find_all(r, artist_id=2), "id, title, level", "WHERE artist_id = 2"),
    "certifications_by_song": ("award_rows", lambda t, r: store.find_all(r, song_id=6), "id, territory, level", "WHERE song_id = 6"),
    "certifications_by_territory": ("award_rows", lambda t, r: store.certified(r, 2, "2-High"), "id, territory, level", "WHERE artist_id = 2 AND territory = upper('2-High')"),
    "artist_snapshot_on": ("artist_day_rows", lambda t, r: store.find_all(r, artist_id=3).where(f"snapshot_date = {_DAY}").limit(1), "artist_id, daily_streams", f"WHERE artist_id = 3 AND snapshot_date = {_DAY} LIMIT 1"),
    "song_snapshot_on": ("song_day_rows", lambda t, r: store.find_all(r, song_id=7).where(f"snapshot_date = {_DAY}").limit(1), "song_id, snapshot_date, daily_streams", f"WHERE song_id = 7 AND snapshot_date = {_DAY} LIMIT 1"),
    "songs_window": ("song_rows", lambda t, r: store.window(r, "id", 50, 25), "id, slug", "ORDER BY id LIMIT 25 OFFSET 50"),
    "songs_in_chunks": ("song_rows", lambda t, r: store.chunks(store.next_page(r, "id", 10, 120), "id", 50), "id, chunk", ""),
}

_ARTIST_SET = "name,normalized_name,canonical_name,image_url,popularity,is_afrobeats,source_of_truth"
_ALBUM_SET = "artist_id,title,slug,album_type,release_date,image_url,total_tracks"
_SONG_SET = "artist_id,album_id,title,normalized_title,canonical_title,release_date,duration_ms,explicit,image_url,source_of_truth,needs_review"
#: name -> (rule, target, batch, conflict key, assigned columns, other columns, values of new rows)
MERGES: dict[str, tuple[str, ...]] = {
    "merge_artists_discovered": ("artists_discovered", "artist_rows", "artist_batch", "spotify_id", "name,normalized_name", "id,canonical_name,slug,origin_country,image_url,popularity,is_afrobeats,entity_status,source_of_truth,needs_review!,kworb_status!,updated_at*", "entity_status='canonical',source_of_truth='kworb',needs_review=false"),
    "merge_artists": ("artists", "artist_rows", "artist_batch", "spotify_id", _ARTIST_SET, "id,slug,origin_country,entity_status,needs_review!,kworb_status!,updated_at*", "entity_status='canonical',source_of_truth='spotify',needs_review=false"),
    "merge_artists_by_slug": ("artists_by_slug", "artist_rows", "artist_batch", "slug", "name,normalized_name,spotify_id?", "id,canonical_name,origin_country,image_url,popularity,is_afrobeats,entity_status,source_of_truth,needs_review!,kworb_status!,updated_at*", "entity_status='canonical',is_afrobeats=false,needs_review=false"),
    "merge_genres": ("artist_genres", "genre_rows", "genre_batch", "artist_id,genre", "is_primary", "", "is_primary=false"),
    "merge_listeners": ("listener_snapshots", "listener_rows", "listener_batch", "artist_id,snapshot_date", "monthly_listeners,daily_change,peak_rank,peak_listeners", "spotify_id,source!,updated_at*", "source='kworb'"),
    "merge_albums": ("albums", "album_rows", "album_batch", "spotify_album_id", _ALBUM_SET + ",is_afrobeats", "id", "is_afrobeats=false"),
    "merge_albums_scraped": ("albums_scraped", "album_rows", "album_batch", "spotify_album_id", _ALBUM_SET, "id,is_afrobeats", "is_afrobeats=false"),
    "merge_songs": ("songs", "song_rows", "song_batch", "spotify_track_id", _SONG_SET, "id,slug,is_afrobeats,entity_status", "entity_status='canonical',needs_review=false,is_afrobeats=false"),
    "merge_songs_edited": ("songs_edited", "song_rows", "song_batch", "spotify_track_id", _SONG_SET + ",is_afrobeats,entity_status", "id,slug", "entity_status='canonical',needs_review=false"),
    "merge_songs_by_slug": ("songs_by_slug", "song_rows", "song_batch", "slug", "title,normalized_title", "id,artist_id,album_id,canonical_title,spotify_track_id,release_date,duration_ms,explicit,is_afrobeats,image_url,entity_status,source_of_truth,needs_review", "entity_status='canonical',needs_review=false,is_afrobeats=false"),
    "merge_artist_snapshots": ("artist_snapshots", "artist_day_rows", "artist_day_batch", "artist_id,snapshot_date", "", "", ""),
    "merge_song_snapshots": ("song_snapshots", "song_day_rows", "song_day_batch", "song_id,snapshot_date", "spotify_streams,daily_streams", "", ""),
    "merge_certifications": ("certifications", "award_rows", "award_batch", "artist_id,territory,body,title", "level,units,certified_at,source_url", "id,song_id", ""),
    "merge_trends": ("trends", "trend_rows", "trend_batch", "entry_id", "prev_rank,delta,trend", "", ""),
}

def _holders(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d)["records"].where("is_active")
    return latest_by(rows, ["scope", "record_type"], [F.col("numeric_value").desc_nulls_last(), F.col("id")]).select("scope", "record_type", "artist_id", "numeric_value", "record_value")


def _awards(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d)["award_records"].where("artist_id is not null")
    return rows.groupBy("artist_id", "award_body", "year", "result").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "record_holders": _holders,
    "award_counts": _awards,
    **{name: _merge(*m[:3]) for name, m in MERGES.items()},
    **{name: _lookup(*k[:3]) for name, k in LOOKUPS.items()},
    "patch_artists": _patch,
    "mark_not_found": _not_found,
    "link_spotify_id": _link_id,
    "delete_songs": _deleted("songs", _GONE, _LEFT_BY_SONGS),
    "delete_artists": _deleted("artists", _GONE_ARTISTS, _LEFT_BY_ARTISTS),
    "delete_albums_set_null": _album_lost,
    "attach_aliases": lambda spark, d: store.attach(*_rows(spark, d, "alias_rows", "alias_batch"), ["artist_id", "normalized_alias"], "seq"),
    "attach_external_ids": lambda spark, d: store.attach(*_rows(spark, d, "external_rows", "external_batch"), ["source", "external_id"], "seq"),
}

def _left(among: tuple[str, ...], lost: dict[str, str]) -> str:
    """The rows of tables but those that meet the condition in ``lost``."""
    return " UNION ALL ".join(f" SELECT '{n}' AS name, CAST({_ROW[n]} AS VARCHAR) AS row FROM {n} WHERE ({lost[n]}) IS NOT TRUE" for n in among)


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) AS rn FROM {b} WHERE {w}) b WHERE rn = 1"
_SQL: dict[str, str] = {
    "record_holders": "SELECT scope, record_type, artist_id, numeric_value, record_value FROM (SELECT *, row_number() OVER (PARTITION BY scope, record_type ORDER BY numeric_value DESC NULLS LAST, id) AS n FROM records WHERE is_active) WHERE n = 1",
    "award_counts": "SELECT artist_id, award_body, year, result, count(*) AS n FROM award_records WHERE artist_id IS NOT NULL GROUP BY ALL",
    **{name: _merge_sql(*m[1:]) for name, m in MERGES.items() if m[4]},
    **{name: f"SELECT {k[2]} FROM ({ROWS[k[0]]}) rows_ {k[3]}" for name, k in LOOKUPS.items()},
    "songs_in_chunks": f"SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS chunk FROM (SELECT id FROM ({ROWS['song_rows']}) WHERE id > 10 ORDER BY id LIMIT 120)",
    "merge_artist_snapshots": _in("artist_day_rows", "artist_day_batch") + """ SELECT coalesce(s.artist_id, t.artist_id) AS artist_id, coalesce(s.snapshot_date, t.snapshot_date) AS snapshot_date,
 CASE WHEN s.artist_id IS NULL THEN t.total_streams ELSE s.total_streams END AS total_streams, CASE WHEN s.artist_id IS NULL THEN t.total_streams_as_lead END AS total_streams_as_lead, CASE WHEN s.artist_id IS NULL THEN t.total_streams_solo END AS total_streams_solo,
 CASE WHEN s.artist_id IS NULL THEN t.total_streams_as_feature END AS total_streams_as_feature, CASE WHEN s.artist_id IS NULL THEN t.daily_streams ELSE s.daily_streams END AS daily_streams, CASE WHEN s.artist_id IS NULL THEN t.daily_streams_as_lead END AS daily_streams_as_lead,
 CASE WHEN s.artist_id IS NULL THEN t.daily_streams_as_feature END AS daily_streams_as_feature, CASE WHEN s.artist_id IS NULL THEN t.track_count ELSE s.track_count END AS track_count, CASE WHEN s.artist_id IS NULL THEN t.source_updated_at END AS source_updated_at
 FROM artist_day_rows t FULL JOIN artist_day_batch s ON t.artist_id = s.artist_id AND t.snapshot_date = s.snapshot_date""",
    "patch_artists": f"""{_in("artist_rows")}, p AS ({_PATCH}) SELECT r.id, CASE WHEN p.id IS NULL THEN r.name ELSE p.name END AS name, CASE WHEN p.id IS NULL THEN r.normalized_name ELSE trim(regexp_replace(regexp_replace(lower(p.name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) END AS normalized_name,
 CASE WHEN p.id IS NULL THEN r.canonical_name ELSE p.name END AS canonical_name, CASE WHEN p.id IS NULL THEN r.origin_country ELSE p.origin_country END AS origin_country, r.slug FROM artist_rows r LEFT JOIN p ON p.id = r.id""",
    "mark_not_found": f"SELECT id, CASE WHEN id % 4 = 2 THEN 'not_found' ELSE kworb_status END AS kworb_status, CASE WHEN id % 4 = 2 THEN '2023-11-14 22:13:20' END AS checked FROM ({ROWS['artist_rows']})",
    "link_spotify_id": f"SELECT id, CASE WHEN id % 9 = 0 THEN concat('newsp', CAST(id AS VARCHAR)) ELSE spotify_id END AS spotify_id, name FROM ({ROWS['artist_rows']})",
    "delete_songs": f"WITH gone AS ({_GONE})" + _left(_LEFT_BY_SONGS, {
        "songs": "id IN (FROM gone)", **{n: "song_id IN (FROM gone)" for n in ("song_features", "song_stats_snapshots", "certifications", "chart_entries")},
        "chart_entry_snapshots": "entry_id IN (SELECT id FROM chart_entries WHERE song_id IN (FROM gone))",
    }),
    "delete_artists": f"WITH gone AS ({_GONE_ARTISTS}), gone_songs AS (SELECT id FROM songs WHERE artist_id IN (FROM gone)), gone_entries AS (SELECT id FROM chart_entries WHERE artist_id IN (FROM gone) OR song_id IN (FROM gone_songs)), awards AS (SELECT * REPLACE (CASE WHEN song_id IN (FROM gone_songs) THEN NULL ELSE song_id END AS song_id) FROM award_records)" + _left(_LEFT_BY_ARTISTS, {
        "artists": "id IN (FROM gone)", "songs": "id IN (FROM gone_songs)", "song_features": "featured_artist_id IN (FROM gone) OR song_id IN (FROM gone_songs)", "song_stats_snapshots": "song_id IN (FROM gone_songs)",
        "certifications": "artist_id IN (FROM gone) OR song_id IN (FROM gone_songs)", "chart_entries": "id IN (FROM gone_entries)", "chart_entry_snapshots": "entry_id IN (FROM gone_entries)",
        **{n: "artist_id IN (FROM gone)" for n in ("artist_stats_snapshots", "artist_monthly_listener_snapshots", "award_records", "records")},
    }).replace("FROM award_records WHERE", "FROM awards WHERE"),
    "delete_albums_set_null": f"SELECT id, CASE WHEN album_id IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) THEN NULL ELSE album_id END AS album_id FROM ({ROWS['song_rows']})",
    "attach_aliases": f"""{_in("alias_rows", "alias_batch")} SELECT artist_id, normalized_alias, alias, source FROM alias_rows UNION ALL SELECT artist_id, normalized_alias, alias, source
 FROM ({_FIRST.format(k='artist_id, normalized_alias', b='alias_batch', w="artist_id IS NOT NULL AND normalized_alias <> ''")}) b ANTI JOIN alias_rows USING (artist_id, normalized_alias)""",
    "attach_external_ids": f"""{_in("external_rows", "external_batch")} SELECT artist_id, source, external_id FROM external_rows UNION ALL SELECT artist_id, source, external_id
 FROM ({_FIRST.format(k='source, external_id', b='external_batch', w="source <> '' AND external_id <> ''")}) b ANTI JOIN external_rows USING (source, external_id)""",
}
SQL: dict[str, str] = {k: with_fixtures(v) for k, v in _SQL.items()}
