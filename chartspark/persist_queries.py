"""Queries that persist charts: batches of rows, weekly backfills and identities in chains; and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.chart_queries import GREEDY, whole
from chartspark.operators import backfill, charts, resolve
from chartspark.plans.fixtures import Tables
from chartspark.plans.staging import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]

#: A batch of rows for weeks between those that the charts have; some leads and guests are new. The id of an entry orders them.
BATCH = """
SELECT c.id AS seq, chart_name, chart_territory, chart_week + 14 AS chart_week, c.position % 40 + 1 AS rank,
  CASE WHEN s.id % 11 = 3 THEN concat('Debut ', CAST(s.id % 5 AS VARCHAR(20))) ELSE a.name END AS artist, s.title AS title,
  CASE WHEN s.id % 13 = 4 THEN concat('Nova ', CAST(s.id % 4 AS VARCHAR(20))) ELSE g.name END AS guest
FROM chart_entries c JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = s.artist_id LEFT JOIN artists g ON g.id = (s.id * 7 + 3) % 10
WHERE chart_territory IS NOT NULL"""

#: Weekly pages as two sources write their credits; {form} tells them apart.
_WEEKLY = """
SELECT c.chart_week AS week, c.position AS this_week, s.title AS song, c.peak_position, c.weeks_on_chart, s.id AS sid, s.id % 4 AS form,
  CASE s.id % 4 WHEN 0 THEN {guest} WHEN 1 THEN {new} WHEN 2 THEN {fresh} ELSE a.name END AS artist
FROM chart_entries c JOIN songs s ON s.id = c.song_id JOIN artists a ON a.id = s.artist_id JOIN artists g ON g.id = (s.id * 7 + 3) % 9 + 1
WHERE chart_territory = '{territory}' AND chart_name = '1-URGENT'"""
_NUMBER = "CAST(s.id % {n} AS VARCHAR(20))"
WEEKLY = {
    "hot_100": _WEEKLY.format(
        territory="ASIA", guest="concat(a.name, ' Featuring ', g.name)", new=f"concat(a.name, ' & New Act ', {_NUMBER.format(n=6)})", fresh=f"concat('Fresh ', {_NUMBER.format(n=9)}, ' x ', a.name)"
    ),
    "uk": _WEEKLY.format(
        territory="EUROPE", guest="concat(upper(a.name), '/', g.name)", new=f"concat(a.name, ' FT. NEW ACT ', {_NUMBER.format(n=6)})", fresh=f"concat('feat. FRESH ', {_NUMBER.format(n=9)}, ' / ', a.name)"
    ),
}
SOURCES = {"hot_100": backfill.HOT_100, "uk": backfill.UK_SINGLES}

#: Mentions in chains: each shares an id of some source with the next, every third chain is broken in its middle.
CHAINS = """
SELECT c_custkey AS seq, concat('Chain ', CAST(c_custkey // 7 AS VARCHAR(20)), ' ', CAST(c_custkey % 7 AS VARCHAR(20))) AS name, c_custkey // 7 AS chain, c_custkey % 7 AS link
FROM customer"""
#: Every fifth chain has an id that an artist has.
CHAIN_IDS = "SELECT id AS artist_id, 'src2' AS source, concat(CAST(id * 5 AS VARCHAR(20)), '-2') AS external_id FROM artists"


def _persisted(part: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        entries = staged(t["chart_entries"], "chart_entries")
        t.made["chart_entries"] = entries
        guest = F.when(F.col("guest").isNotNull(), F.array("guest")).otherwise(F.array().cast("array<string>"))
        rows = t.sql(BATCH).withColumn("featured", guest).drop("guest")
        return charts.persisted(rows, t["artists"], t["songs"], entries, t["song_features"], parts=[part])[part]

    return run


def _backfilled(name: str, part: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Tables(spark, d)
        t.made["chart_entries"] = staged(t["chart_entries"], "chart_entries")
        rows = staged(t.sql(WEEKLY[name]).drop("sid", "form"), "weekly")
        tables = {k: t[k] for k in ("artists", "songs", "chart_entries", "song_features")}
        result = backfill.run(rows, SOURCES[name], tables, f"{shared_dir(spark)}/backfill-{uuid.uuid4().hex}", weeks_a_batch=40)
        return backfill.counters(rows, result) if part == "counters" else result[part]

    return run


def _chains(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = spark.sql(CHAINS.replace("//", "DIV").replace("customer", "{c}"), c=t["customer"])
    of = lambda i: F.struct(F.concat(F.lit("src"), i.cast("string")).alias("source"), F.concat(F.col("chain").cast("string"), F.lit("-"), i.cast("string")).alias("external_id"))
    own, following = of(F.col("link")), of(F.col("link") + 1)
    broken = (F.col("chain") % 3 == 0) & (F.col("link") == 3)
    ids = F.when(broken, F.array(own)).otherwise(F.array(own, following))
    mentions = rows.select("seq", "name", F.lit(None).cast("string").alias("spotify_id"), ids.alias("external_ids"))
    return resolve.resolve_artists(mentions, t["artists"], external=t.sql(CHAIN_IDS), provisional=True).drop("spotify_id")


QUERIES: dict[str, Query] = {
    "persist_entries": lambda spark, d: _persisted("entries")(spark, d).drop("seq"),
    "persist_features": _persisted("features"),
    "persist_mentions": _persisted("mentions"),
    "weekly_backfill": _backfilled("hot_100", "entries"),
    "weekly_backfill_features": _backfilled("hot_100", "features"),
    "weekly_backfill_counters": _backfilled("hot_100", "counters"),
    "weekly_backfill_uk": _backfilled("uk", "entries"),
    "weekly_backfill_uk_mentions": _backfilled("uk", "mentions"),
    "identity_chains": _chains,
}

_SLUG_ID = "sha256(replace(lower({c}), ' ', '-'))"
_TITLES = "titles AS (SELECT CAST(artist_id AS VARCHAR) AS artist_id, lower(title) AS t, min(CAST(id AS VARCHAR)) AS song_id FROM songs GROUP BY 1, 2)"
_RESOLVED = f"""batch AS ({BATCH}),
named AS (SELECT b.*, coalesce(CAST(a.id AS VARCHAR), {_SLUG_ID.format(c='b.artist')}) AS artist_id FROM batch b LEFT JOIN artists a ON a.name = b.artist),
{_TITLES},
solved AS (
  SELECT n.*, coalesce(t.song_id, {_SLUG_ID.format(c="n.artist || '-' || n.title")}) AS song_id
  FROM named n LEFT JOIN titles t ON t.artist_id = n.artist_id AND t.t = lower(n.title)), """
_OFFERED = "SELECT chart_name, chart_territory, chart_week, song_id, CAST(rank AS INTEGER) AS position, seq, artist_id FROM solved"


def _weekly_sql(name: str) -> str:
    """``r``: weekly rows with artist_id, song_id and the id of the featured artist, taken from how the credits were made."""
    guest = "CAST((sid * 7 + 3) % 9 + 1 AS VARCHAR)"
    return f"""WITH wk AS ({WEEKLY[name]}), {_TITLES},
a AS (SELECT wk.*, CASE form WHEN 2 THEN sha256('fresh-' || sid % 9) ELSE CAST(s.artist_id AS VARCHAR) END AS artist_id, CAST(s.artist_id AS VARCHAR) AS own_id, lower(s.title) AS t FROM wk JOIN songs s ON s.id = wk.sid),
r AS (
  SELECT a.*, CASE form WHEN 2 THEN sha256('fresh-' || sid % 9 || '-' || replace(a.t, ' ', '-')) ELSE titles.song_id END AS song_id,
    CASE form WHEN 0 THEN {guest} WHEN 1 THEN sha256('new-act-' || sid % 6) WHEN 2 THEN own_id END AS featured_artist_id
  FROM a LEFT JOIN titles ON titles.artist_id = a.artist_id AND titles.t = a.t),
o AS (SELECT *, row_number() OVER (PARTITION BY week, song_id ORDER BY this_week) AS n FROM r)"""


def _entries_sql(name: str) -> str:
    s = SOURCES[name]
    source = f"'{s.source}'" if s.source else "CAST(NULL AS VARCHAR)"
    return f"""{_weekly_sql(name)} SELECT '{s.chart_name}' AS chart_name, '{s.chart_territory}' AS chart_territory, week AS chart_week, song_id, this_week AS position, artist_id,
 peak_position, weeks_on_chart, {source} AS source FROM o WHERE n = 1"""


_SQL: dict[str, str] = {
    "persist_entries": GREEDY.format(head=_RESOLVED, rows=_OFFERED) + """,
w AS (
  SELECT chart_name, chart_territory, chart_week, song_id, position, artist_id, true AS fresh FROM kept
  UNION ALL SELECT chart_name, chart_territory, chart_week, CAST(song_id AS VARCHAR), position, NULL, false FROM chart_entries WHERE chart_territory IS NOT NULL),
l AS (SELECT *, lag(position) OVER (PARTITION BY song_id, chart_name, chart_territory ORDER BY chart_week) AS prev FROM w)
SELECT chart_name, chart_territory, chart_week, song_id, position, artist_id, CAST(prev AS SMALLINT) AS prev_rank, CAST(abs(position - prev) AS SMALLINT) AS delta,
 CASE WHEN prev IS NULL THEN 'NEW' WHEN position < prev THEN 'UP' WHEN position > prev THEN 'DOWN' ELSE 'SAME' END AS trend FROM l WHERE fresh""",
    "persist_features": f"""WITH {_RESOLVED}
f AS (
  SELECT DISTINCT s.song_id, coalesce(CAST(g.id AS VARCHAR), {_SLUG_ID.format(c='s.guest')}) AS featured_artist_id
  FROM solved s LEFT JOIN artists g ON g.name = s.guest WHERE s.guest IS NOT NULL AND coalesce(CAST(g.id AS VARCHAR), '') <> s.artist_id)
SELECT * FROM f ANTI JOIN (SELECT CAST(song_id AS VARCHAR) AS song_id, CAST(featured_artist_id AS VARCHAR) AS featured_artist_id FROM song_features) USING (song_id, featured_artist_id)""",
    "persist_mentions": f"""WITH batch AS ({BATCH}), n AS (SELECT DISTINCT artist AS name FROM batch UNION SELECT guest FROM batch WHERE guest IS NOT NULL)
SELECT n.name, coalesce(CAST(a.id AS VARCHAR), {_SLUG_ID.format(c='n.name')}) AS entity_id, CASE WHEN a.id IS NULL THEN 'created' ELSE 'name' END AS matched_by,
 CASE WHEN n.name LIKE 'Nova%' THEN 'provisional' ELSE 'canonical' END AS entity_status FROM n LEFT JOIN artists a ON a.name = n.name""",
    "weekly_backfill": _entries_sql("hot_100"),
    "weekly_backfill_features": _weekly_sql("hot_100") + """, f AS (SELECT DISTINCT song_id, featured_artist_id FROM r WHERE featured_artist_id <> artist_id)
SELECT * FROM f ANTI JOIN (SELECT CAST(song_id AS VARCHAR) AS song_id, CAST(featured_artist_id AS VARCHAR) AS featured_artist_id FROM song_features) USING (song_id, featured_artist_id)""",
    "weekly_backfill_counters": _weekly_sql("hot_100") + " SELECT count(DISTINCT week) AS dates, count(*) FILTER (WHERE n = 1) AS entries FROM o",
    "weekly_backfill_uk": _entries_sql("uk"),
    "weekly_backfill_uk_mentions": f"""WITH wk AS ({WEEKLY['uk']}), s AS (SELECT wk.sid, wk.form, songs.artist_id FROM wk JOIN songs ON songs.id = wk.sid),
k AS (SELECT artist_id AS id, false AS low FROM s UNION SELECT (sid * 7 + 3) % 9 + 1, true FROM s WHERE form = 0),
n AS (SELECT 'New Act ' || sid % 6 AS name FROM s WHERE form = 1 UNION SELECT 'Fresh ' || sid % 9 FROM s WHERE form = 2)
SELECT CASE WHEN low THEN lower(a.name) ELSE a.name END AS name, CAST(a.id AS VARCHAR) AS entity_id, 'name' AS matched_by, 'canonical' AS entity_status FROM k JOIN artists a USING (id)
UNION ALL SELECT name, {_SLUG_ID.format(c='name')}, 'created', 'provisional' FROM n""",
    "identity_chains": f"""WITH m AS ({CHAINS}), p AS (SELECT *, chain % 3 = 0 AND link >= 4 AS late FROM m),
g AS (SELECT chain, late, min(link) AS first FROM p GROUP BY chain, late),
k AS (SELECT external_id, min(CAST(artist_id AS VARCHAR)) AS id FROM ({CHAIN_IDS}) GROUP BY external_id),
h AS (
  SELECT p.*, first, k.id, CASE WHEN k.id IS NULL THEN false WHEN link = 2 OR link = 1 THEN true ELSE false END AS direct,
    k.id IS NOT NULL AND NOT late AND EXISTS (SELECT 1 FROM m x WHERE x.chain = p.chain AND x.link IN (1, 2)) AS reached
  FROM p JOIN g USING (chain, late) LEFT JOIN k ON k.external_id = p.chain || '-2')
SELECT seq, name, CASE WHEN reached THEN id ELSE sha256('chain-' || chain || '-' || first) END AS entity_id,
 CASE WHEN direct THEN 'external' WHEN reached THEN 'batch' ELSE 'created' END AS matched_by, CASE WHEN reached THEN 'canonical' ELSE 'provisional' END AS entity_status FROM h""",
}
SQL: dict[str, str] = {k: whole(v) for k, v in _SQL.items()}
