"""Queries of chart rows, fusion and persistence over all lists of the model, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.functions import text
from chartspark.operators import charts
from chartspark.operators import relational as rel
from chartspark.plans.fixtures import Tables, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

#: Raw rows of chart pages, as two platforms write them, for every country and week.
PAGES = """SELECT chart_territory AS country, chart_week AS week, CASE WHEN chart_name = '1-URGENT' THEN 'spotify' ELSE 'apple' END AS platform, position AS rank,
  position + CASE WHEN chart_name = '1-URGENT' THEN 0 ELSE 1000 END + CASE chart_territory WHEN 'AFRICA' THEN 0 WHEN 'ASIA' THEN 10000 WHEN 'EUROPE' THEN 20000 ELSE 30000 END AS seq,
  CASE song_id % 4 WHEN 0 THEN concat('Act', song_id % 60, ' & Guest', song_id % 5) WHEN 1 THEN concat('ACT', song_id % 60, ' feat. Someone') WHEN 2 THEN concat('Act', song_id % 60) ELSE concat(' act', song_id % 60, '  x Duo') END AS artist,
  CASE song_id % 3 WHEN 0 THEN concat('Song ', song_id % 60, ' (feat. Guest', song_id % 7, ', Friend)') WHEN 1 THEN concat('Song  ', song_id % 60, ' [Remix ft. other & Guest1]') ELSE concat('SONG ', song_id % 60) END AS title
 FROM chart_entries WHERE chart_territory IS NOT NULL AND chart_name IN ('1-URGENT', '2-HIGH')"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return charts.page_rows(Tables(spark, d).sql(PAGES))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("featured", F.array_join("featured", "|"))


def _combined(spark: SparkSession, d: str) -> DataFrame:
    out = charts.combined(_pages(spark, d), ["country", "week"], {"spotify": 1, "apple": 1}, max_rank=100, cap=100)
    return _joined(out.withColumn("score", F.col("score").cast("long")))


def _regional(spark: SparkSession, d: str) -> DataFrame:
    out = charts.regional(_pages(spark, d), ["week"], {"spotify": 1, "apple": 2}, {"AFRICA": 3, "ASIA": 1, "EUROPE": 2}, max_rank=100, cap=50)
    return _joined(out.withColumn("score", F.col("score").cast("long")))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    raw = F.concat("p_name", F.lit(" & é! ("), "p_brand", F.lit(")*'~"))
    url = text.weekly_chart_url(F.lit("https://x.com"), F.date_add(F.lit("2024-01-05").cast("date"), F.col("p_size").cast("int")), F.lit("singles"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", text.component(raw).alias("encoded"), url.alias("url"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    raw = F.concat(F.lit("  « "), F.upper("p_name"), F.lit(" »\u00a0‚"), F.col("p_brand"), F.lit("‛  [x]"))
    return p.select("p_partkey", text.normalize_all(raw).alias("whole"), text.ascii_quotes(raw).alias("quotes"), text.track_key(F.col("p_brand"), raw).alias("key"))


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d)["chart_entries"]
    rows = e.select("chart_name", "chart_territory", "chart_week", (F.col("song_id") % 500).alias("song_id"), (F.col("position") % 60).alias("position"), F.col("id").alias("seq"))
    return rel.greedy_insert(rows)


QUERIES: dict[str, Query] = {
    "canonical_rows": lambda spark, d: _joined(charts.canonical(_pages(spark, d))),
    "track_keys": _keys,
    "combined_top_100": _combined,
    "regional_top_50": _regional,
    "flat_top_50": lambda spark, d: _joined(charts.flat(_pages(spark, d), ["country", "week", "platform"], max_rank=90, cap=50)),
    "flat_global": lambda spark, d: _joined(charts.flat(_pages(spark, d), ["week", "platform"], cap=40, first=60)),
    "chart_greedy_insert": _greedy,
    "url_components": _encoded,
}

_BLOCK = r"(?i)\(([^)]*?(?:\bfeat\.?\b|\bft\.?\b|\bfeaturing\b|\bwith\b|w/|w\.)[^)]*)\)"
_SPLIT = r"(?i)\s*(?:,|&| and |\bx\b|×|\+)\s*"
_STRIP = "x"
for _marker in (r"\bfeat\.?\s*", r"\bft\.?\s*", r"\bfeaturing\s*", r"\bwith\s*", r"\bw/\s*", r"\bw\.\s*"):
    _STRIP = f"regexp_replace({_STRIP}, '(?i){_marker}', '')"
_PARTS = "list_filter(list_transform(string_split_regex({s}, '" + _SPLIT + "'), lambda y: trim(y)), lambda y: y <> '')"
_ONCE = "list_filter({l}, lambda v, i: list_position(list_transform({l}, lambda y: lower(y)), lower(v)) = i)"
_TIDY = "trim(regexp_replace(translate({c}, '[]', '()'), '\\s+', ' ', 'g'))"
#: Canonical rows: c(country, week, platform, rank, seq, artist, title, featured, key).
_CANON = f"""WITH raw AS ({PAGES}),
t AS (SELECT *, {_TIDY.format(c='title')} AS t0, trim(regexp_replace(regexp_replace(trim(regexp_replace(artist, '\\s+', ' ', 'g')), '(?i)\\b(?:feat\\.?|ft\\.?|featuring|with|w/|w\\.)\\b.*$', ''), ' +$', '')) AS a0 FROM raw),
f AS (SELECT *, flatten(list_transform(regexp_extract_all(t0, '{_BLOCK}', 1), lambda x: {_PARTS.format(s=f"trim({_STRIP})")})) AS tf, {_PARTS.format(s='a0')} AS ap,
  trim(regexp_replace(regexp_replace(t0, '{_BLOCK}', '', 'g'), '\\s+', ' ', 'g')) AS tt FROM t),
g AS (SELECT *, list_concat({_ONCE.format(l='tf')}, ap[2:]) AS every FROM f),
c AS (SELECT country, week, platform, rank, seq, ap[1] AS artist, tt AS title, {_ONCE.format(l='every')} AS featured, lower(ap[1]) || '::' || lower(tt) AS key FROM g)"""
GREEDY = """WITH RECURSIVE {head}o AS (SELECT *, row_number() OVER (PARTITION BY chart_name, chart_territory, chart_week ORDER BY seq) AS i FROM ({rows}) WHERE chart_territory IS NOT NULL),
r AS (
  SELECT chart_name, chart_territory, chart_week, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS songs, CAST([] AS VARCHAR[]) AS places, false AS ok FROM (SELECT DISTINCT chart_name, chart_territory, chart_week FROM o)
  UNION ALL
  SELECT r.chart_name, r.chart_territory, r.chart_week, o.i,
    CASE WHEN list_contains(songs, CAST(o.song_id AS VARCHAR)) OR list_contains(places, CAST(o.position AS VARCHAR)) THEN songs ELSE list_append(songs, CAST(o.song_id AS VARCHAR)) END,
    CASE WHEN list_contains(songs, CAST(o.song_id AS VARCHAR)) OR list_contains(places, CAST(o.position AS VARCHAR)) THEN places ELSE list_append(places, CAST(o.position AS VARCHAR)) END,
    NOT (list_contains(songs, CAST(o.song_id AS VARCHAR)) OR list_contains(places, CAST(o.position AS VARCHAR)))
  FROM r JOIN o ON o.chart_name = r.chart_name AND o.chart_territory = r.chart_territory AND o.chart_week = r.chart_week AND o.i = r.i + 1),
kept AS (SELECT o.* FROM o JOIN r USING (chart_name, chart_territory, chart_week, i) WHERE r.ok) """
_SQL: dict[str, str] = {
    "canonical_rows": _CANON + " SELECT country, week, platform, rank, seq, artist, title, array_to_string(featured, '|') AS featured, key FROM c",
    "combined_top_100": _CANON + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, week, platform, key ORDER BY rank, seq) AS n FROM c WHERE rank <= 100) WHERE n = 1),
j AS (SELECT coalesce(s.country, a.country) AS country, coalesce(s.week, a.week) AS week, coalesce(s.key, a.key) AS key, coalesce(s.artist, a.artist) AS artist, coalesce(s.title, a.title) AS title,
  list_concat(coalesce(s.featured, []), coalesce(a.featured, [])) AS fs, CAST(coalesce(101 - s.rank, 0) + coalesce(101 - a.rank, 0) AS BIGINT) AS score, s.rank AS spotify_rank, a.rank AS apple_rank
  FROM (SELECT * FROM best WHERE platform = 'spotify') s FULL JOIN (SELECT * FROM best WHERE platform = 'apple') a ON a.country = s.country AND a.week = s.week AND a.key = s.key),
r AS (SELECT *, row_number() OVER (PARTITION BY country, week ORDER BY score DESC, least(spotify_rank, apple_rank), lower(title), lower(artist), key) AS rank FROM j)
SELECT country, week, key, artist, title, array_to_string({_ONCE.format(l='fs')}, '|') AS featured, score, spotify_rank, apple_rank, rank FROM r WHERE rank <= 100""",
    "regional_top_50": _CANON + f""", p AS (SELECT *, (101 - rank) * CASE platform WHEN 'spotify' THEN 1 ELSE 2 END * CASE country WHEN 'AFRICA' THEN 3 WHEN 'ASIA' THEN 1 ELSE 2 END AS pts FROM c WHERE rank <= 100 AND country IN ('AFRICA', 'ASIA', 'EUROPE')),
rg AS (SELECT week, key, CAST(sum(pts) AS BIGINT) AS score, min(rank) AS best_rank, arg_min(artist, seq) AS artist, arg_min(title, seq) AS title, flatten(list(featured ORDER BY seq)) AS fs FROM p GROUP BY week, key),
r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY score DESC, best_rank, lower(title), lower(artist), key) AS rank FROM rg)
SELECT week, key, score, best_rank, artist, title, array_to_string({_ONCE.format(l='fs')}, '|') AS featured, rank FROM r WHERE rank <= 50""",
    "flat_top_50": _CANON + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, week, platform, key ORDER BY rank, seq) AS n FROM c WHERE rank <= 90) WHERE n = 1)
SELECT country, week, platform, key, rank, artist, title, array_to_string(featured, '|') AS featured FROM (SELECT *, row_number() OVER (PARTITION BY country, week, platform ORDER BY rank, seq) AS at_ FROM b) WHERE at_ <= 50""",
    "flat_global": _CANON + """, q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week, platform ORDER BY seq) AS o FROM c) WHERE o <= 60),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week, platform, key ORDER BY rank, seq) AS n FROM q WHERE rank <= 200) WHERE n = 1)
SELECT week, platform, key, rank, artist, title, array_to_string(featured, '|') AS featured FROM (SELECT *, row_number() OVER (PARTITION BY week, platform ORDER BY rank, seq) AS at_ FROM b) WHERE at_ <= 40""",
    "track_keys": """WITH p AS (SELECT p_partkey, p_brand, concat('  « ', upper(p_name), ' »', chr(160), '‚', p_brand, '‛  [x]') AS raw FROM part)
SELECT p_partkey, trim(regexp_replace(replace(translate(raw, '«»', '()'), chr(160), ''), ' +', ' ', 'g')) AS whole, translate(raw, '‚‛«»', '''''""') AS quotes,
 lower(p_brand) || '::' || lower(trim(regexp_replace(replace(translate(raw, '‚‛«»', '''''""'), chr(160), ' '), ' +', ' ', 'g'))) AS key FROM p""",
    "chart_greedy_insert": GREEDY.format(head="", rows="SELECT chart_name, chart_territory, chart_week, song_id % 500 AS song_id, position % 60 AS position, id AS seq FROM chart_entries")
    + "SELECT chart_name, chart_territory, chart_week, song_id, position, seq FROM kept UNION ALL SELECT chart_name, chart_territory, chart_week, song_id % 500, position % 60, id FROM chart_entries WHERE chart_territory IS NULL",
}
_SQL |= {
    "url_components": """SELECT p_partkey, replace(replace(replace(replace(replace(url_encode(p_name || ' & é! (' || p_brand || ')*' || chr(39) || '~'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS encoded,
 'https://x.com/charts/singles/' || strftime(DATE '2024-01-05' + CAST(p_size AS INTEGER), '%Y%m%d') || '/' || p_partkey || '/' AS url FROM part""",
}


def whole(sql: str) -> str:
    """RECURSIVE has to stand first where the fixtures are put in front."""
    return with_fixtures(sql.replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE" in sql else with_fixtures(sql)


SQL: dict[str, str] = {k: whole(v) for k, v in _SQL.items()}
