"""Chart pages to ranked charts and to the tables: canonical rows, fusion of platforms and countries, persistence.

Rows are ``(list columns..., seq, rank, artist, title, featured)``; ``seq`` is the order of the pages.
Every operator works on all lists at once: the list columns (country, week, ...) are part of each
key, so one plan fuses any number of charts.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.functions import text
from chartspark.operators import relational as rel
from chartspark.operators import resolve
from chartspark.plans.staging import staged

NAMES = "array<string>"


def canonical(rows: DataFrame) -> DataFrame:
    """Rows with the lead artist alone, all others among ``featured``, and the track ``key``."""
    split = rows.withColumn("_split", text.split_artists(F.col("artist")))
    split = split.withColumn("featured", text.ordered_union(F.col("featured"), F.col("_split.others")))
    split = split.withColumn("artist", F.col("_split.lead")).drop("_split")
    return split.withColumn("key", text.track_key(F.col("artist"), F.col("title")))


def page_rows(rows: DataFrame) -> DataFrame:
    """Rows of raw titles with the bracketed credits taken out: ``title`` and ``featured``."""
    split = rows.withColumn("_split", text.extract_features(F.col("title")))
    return split.withColumns({"title": F.col("_split.title"), "featured": F.col("_split.featured")}).drop("_split")


def _ranked(df: DataFrame, by: Sequence[str], cap: int, *first: Column) -> DataFrame:
    """``rank`` 1 to ``cap`` of each list: ``first``, then title and artist in language order, then key."""
    order = [*first, F.collate("title", "UNICODE_CI"), F.collate("artist", "UNICODE_CI"), F.col("key")]
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= cap)


def combined(rows: DataFrame, by: Sequence[str], weights: Mapping[str, float], max_rank: int = 200, cap: int = 100) -> DataFrame:
    """One chart of the platforms (column ``platform``) of each list: ``rank, artist, title, featured, score`` and
    ``<platform>_rank``. A track counts once a platform, at its best rank; the first platform of ``weights`` names it."""
    rows = canonical(rows.where(F.col("rank") <= max_rank))
    kept = F.struct("rank", "seq", "artist", "title", "featured")
    best = [F.min(F.when(F.col("platform") == p, kept)).alias(p) for p in weights]
    f = rows.where(F.col("platform").isin(*weights)).groupBy(*by, "key").agg(*best)
    score = sum((F.lit(w) * rel.points(F.col(p)["rank"], max_rank) for p, w in weights.items()), F.lit(0))
    f = f.select(
        *by, "key",
        *[F.coalesce(*[F.col(p)[c] for p in weights]).alias(c) for c in ("artist", "title")],
        text.ordered_union(*[F.col(p)["featured"] for p in weights]).alias("featured"),
        score.alias("score"),
        *[F.col(p)["rank"].alias(f"{p}_rank") for p in weights],
    )
    best_rank = F.least(*[F.col(f"{p}_rank") for p in weights], F.lit(2**31 - 1))
    return _ranked(f, by, cap, F.col("score").desc(), best_rank)


def regional(rows: DataFrame, by: Sequence[str], platforms: Mapping[str, float], countries: Mapping[str, float], max_rank: int = 200, cap: int = 50) -> DataFrame:
    """One chart of all countries and platforms: points of every row add up, duplicates of a page too; artist and title of the
    first row, featured artists in the order of rows."""
    weight = lambda column, of: F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in of.items()])
    rows = canonical(rows.where((F.col("rank") <= max_rank) & F.col("country").isin(*countries) & F.col("platform").isin(*platforms)))
    rows = rows.withColumn("points", rel.points(F.col("rank"), max_rank) * weight("platform", platforms) * weight("country", countries))
    g = rows.groupBy(*by, "key").agg(
        F.sum("points").alias("score"),
        F.min("rank").alias("best_rank"),
        F.min(F.struct("seq", "artist", "title")).alias("first"),
        F.sort_array(F.collect_list(F.struct("seq", "featured"))).alias("credits"),
    )
    featured = text.dedupe_order(F.flatten(F.transform("credits", lambda x: F.coalesce(x["featured"], F.array().cast(NAMES)))))
    g = g.select(*by, "key", "score", "best_rank", "first.artist", "first.title", featured.alias("featured"))
    return _ranked(g, by, cap, F.col("score").desc(), F.col("best_rank"))


def flat(rows: DataFrame, by: Sequence[str], max_rank: int = 200, cap: int = 50, first: int | None = None) -> DataFrame:
    """Each list without its repeated tracks, the best ``cap`` at their own ranks (so ranks may have gaps). ``first``: only
    so many rows of each page are read."""
    if first is not None:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("_at") <= first).drop("_at")
    rows = canonical(rows.where(F.col("rank") <= max_rank))
    best = rows.groupBy(*by, "key").agg(F.min(F.struct("rank", "seq", "artist", "title", "featured")).alias("b")).select(*by, "key", "b.*")
    at = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "seq"))
    return best.withColumn("_at", at).where(F.col("_at") <= cap).drop("_at", "seq")


def weekly_rows(rows: DataFrame, slash: bool = False) -> DataFrame:
    """Rows of a weekly chart (with ``artist`` as its credit) with the first artist alone and the others ``featured``."""
    credit = rows.withColumn("_all", text.split_credit(text.collapse(F.col("artist")), slash))
    others = F.filter("_all", lambda x, i: i > 0)
    return credit.withColumns({"artist": F.get("_all", F.lit(0)), "featured": text.dedupe_order(others), "title": text.collapse(F.col("title"))}).drop("_all")


#: What a song may hold once in a chart and week, and a position too.
CHART = ["chart_name", "chart_territory", "chart_week"]
#: Columns that a batch may bring for its entries besides the keys.
CARRIED = ("peak_position", "weeks_on_chart", "source")
#: What a batch adds.
PARTS = ("mentions", "songs", "features", "entries")


def resolved(rows: DataFrame, artists: DataFrame, songs: DataFrame, provisional: bool = False, featured_provisional: bool = True, **known: DataFrame) -> dict[str, DataFrame]:
    """``mentions`` of artists, ``titles`` of songs and ``credited`` rows (with ``artist_id, song_id``) of canonical rows (seq,
    artist, title, featured, ...), every name and title resolved once.

    A new artist is provisional as its first mention says: ``provisional`` for a lead, ``featured_provisional`` for others. A
    row whose artist or song comes to nothing is left out. ``known``: tables of aliases and external ids, as ``artist_aliases,
    artist_external_ids, song_aliases, song_external_ids``.
    """
    lead = rows.select(F.struct("seq", F.lit(0).alias("i")).alias("seq"), F.col("artist").alias("name"), F.lit(provisional).alias("provisional"))
    more = rows.select("seq", F.posexplode("featured").alias("i", "name")).select(F.struct("seq", (F.col("i") + 1).alias("i")).alias("seq"), "name", F.lit(featured_provisional).alias("provisional"))
    names = lead.unionByName(more).where("name is not null").groupBy("name").agg(F.min_by("provisional", "seq").alias("provisional"), F.min("seq").alias("seq"))
    names = names.withColumn("spotify_id", F.lit(None).cast("string"))
    who = resolve.resolve_artists(names, artists, known.get("artist_aliases"), known.get("artist_external_ids"))
    who = staged(who.select("name", "entity_id", "matched_by", "entity_status"), "who")
    slugs = artists.select(F.col("id").cast("string").alias("artist_id"), F.col("slug").alias("artist_slug"))
    named = who.where("entity_id is not null").select(F.col("name").alias("artist"), F.col("entity_id").alias("artist_id"))
    r = rows.join(named, "artist").join(slugs, "artist_id", "left")
    r = r.withColumn("artist_slug", F.coalesce("artist_slug", text.slug(text.collapse(F.col("artist"))))).withColumn("spotify_track_id", F.lit(None).cast("string"))
    r = staged(r, "named")
    titles = resolve.resolve_songs(
        r.select("seq", "artist_id", "artist_slug", "title", "spotify_track_id"), songs.withColumn("artist_id", F.col("artist_id").cast("string")),
        known.get("song_aliases"), provisional=provisional, external=known.get("song_external_ids"),
    )
    titles = staged(titles, "titles")
    found = titles.where("entity_id is not null").select("seq", F.col("entity_id").alias("song_id"))
    return {"mentions": who, "titles": titles, "credited": staged(r.join(found, "seq"), "credited")}


def credited_features(credited: DataFrame, who: DataFrame, features: DataFrame) -> DataFrame:
    """New rows of (song_id, featured_artist_id): featured artists other than the lead, each once."""
    named = who.where("entity_id is not null").select("name", F.col("entity_id").alias("featured_artist_id"))
    credit = credited.select("song_id", "artist_id", F.explode("featured").alias("name")).join(named, "name")
    fresh = credit.where("featured_artist_id <> artist_id").select("song_id", "featured_artist_id").distinct()
    had = features.select(F.col("song_id").cast("string").alias("song_id"), F.col("featured_artist_id").cast("string").alias("featured_artist_id"))
    return fresh.join(had, ["song_id", "featured_artist_id"], "left_anti")


def accepted(credited: DataFrame, entries: DataFrame) -> DataFrame:
    """Chart entries of credited rows, in the order of ``seq`` where neither their song nor their position is taken in their
    chart and week, by the batch or by ``entries``."""
    extra = [c for c in CARRIED if c in credited.columns]
    offered = credited.select(*CHART, "song_id", F.col("rank").cast("int").alias("position"), "seq", "artist_id", *extra)
    there = entries.select(*CHART, F.col("song_id").cast("string").alias("song_id"), "position")
    free = offered.join(there.select(*CHART, "song_id"), [*CHART, "song_id"], "left_anti").join(there.select(*CHART, "position"), [*CHART, "position"], "left_anti")
    return rel.greedy_insert(free.select(*CHART, "song_id", "position", "seq", "artist_id", *extra))


def trended(taken: DataFrame, entries: DataFrame) -> DataFrame:
    """``taken`` with ``prev_rank, delta, trend`` against the week before among all entries: a backfilled week also counts for
    its successor in the batch."""
    there = entries.select(*CHART, F.col("song_id").cast("string").alias("song_id"), "position")
    touched = there.join(taken.select("chart_name", "song_id").distinct(), ["chart_name", "song_id"], "left_semi")
    kept = [c for c in taken.columns if c not in there.columns]
    every = taken.withColumn("new", F.lit(True)).unionByName(touched.withColumn("new", F.lit(False)), allowMissingColumns=True)
    every = every.withColumn("prev", rel.previous_position()).where("new")
    return every.select(
        *CHART, "song_id", "position", *kept, F.col("prev").cast("short").alias("prev_rank"), F.abs(F.col("position") - F.col("prev")).cast("short").alias("delta"),
        rel.trend(F.col("prev"), F.col("position")).alias("trend"),
    )


def persisted(rows: DataFrame, artists: DataFrame, songs: DataFrame, entries: DataFrame, features: DataFrame, provisional: bool = False, parts: Collection[str] = PARTS) -> dict[str, DataFrame]:
    """What a batch of canonical chart rows adds: ``mentions`` (artists resolved or created), ``songs``, ``features`` and
    ``entries`` with ``prev_rank, delta, trend``.

    ``rows``: seq, chart_name, chart_territory, chart_week, rank, artist, title, featured. Each step is written once and read
    by the next: the rows, who and what they name, the credited rows, the accepted entries. Featured artists that are new
    are provisional, whatever the source is. ``parts``: those that are wanted; entries are accepted only for ``entries``.
    """
    found = resolved(staged(rows, "rows"), artists, songs, provisional)
    songs_found = found["titles"].where("entity_id is not null").select("seq", F.col("entity_id").alias("song_id"), F.col("matched_by").alias("song_matched_by"))
    out = {"mentions": found["mentions"], "songs": songs_found, "features": credited_features(found["credited"], found["mentions"], features)}
    if "entries" in parts:
        entries = staged(entries.select(*CHART, "song_id", "position"), "entries")
        out["entries"] = trended(staged(accepted(found["credited"], entries), "taken"), entries)
    return {part: out[part] for part in parts}
