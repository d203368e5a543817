"""The daily jobs as plans: what a batch of source rows adds to the tables.

Each takes tables and a batch, already read from its landing zone, and gives the rows to write (with
``store.merge`` and the rule named) and counters. The day is a parameter, so a job that runs again for
a day gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.functions import parse, text
from chartspark.operators import resolve, store
from chartspark.operators.relational import latest_by

LISTENERS = ("monthly_listeners", "daily_change", "peak_rank", "peak_listeners")


def merge_discovered(rows: DataFrame) -> DataFrame:
    """Discovered profiles (seq, spotify_id, name, appeared and LISTENERS) by id: appearances add up (at least one a row),
    the name is that seen first, listener figures come together from the first row that has listeners."""
    figures = F.struct(*LISTENERS)
    has = F.when(F.col("monthly_listeners").isNotNull(), F.struct("seq", figures.alias("f")))
    merged = rows.groupBy("spotify_id").agg(
        F.min(F.struct("seq", "name")).alias("first"), F.sum(F.greatest(F.coalesce("appeared", F.lit(0)), F.lit(1))).cast("long").alias("appeared"), F.min(has).alias("l")
    )
    return merged.select("spotify_id", "first.name", "first.seq", "appeared", *[F.col("l")["f"][c].alias(c) for c in LISTENERS])


def _groups(merged: DataFrame) -> DataFrame:
    by = merged.withColumn("normalized", text.name_c(F.col("name")))
    best = Window.partitionBy("normalized").orderBy(F.col("appeared").desc(), "seq")
    return by.withColumn("place", F.row_number().over(best))


def unique_discovered(merged: DataFrame) -> DataFrame:
    """Of profiles whose names have one normal form, that with most appearances, the first seen on a tie."""
    return _groups(merged).where("place = 1").drop("place", "normalized", "seq")


def duplicate_report(merged: DataFrame) -> DataFrame:
    """``normalized, kept_id, kept_name, rejected`` of names with several profiles; a name has few, so its list is short."""
    g = _groups(merged)
    kept = F.min(F.when(F.col("place") == 1, F.struct("spotify_id", "name")))
    lost = F.sort_array(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "spotify_id", "name", "appeared"))))
    out = g.groupBy("normalized").agg(kept.alias("kept"), lost.alias("rejected")).where(F.size("rejected") > 0)
    return out.select("normalized", F.col("kept.spotify_id").alias("kept_id"), F.col("kept.name").alias("kept_name"), F.transform("rejected", lambda x: F.struct(x["spotify_id"], x["name"], x["appeared"])).alias("rejected"))


def listener_sync(discovered: DataFrame, artists: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for ``listener_snapshots`` of artists that are in the catalogue, and ``updated, not_found, no_data`` counts."""
    known = artists.where("spotify_id is not null").groupBy("spotify_id").agg(F.min("id").alias("artist_id"))
    met = discovered.join(known, "spotify_id", "left")
    found, data = F.col("artist_id").isNotNull(), F.col("monthly_listeners").isNotNull()
    rows = met.where(found & data).select("artist_id", "spotify_id", day.alias("snapshot_date"), *LISTENERS)
    return rows, met.agg(F.count_if(found & data).alias("updated"), F.count_if(~found).alias("not_found"), F.count_if(found & ~data).alias("no_data"))


def seed(discovered: DataFrame, artists: DataFrame, day: Column) -> dict[str, DataFrame]:
    """What discovery adds (see ``resolve.route_discovered``): ``linked`` (id, spotify_id) patches, ``created`` artists and their
    ``external`` ids, ``snapshots`` of all that have listeners."""
    routed = resolve.route_discovered(discovered, artists)
    figures = discovered.select(F.col("seq").alias("_seq"), *[c for c in LISTENERS if c != "monthly_listeners"])
    routed = routed.join(figures, F.col("seq") == F.col("_seq")).drop("_seq")
    # Several new profiles with one slug are one artist; the first has the id.
    new = routed.where("route = 'create'").withColumn("slug", text.slug(text.collapse(F.col("name")))).where("slug <> ''")
    created = latest_by(new, ["slug"], [F.col("seq")]).withColumn("id", F.sha2("slug", 256))
    linked = latest_by(routed.where("route = 'link'"), ["artist_id"], [F.col("seq")])
    of = new.select("seq", F.sha2("slug", 256).alias("_new"))
    placed = routed.join(of, "seq", "left").withColumn("artist_id", F.coalesce("artist_id", "_new")).where("artist_id is not null and monthly_listeners is not null")
    sources = F.explode(F.array(*[F.lit(s) for s in ("spotify", "kworb")]))
    return {
        "routes": routed.select("seq", "spotify_id", "name", "route", "artist_id"),
        "linked": linked.select(F.col("artist_id").alias("id"), "spotify_id"),
        "created": created.select("id", "name", "slug", "spotify_id"),
        "external": created.select(F.col("id").alias("artist_id"), sources.alias("source"), F.col("spotify_id").alias("external_id")),
        "snapshots": placed.select("artist_id", "spotify_id", day.alias("snapshot_date"), *LISTENERS),
    }


def artist_snapshots(artists: DataFrame, totals: DataFrame, day: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for ``artist_snapshots`` of the artists that are followed, ids that the source does not know (``status`` 404), and
    ``succeeded, failed`` counts. ``totals``: spotify_id, status (200 where the page was read) and measures."""
    met = store.trackable(artists).select(F.col("id").alias("artist_id"), "spotify_id").join(totals, "spotify_id", "left")
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    measures = [c for c in totals.columns if c not in ("spotify_id", "status", "updated")]
    rows = met.where(ok).select("artist_id", day.alias("snapshot_date"), *measures, *([parse.source_date(F.col("updated")).alias("source_updated_at")] if "updated" in totals.columns else []))
    return rows, met.where("status = 404").select(F.col("artist_id").alias("id")), met.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def song_snapshots(artists: DataFrame, songs: DataFrame, pages: DataFrame, day: Column, aliases: DataFrame | None = None) -> DataFrame:
    """Rows for ``song_snapshots``: every song row (seq, spotify_id of the artist, track_id, title, streams, daily) resolved to a
    song, new ones created; the last row of a song counts."""
    who = store.trackable(artists).select(F.col("id").cast("string").alias("artist_id"), F.col("slug").alias("artist_slug"), "spotify_id")
    rows = pages.join(who, "spotify_id").withColumnRenamed("track_id", "spotify_track_id")
    known = songs.withColumn("artist_id", F.col("artist_id").cast("string"))
    solved = resolve.resolve_songs(rows.select("seq", "artist_id", "artist_slug", "title", "spotify_track_id"), known, aliases).select("seq", "entity_id", "matched_by")
    met = rows.join(solved, "seq").where("entity_id is not null")
    last = latest_by(met, ["entity_id"], [F.col("seq").desc()])
    return last.select(F.col("entity_id").alias("song_id"), day.alias("snapshot_date"), F.col("streams").alias("spotify_streams"), F.col("daily").alias("daily_streams"), "matched_by")


def enriched_artists(metadata: DataFrame) -> DataFrame:
    """Rows for ``artists`` from metadata (name, spotify_id, image_url, popularity)."""
    return store.named(metadata.withColumn("slug", text.slug(text.collapse(F.col("name"))))).withColumn("source_of_truth", F.lit("spotify"))


def enriched_songs(songs: DataFrame, albums: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for ``albums_scraped`` and patches of songs by ``id``, from track metadata (artist_id, spotify_track_id, title,
    release_date, duration_ms, explicit, image_url, spotify_album_id, album_title, album_type, total_tracks).

    An album that is there keeps its slug; editorial columns of songs and albums stay as they are.
    """
    have = albums.select("spotify_album_id", F.col("slug").alias("_slug"), F.col("id").cast("string").alias("_id"))
    album = latest_by(metadata.where("spotify_album_id is not null"), ["spotify_album_id"], [F.col("spotify_track_id").desc()]).join(have, "spotify_album_id", "left")
    made = text.album_slug(F.col("album_title"), F.col("spotify_album_id"))
    album = album.select(
        F.coalesce("_id", F.sha2("spotify_album_id", 256)).alias("id"), "artist_id", "spotify_album_id", F.col("album_title").alias("title"),
        F.coalesce("_slug", made).alias("slug"), F.coalesce("album_type", F.lit("album")).alias("album_type"), "release_date", "image_url", "total_tracks",
    )
    known = songs.where("spotify_track_id is not null").groupBy("spotify_track_id").agg(F.min("id").alias("id"))
    rows = metadata.join(known, "spotify_track_id").join(album.select("spotify_album_id", F.col("id").alias("album_id")), "spotify_album_id", "left")
    patch = rows.select(
        "id", "artist_id", "album_id", "title", text.title_form(F.col("title")).alias("normalized_title"), F.col("title").alias("canonical_title"), "spotify_track_id",
        "release_date", "duration_ms", "explicit", "image_url", F.lit("spotify").alias("source_of_truth"), F.lit(False).alias("needs_review"),
    )
    return album, patch


def certified_rows(awards: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows for ``certifications`` from award rows (seq, artist_id, title, level, units, certified_at as text): the song where it is
    known, none created; of rows with one title the last counts."""
    known = songs.withColumn("artist_id", F.col("artist_id").cast("string"))
    asked = awards.select("seq", F.col("artist_id").cast("string").alias("artist_id"), F.lit(None).cast("string").alias("artist_slug"), "title", F.lit(None).cast("string").alias("spotify_track_id"))
    solved = resolve.resolve_songs(asked, known, create=False).select("seq", F.col("entity_id").alias("song_id"))
    last = latest_by(awards.join(solved, "seq", "left"), ["artist_id", "title"], [F.col("seq").desc()])
    return last.select(
        "artist_id", "song_id", F.lit("US").alias("territory"), F.lit("RIAA").alias("body"), "title", parse.level(F.col("level")).alias("level"),
        parse.units(F.col("units")).alias("units"), parse.any_date(F.col("certified_at")).alias("certified_at"), F.when(F.col("song_id").isNull(), "artist_only").otherwise("matched").alias("resolution_status"),
    )


def origin_patches(artists: DataFrame, origins: DataFrame) -> DataFrame:
    """``id, origin_country`` of artists without one, from resolved origins (name, country)."""
    found = origins.where(F.upper(F.trim("country")).rlike("^[A-Z]{2}$")).groupBy("name").agg(F.min(F.upper(F.trim("country"))).alias("origin_country"))
    return store.missing(artists, "origin_country").drop("origin_country").join(found, "name").select("id", "origin_country")


def validated(children: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference has no parent; a null refers to nothing."""
    known = parents.select(F.col(key).alias("_known")).distinct()
    return children.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")
