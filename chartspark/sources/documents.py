"""Readers of landed JSON documents; schemas are stated, what is missing or of another type gets its default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions import text

ARTIST = "id string, name string, images array<struct<url string>>, followers struct<total bigint>, popularity int, genres array<string>"
TRACK = "id string, name string, album struct<id string, name string, album_type string, images array<struct<url string>>, release_date string, total_tracks int>, duration_ms int, explicit boolean"
WEEK = "data array<struct<song string, artist string, this_week int, peak_position int, weeks_on_chart int>>"
SEARCH = "artists array<struct<name string, score string, country string, area struct<`iso-3166-1-codes` array<string>>>>"


def _each(landed: DataFrame, field: str, kind: str) -> DataFrame:
    """One row ``x`` for each element that is not null of the list ``field`` of each document ``body``."""
    rows = landed.select(F.explode(F.from_json("body", f"{field} array<struct<{kind}>>")[field]).alias("x"))
    return rows.where("x is not null")


def artists(landed: DataFrame) -> DataFrame:
    rows = _each(landed, "artists", ARTIST)
    return rows.select(F.col("x.id").alias("spotify_id"), F.coalesce("x.name", F.lit("")).alias("name"), F.get("x.images", F.lit(0))["url"].alias("image_url"), F.coalesce("x.followers.total", F.lit(0)).alias("followers"), F.coalesce("x.popularity", F.lit(0)).alias("popularity"), F.coalesce(F.filter("x.genres", lambda g: g.isNotNull()), F.array().cast("array<string>")).alias("genres"))


def tracks(landed: DataFrame) -> DataFrame:
    rows = _each(landed, "tracks", TRACK)
    album = {"id": "spotify_album_id", "name": "album_name", "release_date": "release_date"}
    return rows.select(F.col("x.id").alias("spotify_track_id"), F.col("x.name").alias("title"), *[F.coalesce(f"x.album.{k}", F.lit("")).alias(v) for k, v in album.items()], F.coalesce("x.album.album_type", F.lit("album")).alias("album_type"), F.get("x.album.images", F.lit(0))["url"].alias("album_image_url"), F.coalesce("x.album.total_tracks", F.lit(0)).alias("total_tracks"), F.coalesce("x.duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("x.explicit", F.lit(False)).alias("explicit"))


def chart_dates(landed: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The dates of an index document (a JSON array), both ends included, newest first."""
    days = landed.select(F.explode(F.from_json("body", "array<string>")).alias("chart_week"))
    keep = F.lit(True) if first is None else F.col("chart_week") >= first
    return days.where(keep if last is None else keep & (F.col("chart_week") <= last)).orderBy(F.desc("chart_week"))


def weekly_entries(landed: DataFrame) -> DataFrame:
    """``chart_week, song, artist, this_week, peak_position, weeks_on_chart`` of documents (chart_week, body)."""
    return landed.select("chart_week", F.inline(F.from_json("body", WEEK)["data"]))


def origin_country(landed: DataFrame, sure: int = 95) -> DataFrame:
    """``name, origin_country``: that of the best scored candidate (first on a tie) of each search (name, body), if the
    names agree or its score is at least ``sure``; null otherwise."""

    def score(x: Column) -> Column:
        return F.coalesce(F.regexp_extract(x["score"], r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(0))

    found = F.coalesce(F.from_json("body", SEARCH)["artists"], F.from_json(F.lit("[]"), SEARCH.split(" ", 1)[1]))
    at = landed.select("name", found.alias("c")).withColumn("s", F.transform("c", score))
    best = at.withColumn("b", F.get("c", F.array_position("s", F.array_max("s")).cast("int") - 1)).withColumn("top", F.array_max("s"))
    agrees = (text.name_b(F.col("b.name")) == text.name_b(F.col("name"))) | (F.col("top") >= sure)
    code = F.upper(F.trim(F.coalesce(F.get(F.col("b")["area"]["iso-3166-1-codes"], F.lit(0)), F.col("b.country"))))
    return best.select("name", F.when(agrees & F.regexp_like(code, F.lit("^[A-Z]{2}$")), code).alias("origin_country"))
