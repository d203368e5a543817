"""The thirteen read models. Each takes the tables (by name) and gives a lazy DataFrame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.operators.relational import latest_by, lookback
from chartspark.plans.fixtures import Tables

SNAPSHOT_ORDER = "snapshot_date"


def territory() -> Column:
    return F.coalesce("chart_territory", F.lit("GLOBAL"))


def _artists(t: Tables, *extra: str, image: str = "artist_image_url", flag: str = "is_afrobeats") -> DataFrame:
    return t["artists"].select(
        F.col("id").alias("artist_id"),
        F.col("name").alias("artist_name"),
        F.col("slug").alias("artist_slug"),
        F.col("image_url").alias(image),
        F.col("is_afrobeats").alias(flag),
        "origin_country",
        *extra,
    )


def _songs(t: Tables) -> DataFrame:
    return t["songs"].select(
        F.col("id").alias("song_id"),
        F.col("artist_id").alias("song_artist_id"),
        F.col("title").alias("song_title"),
        F.col("slug").alias("song_slug"),
        "spotify_track_id",
        F.col("is_afrobeats").alias("song_is_afrobeats"),
        "release_date",
        F.col("image_url").alias("song_image_url"),
    )


def song_chart_summary(t: Tables) -> DataFrame:
    """Aggregated on ids first, so the dimensions join the few groups and not every entry."""
    p = F.col("position")
    keys = ["song_id", "artist_id", "chart_name", territory().alias("chart_territory")]
    whole = t["chart_entries"].where("song_id is not null and artist_id is not null")
    g = whole.groupBy(*keys).agg(
        F.min("position").alias("peak_position"),
        F.max("weeks_on_chart").alias("max_weeks_on_chart"),
        F.count(F.lit(1)).alias("total_chart_weeks"),
        F.count_if(p == 1).alias("weeks_at_number_1"),
        F.count_if(p <= 10).alias("weeks_in_top_10"),
        F.count_if(p <= 40).alias("weeks_in_top_40"),
        F.min("chart_week").alias("first_charted"),
        F.max("chart_week").alias("last_charted"),
    )
    return song_chart_dimensions(g, t)


def song_chart_dimensions(groups: DataFrame, t: Tables) -> DataFrame:
    joined = groups.join(_songs(t), "song_id").join(_artists(t, flag="artist_is_afrobeats"), "artist_id")
    return joined.drop("song_artist_id", "song_image_url")


def artist_dimensions(groups: DataFrame, t: Tables) -> DataFrame:
    return groups.join(_artists(t), "artist_id")


def chart_latest_leaderboard(t: Tables) -> DataFrame:
    """The latest entry of each song in each chart, with its trend as stored when it was persisted (null where none was)."""
    e = t["chart_entries"].where("song_id is not null and artist_id is not null").select(
        F.col("id").alias("entry_id"), "song_id", "artist_id", "chart_name", territory().alias("chart_territory"), "position", "peak_position", "weeks_on_chart", "chart_week",
    )
    e = latest_by(e, ["chart_name", "chart_territory", "song_id"], [F.col("chart_week").desc(), F.col("entry_id")])
    e = e.join(t["chart_entry_snapshots"].select("entry_id", "prev_rank", "delta", "trend"), "entry_id", "left")
    songs = _songs(t).drop("song_artist_id", "song_is_afrobeats", "release_date")
    return e.join(songs, "song_id").join(_artists(t).drop("origin_country"), "artist_id")


def artist_stream_summary(t: Tables) -> DataFrame:
    columns = ["artist_id", "total_streams", "total_streams_as_lead", "total_streams_as_feature", "daily_streams", "track_count", "snapshot_date"]
    s = latest_by(t["artist_stats_snapshots"].select(*columns), ["artist_id"], [F.col(SNAPSHOT_ORDER).desc()])
    return s.join(_artists(t, "spotify_id", "popularity"), "artist_id")


def song_stream_summary(t: Tables) -> DataFrame:
    s = latest_by(t["song_stats_snapshots"], ["song_id"], [F.col(SNAPSHOT_ORDER).desc()])
    s = s.select("song_id", F.col("spotify_streams").alias("total_spotify_streams"), "daily_streams", "snapshot_date")
    songs = _songs(t).withColumnRenamed("song_artist_id", "artist_id")
    return s.join(songs, "song_id").join(_artists(t, flag="artist_is_afrobeats"), "artist_id")


def artist_certification_summary(t: Tables) -> DataFrame:
    levels = [F.count_if(F.col("level") == x).alias(f"{x}_count") for x in ("diamond", "platinum", "gold", "silver")]
    g = t["certifications"].where("artist_id is not null").groupBy("artist_id", "territory", "body").agg(
        F.count(F.lit(1)).alias("total_certifications"),
        *levels,
        F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("total_platinum_units"),
        F.max("certified_at").alias("latest_certification"),
        F.min("certified_at").alias("earliest_certification"),
    )
    return g.join(_artists(t), "artist_id")


def artist_chart_summary(t: Tables) -> DataFrame:
    """Entries are read once: each goes to its own artist and to those featured on its song (a short list a song).

    Weeks are few, so their distinct count is the size of a set; songs are the one distinct aggregate.
    """
    featured = t["song_features"].groupBy("song_id").agg(F.collect_list("featured_artist_id").alias("featured"))
    e = t["chart_entries"].where("song_id is not null").join(featured, "song_id", "left")
    credit = lambda who, role: F.struct(who.alias("artist_id"), F.lit(role).alias("role"))
    others = F.transform(F.coalesce("featured", F.array()), lambda a: credit(a, "feature"))
    e = e.withColumn("credit", F.explode(F.concat(F.array(credit(F.col("artist_id"), "primary")), others)))
    e = e.select("credit.*", "chart_name", territory().alias("chart_territory"), "song_id", "chart_week", "position")
    p = F.col("position")
    g = e.where("artist_id is not null").groupBy("artist_id", "chart_name", "chart_territory", "role").agg(
        F.size(F.collect_set("chart_week")).cast("long").alias("total_chart_weeks"),
        F.count_distinct("song_id").alias("distinct_songs_charted"),
        F.min("position").alias("best_peak_position"),
        F.count_if(p == 1).alias("weeks_at_number_1"),
        F.count_if(p <= 10).alias("weeks_in_top_10"),
        F.min("chart_week").alias("first_chart_appearance"),
        F.max("chart_week").alias("latest_chart_appearance"),
    )
    return g.join(_artists(t), "artist_id")


def _growth(s: DataFrame, key: str) -> DataFrame:
    """Against the rows of exactly one day before (daily) and seven days before (total)."""
    day = F.col("daily_streams") - lookback(key, "snapshot_date", "daily_streams", 1)
    week = F.col("total_streams") - lookback(key, "snapshot_date", "total_streams", 7)
    return s.select(key, "snapshot_date", "daily_streams", "total_streams", day.alias("daily_growth"), week.alias("growth_7d"))


def artist_growth_summary(t: Tables) -> DataFrame:
    return _growth(t["artist_stats_snapshots"], "artist_id").join(_artists(t, image="image_url"), "artist_id")


def _momentum(df: DataFrame, daily: str, week: str) -> DataFrame:
    """In decimals, which are exact, and then as a double."""
    score = f"cast(coalesce(daily_growth, 0) * {daily} + coalesce(growth_7d, 0) * {week} as double)"
    return df.withColumn("momentum_score", F.expr(score))


def artist_trending_of(growth: DataFrame) -> DataFrame:
    return _momentum(growth, "0.6", "0.4")


def artist_trending_summary(t: Tables) -> DataFrame:
    return artist_trending_of(artist_growth_summary(t))


def song_growth_summary(t: Tables) -> DataFrame:
    s = _growth(t["song_stats_snapshots"].withColumnRenamed("spotify_streams", "total_streams"), "song_id")
    songs = _songs(t).select("song_id", "song_title", "song_slug", F.col("song_artist_id").alias("artist_id"))
    return s.join(songs, "song_id").join(_artists(t).select("artist_id", "artist_name", "artist_slug"), "artist_id")


def song_trending_of(growth: DataFrame) -> DataFrame:
    return _momentum(growth, "0.7", "0.3")


def song_trending_summary(t: Tables) -> DataFrame:
    return song_trending_of(song_growth_summary(t))


def artist_country_summary(t: Tables) -> DataFrame:
    return artist_country_of(artist_stream_summary(t))


def artist_country_of(streams: DataFrame) -> DataFrame:
    s = streams.withColumnRenamed("artist_image_url", "image_url")
    return s.select("origin_country", "artist_id", "artist_name", "artist_slug", "image_url", "is_afrobeats", "total_streams", "daily_streams")


def artist_recent_chart_summary(t: Tables, as_of: date | None = None) -> DataFrame:
    day = F.lit(as_of) if as_of else F.current_date()
    p = F.col("position")
    recent = t["chart_entries"].where(F.col("chart_week") >= F.date_sub(day, 90))
    g = recent.groupBy("artist_id", "chart_name", territory().alias("chart_territory")).agg(
        F.count(F.lit(1)).alias("chart_entries"),
        F.count_if(p <= 10).alias("top_10s"),
        F.count_if(p == 1).alias("number_1s"),
        F.min("position").alias("best_peak"),
        F.min("chart_week").alias("first_recent_entry"),
        F.max("chart_week").alias("latest_recent_entry"),
    )
    return g.join(_artists(t, image="image_url").drop("origin_country"), "artist_id")


def artist_monthly_listener_summary(t: Tables) -> DataFrame:
    s = latest_by(t["artist_monthly_listener_snapshots"], ["artist_id"], [F.col(SNAPSHOT_ORDER).desc()])
    return s.join(_artists(t), "artist_id")


#: In an order in which each view follows those it is made of.
VIEWS = {
    f.__name__: f
    for f in (
        song_chart_summary, chart_latest_leaderboard, artist_stream_summary, song_stream_summary,
        artist_certification_summary, artist_chart_summary, artist_growth_summary, artist_trending_summary,
        song_growth_summary, song_trending_summary, artist_country_summary, artist_recent_chart_summary,
        artist_monthly_listener_summary,
    )
}

