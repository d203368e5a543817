"""Keyed writes and lookups of the music model, as plans from tables to tables.

Plain Parquet has no MERGE, so a write is a new version of its table: one full join of the target
with the batch, reduced first to the last row of each key. A key with a null never conflicts. What
a conflict overwrites differs from table to table and is stated in ``RULES``; clean-up of what
refers to deleted rows is in ``REFERENCES``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.functions import text
from chartspark.operators.relational import latest_by
from chartspark.plans.staging import staged


@dataclass(frozen=True)
class Rule:
    """On a conflict of ``keys``, ``update`` takes the batch's values, ``fill`` takes them where they are not null, all
    other columns stay. ``insert`` has the values of new rows where the batch has none. ``touch``: a conflict renews
    ``updated_at``."""

    keys: tuple[str, ...]
    update: tuple[str, ...]
    fill: tuple[str, ...] = ()
    insert: Mapping[str, object] = field(default_factory=dict)
    touch: bool = False


_ALBUM = ("artist_id", "title", "slug", "album_type", "release_date", "image_url", "total_tracks")
_SONG = (
    "artist_id", "album_id", "title", "normalized_title", "canonical_title", "release_date", "duration_ms", "explicit",
    "image_url", "source_of_truth", "needs_review",
)
_KNOWN = {"entity_status": "canonical", "needs_review": False}
_STREAMS = ("total_streams", "total_streams_as_lead", "total_streams_solo", "total_streams_as_feature")
_DAILY = ("daily_streams", "daily_streams_as_lead", "daily_streams_as_feature")

RULES: dict[str, Rule] = {
    "artists_discovered": Rule(("spotify_id",), ("name", "normalized_name"), insert=_KNOWN | {"source_of_truth": "kworb"}, touch=True),
    "artists": Rule(
        ("spotify_id",),
        ("name", "normalized_name", "canonical_name", "image_url", "popularity", "is_afrobeats", "source_of_truth"),
        insert=_KNOWN | {"source_of_truth": "spotify"},
        touch=True,
    ),
    "artists_by_slug": Rule(("slug",), ("name", "normalized_name"), fill=("spotify_id",), insert=_KNOWN | {"is_afrobeats": False}, touch=True),
    "artist_genres": Rule(("artist_id", "genre"), ("is_primary",), insert={"is_primary": False}),
    "listener_snapshots": Rule(
        ("artist_id", "snapshot_date"), ("monthly_listeners", "daily_change", "peak_rank", "peak_listeners"), insert={"source": "kworb"}, touch=True
    ),
    "albums": Rule(("spotify_album_id",), (*_ALBUM, "is_afrobeats"), insert={"is_afrobeats": False}),
    "albums_scraped": Rule(("spotify_album_id",), _ALBUM, insert={"is_afrobeats": False}),
    "songs": Rule(("spotify_track_id",), _SONG, insert=_KNOWN | {"is_afrobeats": False}),
    "songs_edited": Rule(("spotify_track_id",), (*_SONG, "is_afrobeats", "entity_status"), insert=_KNOWN),
    "songs_by_slug": Rule(("slug",), ("title", "normalized_title"), insert=_KNOWN | {"is_afrobeats": False}),
    "artist_snapshots": Rule(("artist_id", "snapshot_date"), (*_STREAMS, *_DAILY, "track_count", "source_updated_at")),
    "song_snapshots": Rule(("song_id", "snapshot_date"), ("spotify_streams", "daily_streams")),
    "certifications": Rule(("artist_id", "territory", "body", "title"), ("level", "units", "certified_at", "source_url")),
    "trends": Rule(("entry_id",), ("prev_rank", "delta", "trend")),
}


def merge(target: DataFrame, batch: DataFrame, rule: Rule, seq: str | None = None, now: Column | None = None) -> DataFrame:
    """``target`` after the batch. The last row of a key (by ``seq``) counts; without ``seq`` keys must be unique.
    ``now`` (the present time, where not given) is the ``updated_at`` of new rows and of those that a conflict touches.

    Columns of the rule that the target lacks are left out, target columns that the batch lacks are null in it.
    """
    columns = target.columns
    keyed = " and ".join(f"`{k}` is not null" for k in rule.keys)
    rows = batch if seq is None else latest_by(batch.where(keyed), rule.keys, [F.col(seq).desc()]).unionByName(batch.where(f"not ({keyed})"))
    kinds = dict(target.dtypes)

    def given(c: str) -> Column:
        value = F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])
        return F.coalesce(value, F.lit(rule.insert[c]).cast(kinds[c])) if c in rule.insert else value

    t = target.select(F.struct("*").alias("t"), *[F.col(k).alias(f"_t_{k}") for k in rule.keys])
    s = rows.select(F.struct(*[given(c).alias(c) for c in columns]).alias("s"))
    both = t.join(s, [F.col(f"_t_{k}") == F.col("s")[k] for k in rule.keys], "full")
    met = F.col("t").isNotNull() & F.col("s").isNotNull()

    stamp = (F.current_timestamp() if now is None else now).cast(kinds.get("updated_at", "timestamp"))

    def value(c: str) -> Column:
        old, new = F.col("t")[c], F.col("s")[c]
        if c == "updated_at":
            new, changed = F.coalesce(new, stamp), stamp if rule.touch else old
        elif c in rule.fill:
            changed = F.coalesce(new, old)
        else:
            changed = new if c in rule.update else old
        return F.when(met, changed).when(F.col("t").isNotNull(), old).otherwise(new).alias(c)

    return both.select(*[value(c) for c in columns])


def named(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows with the forms of their name that a write derives where it has none."""
    for column, form in (("normalized_name", text.name_b(F.col(name))), ("canonical_name", F.col(name))):
        rows = rows.withColumn(column, F.coalesce(F.col(column), form) if column in rows.columns else form)
    return rows


def patch(target: DataFrame, patches: DataFrame, key: str = "id", now: Column | None = None) -> DataFrame:
    """``target`` where each row with a key of ``patches`` takes its other columns, null ones too; ``updated_at`` becomes ``now``.

    A patch of ``name`` also renews the forms of the name that it does not give itself.
    """
    if "name" in patches.columns and "normalized_name" in target.columns:
        patches = named(patches)
    given = [c for c in patches.columns if c != key and c in target.columns]
    p = patches.select(F.col(key).alias("_key"), F.struct(*given).alias("_new"))
    joined = target.join(p, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    stamp = {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))} if now is not None and "updated_at" in target.columns else {}
    value = {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in given} | stamp
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in target.columns])


def mark_not_found(artists: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``artists`` with the status of those in ``ids`` (id) that the source does not know."""
    return patch(artists, ids.select("id").distinct().select("id", F.lit("not_found").alias("kworb_status"), now.alias("kworb_last_checked_at")))


#: What refers to a table's ``id``: (table, column, what a delete does).
REFERENCES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "artists": (
        *((t, "artist_id", "cascade") for t in ("albums", "songs", "artist_aliases", "artist_external_ids", "artist_genres")),
        *((t, "artist_id", "cascade") for t in ("artist_stats_snapshots", "artist_monthly_listener_snapshots", "certifications", "chart_entries")),
        ("song_features", "featured_artist_id", "cascade"), ("award_records", "artist_id", "cascade"), ("records", "artist_id", "cascade"),
    ),
    "songs": (
        *((t, "song_id", "cascade") for t in ("song_aliases", "song_external_ids", "song_features", "song_stats_snapshots")),
        *((t, "song_id", "cascade") for t in ("certifications", "chart_entries", "records")), ("award_records", "song_id", "set null"),
    ),
    "albums": (("songs", "album_id", "set null"), ("award_records", "album_id", "set null"), *((t, "album_id", "cascade") for t in ("certifications", "chart_entries", "records"))),
    "chart_entries": (("chart_entry_snapshots", "entry_id", "cascade"),),
}


def delete(tables: Mapping[str, DataFrame], name: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` whose id is in ``ids`` (id), and without or with null in what refers to them.

    Ids that go are written once for each table: the plan of a table holds every other table at most as a list of ids to read.
    """
    out = dict(tables)
    gone = staged(ids.select(F.col("id").alias("_gone")).distinct(), "gone")
    out[name] = out[name].join(gone, F.col("id") == F.col("_gone"), "left_anti")
    for other, column, action in REFERENCES.get(name, ()):
        if other not in out or column not in out[other].columns:
            continue
        if action == "cascade" and "id" in out[other].columns and other in REFERENCES:
            lost = gone.join(tables[name].select("id"), F.col("_gone") == F.col("id"), "left_semi")
            out = delete(out, other, out[other].join(lost, F.col(column) == F.col("_gone"), "left_semi").select("id"))
        elif action == "cascade":
            out[other] = out[other].join(gone, F.col(column) == F.col("_gone"), "left_anti")
        else:
            columns = out[other].columns
            joined = out[other].join(gone, F.col(column) == F.col("_gone"), "left")
            kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
            out[other] = joined.select(*[kept if c == column else F.col(c) for c in columns])
    return out


def attach(links: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Alias or external-id rows after the batch: empty or null keys are left out, a key that is there keeps its owner, the
    first of the batch counts."""
    usable = " and ".join(f"`{k}` is not null and cast(`{k}` as string) <> ''" for k in keys)
    first = latest_by(batch.where(usable), keys, [F.col(seq)]).select(links.columns)
    return links.unionByName(first.join(links.select(*keys), list(keys), "left_anti"))


def find(table: DataFrame, **equal: object) -> DataFrame:
    """The row with these values, of several the one with the least id."""
    order = "id" if "id" in table.columns else table.columns[0]
    return find_all(table, **equal).orderBy(order).limit(1)


def find_all(table: DataFrame, **equal: object) -> DataFrame:
    for column, value in equal.items():
        table = table.where(F.col(column) == F.lit(value))
    return table


def titled(songs: DataFrame, artist: object, titles: DataFrame) -> DataFrame:
    """The song of an artist whose stored normal form is that of a title (``titles``: title), of several that with the least id."""
    asked = titles.select(text.title_form(F.col("title")).alias("_asked")).distinct()
    return find_all(songs, artist_id=artist).join(asked, F.col("normalized_title") == F.col("_asked"), "left_semi").orderBy("id").limit(1)


def find_in(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``wanted``, a table of any size; nulls are never in it."""
    keys = wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()
    return table.join(keys, F.col(column) == F.col("_wanted"), "left_semi")


def missing(table: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """Rows without a value in ``column``, the first ``size`` by id."""
    rows = table.where(F.col(column).isNull())
    return rows if size is None else rows.orderBy("id").limit(size)


def trackable(artists: DataFrame) -> DataFrame:
    """Artists that the daily jobs follow: known to the source, and not merged into another."""
    known = F.col("kworb_status").isNull() | (F.col("kworb_status") != "not_found")
    return artists.where(F.col("spotify_id").isNotNull() & known & (F.col("entity_status") != "merged"))


def unenriched_songs(songs: DataFrame, size: int | None = None) -> DataFrame:
    parts = ("album_id", "release_date", "duration_ms", "image_url")
    rows = songs.where("spotify_track_id is not null and (" + " or ".join(f"{c} is null" for c in parts if c in songs.columns) + ")")
    return rows if size is None else rows.orderBy("id").limit(size)


def certified(certifications: DataFrame, artist: object, area: str) -> DataFrame:
    return certifications.where((F.col("artist_id") == F.lit(artist)) & (F.col("territory") == F.upper(F.lit(area))))


def chunks(page: DataFrame, order: str, size: int) -> DataFrame:
    """The rows and ``chunk``: groups of ``size`` in order, from 0. Rows are dealt out by ranges of ``order`` and counted in each,
    so no task numbers them all."""
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the place in it in the lower 33
    dealt = page.repartitionByRange(order).sortWithinPartitions(order)
    dealt = staged(dealt.select(F.struct(*page.columns).alias("row"), F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")), "chunks")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.col("before") + F.col("place")
    return dealt.join(F.broadcast(before), "part").select("row.*", F.floor(at / size).cast("long").alias("chunk"))


def window(rows: DataFrame, order: str, offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in order."""
    return rows.orderBy(order).offset(offset).limit(size)


def next_page(rows: DataFrame, key: str, cursor: object, size: int) -> DataFrame:
    """The page after ``cursor``, or the first page where nothing follows it."""
    if cursor is None:
        return rows.orderBy(key).limit(size)
    after = F.col(key) > F.lit(cursor)
    page = rows.withColumn("_again", ~after).orderBy("_again", key).limit(size)
    fresh = page.agg(F.count_if(~F.col("_again")).alias("_fresh"))
    return page.join(F.broadcast(fresh), F.col("_again") == (F.col("_fresh") == 0)).drop("_again", "_fresh")


def progress(done: Column, total: Column, nothing: int = 100) -> Column:
    """Whole percent, half up. ``nothing`` is the percentage where there is nothing to do: 100 for songs, 0 for the jobs over
    artists (certifications, origins)."""
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(nothing).cast("int")


def counters(outcomes: DataFrame) -> DataFrame:
    """``total, succeeded, failed`` of job outcomes (ok boolean)."""
    ok = F.col("ok")
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok | ok.isNull()).alias("failed"))
