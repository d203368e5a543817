"""Entity resolution of a whole batch: every mention looks up all its keys in one join, the best key wins.

A known entity is a row (``kind, scope, key, entity_id``) for each key it has; a mention has its
keys in order of trust. One equi-join on (kind, scope, key) and one ``min_by`` replace the lookups
made one after another; the keys of a mention are few, and a popular name is one row of the
lookup table, so neither side grows with the group. Distinct mentions are resolved once.

Mentions that match nothing are one entity where they share keys, in chains of any length (slug, normal form, each external
id): connected components. Such a group takes the entity of the first mention that did match and has one of its keys (but the
slug, which an entity does not gain by being mentioned); else it is a new entity, named by the slug of its first mention. A
null or empty key matches nothing; a mention without any key is resolved to null. ``seq`` tells mentions apart and orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions import text
from chartspark.operators.components import components
from chartspark.plans.staging import staged

KEY = ["kind", "scope", "key"]
KEYS = "array<struct<kind:string,scope:string,key:string>>"


def keys_of(entities: DataFrame, kinds: dict[str, tuple[Column, Column]], entity: str = "id") -> DataFrame:
    """Lookup rows; ``kinds`` gives (scope, key) for each kind. Two entities with one key: the least id has it."""
    rows = None
    for kind, (scope, key) in kinds.items():
        part = entities.select(F.lit(kind).alias("kind"), scope.cast("string").alias("scope"), key.cast("string").alias("key"), F.col(entity).alias("entity_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("key <> ''").groupBy(*KEY).agg(F.min("entity_id").alias("entity_id"))


def external_keys(external: DataFrame, entity: str) -> DataFrame:
    """Lookup rows of external ids (source, external_id) of any source; the source is the scope."""
    ids = external.select(F.col(entity).cast("string").alias("id"), "source", "external_id")
    return keys_of(ids, {"external": (F.col("source"), F.col("external_id"))})


def matched(mentions: DataFrame, lookup: DataFrame, mention: str = "mention_id") -> DataFrame:
    """``mentions`` (with ``mention`` and ``keys``, an array of struct(kind, scope, key) in order of trust) and
    ``entity_id, matched_by``, null where no key is known."""
    asked = mentions.select(mention, F.posexplode("keys").alias("trust", "k")).select(mention, "trust", "k.*").where("key <> ''")
    hits = asked.join(lookup, KEY)
    best = hits.groupBy(mention).agg(F.min_by(F.struct("entity_id", F.col("kind").alias("matched_by")), "trust").alias("b")).select(mention, "b.*")
    return mentions.join(best, mention, "left")


def _key(kind: str, scope: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), scope.cast("string").alias("scope"), key.cast("string").alias("key"))


def _external(rows: DataFrame) -> Column:
    """Keys of a mention's own external ids, where it has them."""
    if "external_ids" not in rows.columns:
        return F.array().cast(KEYS)
    ids = F.coalesce("external_ids", F.array().cast("array<struct<source:string,external_id:string>>"))
    return F.transform(ids, lambda x: _key("external", x["source"], x["external_id"])).cast(KEYS)


def identities(found: DataFrame) -> DataFrame:
    """``seq, entity_id, matched_by, entity_status`` of mentions (seq, slug, provisional, keys) that were ``matched``, those
    that match nothing put together by shared keys and named."""
    keys = found.select("seq", "entity_id", F.explode("keys").alias("k")).select("seq", "entity_id", "k.*").where("key <> '' and kind <> 'alias'").distinct()
    new, old = keys.where("entity_id is null").drop("entity_id"), keys.where("entity_id is not null and kind <> 'slug'")
    low = new.groupBy(*KEY).agg(F.min("seq").alias("low"))
    roots = components(new.join(low, KEY).select(F.col("seq").alias("u"), F.col("low").alias("v")))
    first = F.min_by(F.when(F.col("slug") != "", F.struct("slug", "provisional")), F.when(F.col("slug") != "", F.col("seq")))
    members = found.where("entity_id is null").select("seq", "slug", "provisional").join(roots, F.col("seq") == F.col("node"), "left")
    members = members.select("seq", "slug", "provisional", F.coalesce("root", "seq").alias("root"))
    gained = old.groupBy(*KEY).agg(F.min(F.struct("seq", "entity_id")).alias("by"))
    adopted = new.join(gained, KEY).select("seq", "by").join(members.select("seq", "root"), "seq").groupBy("root").agg(F.min("by")["entity_id"].alias("adopted"))
    named = members.groupBy("root").agg(first.alias("first")).join(adopted, "root", "left")
    status = F.when(F.col("first.provisional"), "provisional").otherwise("canonical")
    named = named.select(
        "root",
        F.coalesce("adopted", F.sha2("first.slug", 256)).alias("entity_id"),
        F.when(F.col("adopted").isNotNull(), "batch").when(F.col("first").isNotNull(), "created").alias("matched_by"),
        F.when(F.col("adopted").isNotNull(), "canonical").when(F.col("first").isNotNull(), status).alias("entity_status"),
    )
    known = found.where("entity_id is not null").select("seq", "entity_id", "matched_by", F.lit("canonical").alias("entity_status"))
    return known.unionByName(members.select("seq", "root").join(named, "root").drop("root"))


def _resolved(rows: DataFrame, once: DataFrame, columns: list[str], lookup: DataFrame, create: bool) -> DataFrame:
    """``rows`` with what their distinct mentions ``once`` resolve to."""
    found = matched(once, lookup, "seq")
    if create:
        found = staged(found.select(*columns, "seq", "slug", "provisional", "keys", "entity_id", "matched_by"), "mentions")
        found = found.select("seq", *columns).join(identities(found), "seq")
    else:
        found = found.withColumn("entity_status", F.when(F.col("entity_id").isNotNull(), "canonical"))
    of = found.select(*[F.col(c).alias(f"k_{c}") for c in columns], "entity_id", "matched_by", "entity_status")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in columns]
    return rows.join(of, same, "left").drop(*[f"k_{c}" for c in columns])


def _once(mentions: DataFrame, columns: list[str], provisional: bool) -> DataFrame:
    """Distinct mentions with their first ``seq`` and, by it, ``provisional``."""
    flag = F.col("provisional") if "provisional" in mentions.columns else F.lit(provisional)
    return mentions.groupBy(*columns).agg(F.min("seq").alias("seq"), F.min_by(flag, "seq").alias("provisional"))


def _stored(entities: DataFrame, column: str, form: Column) -> Column:
    """The stored normal form of a table that has one."""
    return F.col(column) if column in entities.columns else form


def resolve_artists(mentions: DataFrame, artists: DataFrame, aliases: DataFrame | None = None, external: DataFrame | None = None, create: bool = True, provisional: bool = False) -> DataFrame:
    """``seq, name, spotify_id, entity_id, matched_by, entity_status`` of every mention.

    ``mentions``: seq, name, spotify_id and, where there are, ``external_ids`` (array of source, external_id) and
    ``provisional``; ``artists``: id, name, slug, spotify_id and, where stored, normalized_name; ``aliases``: artist_id,
    alias; ``external``: artist_id, source, external_id. Order: spotify id, external ids, slug, normal form, alias. A new
    artist is provisional as its first mention says, ``provisional`` where mentions do not say it.
    """
    whole = F.lit("")
    known = artists.withColumn("id", F.col("id").cast("string"))
    lookup = keys_of(known, {"spotify": (whole, F.col("spotify_id")), "slug": (whole, F.col("slug")), "name": (whole, _stored(artists, "normalized_name", text.name_a(F.col("name"))))})
    if aliases is not None:
        lookup = lookup.unionByName(keys_of(aliases.select(F.col("artist_id").cast("string").alias("id"), "alias"), {"alias": (whole, text.name_a(F.col("alias")))}))
    if external is not None:
        lookup = lookup.unionByName(external_keys(external, "artist_id"))
    columns = ["name", "spotify_id", *(["external_ids"] if "external_ids" in mentions.columns else [])]
    once = _once(mentions, columns, provisional)
    once = once.withColumn("slug", text.slug(text.collapse(F.col("name")))).withColumn("normal", text.name_a(F.col("name")))
    spotify = F.array(_key("spotify", whole, F.col("spotify_id")), _key("external", F.lit("spotify"), F.col("spotify_id")))
    names = F.array(_key("slug", whole, F.col("slug")), _key("name", whole, F.col("normal")), _key("alias", whole, F.col("normal")))
    once = once.withColumn("keys", F.concat(spotify.cast(KEYS), _external(once), names.cast(KEYS)))
    return _resolved(mentions.select("seq", *columns), once, columns, lookup, create).drop("external_ids")


def resolve_songs(
    mentions: DataFrame, songs: DataFrame, aliases: DataFrame | None = None, create: bool = True, provisional: bool = False, external: DataFrame | None = None
) -> DataFrame:
    """``seq, artist_id, artist_slug, title, spotify_track_id, entity_id, matched_by, entity_status`` of every mention.

    ``mentions`` may have ``external_ids`` and ``provisional`` as artists' mentions have; ``songs`` may store
    ``normalized_title``; ``aliases``: song_id, artist_id, alias; ``external``: song_id, source, external_id. Order: track id,
    external ids, normal form of the title within the artist, slug, alias within the artist. Without an artist: null.
    """
    whole, artist = F.lit(""), F.col("artist_id")
    title = _stored(songs, "normalized_title", text.title_form(F.col("title")))
    lookup = keys_of(songs.withColumn("id", F.col("id").cast("string")), {"track": (whole, F.col("spotify_track_id")), "title": (artist, title), "slug": (whole, F.col("slug"))})
    if aliases is not None:
        lookup = lookup.unionByName(keys_of(aliases.select(F.col("song_id").cast("string").alias("id"), "artist_id", "alias"), {"alias": (artist, text.title_form(F.col("alias")))}))
    if external is not None:
        lookup = lookup.unionByName(external_keys(external, "song_id"))
    plain = ["artist_id", "artist_slug", "title", "spotify_track_id"]
    columns = [*plain, *(["external_ids"] if "external_ids" in mentions.columns else [])]
    once = _once(mentions, columns, provisional).withColumn("normal", text.title_form(F.col("title")))
    once = once.withColumn("slug", F.when(artist.isNotNull(), text.slug(F.concat_ws("-", "artist_slug", text.collapse(F.col("title"))))))
    track = F.col("spotify_track_id")
    ids = F.array(_key("track", whole, track), _key("external", F.lit("spotify"), track))
    titles = F.array(_key("title", artist, F.col("normal")), _key("slug", whole, F.col("slug")), _key("alias", artist, F.col("normal")))
    once = once.withColumn("keys", F.concat(ids.cast(KEYS), _external(once), titles.cast(KEYS)))
    out = _resolved(mentions.select("seq", *columns), once, columns, lookup, create)
    return out.select("seq", *plain, "entity_id", "matched_by", "entity_status")


def write_back(resolved: DataFrame, source: str, name: str = "name", external: str = "spotify_id", form=text.name_a) -> tuple[DataFrame, DataFrame]:
    """Batches of alias and external-id rows (``entity_id, normalized_alias, alias, source, seq`` and ``entity_id, source,
    external_id, seq``) of what was resolved or created, for ``store.attach``."""
    found = resolved.where("entity_id is not null")
    shown = text.collapse(F.col(name))
    aliases = found.select("entity_id", form(shown).alias("normalized_alias"), shown.alias("alias"), F.lit(source).alias("source"), "seq")
    ids = found.where(F.col(external) != "").select("entity_id", F.lit("spotify").alias("source"), F.col(external).alias("external_id"), "seq")
    return aliases, ids


def route_discovered(found: DataFrame, artists: DataFrame) -> DataFrame:
    """``found`` (seq, spotify_id, name, monthly_listeners) and ``route, artist_id``: ``known`` by spotify id, ``link``
    (the artist of that name, by form B, else of that slug, who has no id yet), ``drop`` (who has another one), ``create``."""
    ids = artists.where("spotify_id is not null").groupBy("spotify_id").agg(F.min(F.col("id").cast("string")).alias("known_id"))
    whole = F.lit("")
    entity = F.struct(F.col("id").cast("string").alias("i"), F.col("spotify_id").isNotNull().alias("has"))
    names = keys_of(artists.select(entity.alias("id"), "slug", "name"), {"name": (whole, text.name_b(F.col("name"))), "slug": (whole, F.col("slug"))})
    m = found.withColumn("keys", F.array(_key("name", whole, text.name_b(F.col("name"))), _key("slug", whole, text.slug(text.collapse(F.col("name"))))))
    got = matched(m, names, "seq").join(ids, "spotify_id", "left")
    route = F.when(F.col("known_id").isNotNull(), "known").when(F.col("entity_id").isNull(), "create").when(F.col("entity_id.has"), "drop").otherwise("link")
    return got.select("seq", "spotify_id", "name", "monthly_listeners", route.alias("route"), F.coalesce("known_id", F.when(route == "link", F.col("entity_id.i"))).alias("artist_id"))
