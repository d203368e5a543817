"""Read models that follow changes of their tables, and versions that readers switch to at once.

A model is kept as counts: for each group, how many rows have which value of which measure. Counts of changed rows (inserted
ones count 1, deleted ones -1, an update is both) are added to those of their groups, so deletes need no rescan: minima,
maxima, sums and distinct counts all come from the values whose count is not 0. Groups lie in buckets by a hash; a change
reads and writes the buckets of its groups only. A version is an entry of the model's log, which names the files of each
bucket: readers see the old one or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chartspark.plans import views
from chartspark.plans.fixtures import Tables
from chartspark.plans.staging import Log, staged


NONE = "cast(null as string)"


def number(value: str) -> tuple[str, str]:
    return f"cast({value} as bigint)", NONE


def day(value: str) -> tuple[str, str]:
    return f"cast(unix_date({value}) as bigint)", NONE


def word(value: str) -> tuple[str, str]:
    return "cast(null as bigint)", f"cast({value} as string)"


def low(what: str) -> str:
    return f"min(CASE WHEN what = '{what}' THEN number END)"


def high(what: str) -> str:
    return f"max(CASE WHEN what = '{what}' THEN number END)"


def rows(what: str, condition: str = "true") -> str:
    """Rows that have a value of ``what``, and that meet a condition."""
    return f"cast(coalesce(sum(CASE WHEN what = '{what}' AND {condition} THEN n END), 0) as bigint)"


def distinct(what: str) -> str:
    return f"count_if(what = '{what}')"


def total(what: str) -> str:
    return f"cast(coalesce(sum(CASE WHEN what = '{what}' THEN number * n END), 0) as bigint)"


def as_int(value: str) -> str:
    return f"cast({value} as int)"


def as_day(days: str) -> str:
    return f"date_from_unix_date(cast({days} as int))"


@dataclass(frozen=True)
class Model:
    """``keys`` of a group, of which the first ``placed`` decide its bucket; the measures that are counted, as (number, word);
    and what is read off the counts. Measures and results are SQL."""

    keys: tuple[str, ...]
    measures: Mapping[str, tuple[str, str]]
    results: Mapping[str, str]
    placed: int = 1

    def counts(self, changes: DataFrame, sign: str = "sign") -> DataFrame:
        """``keys, what, number, word, n``: counts of changed rows; every row also counts as one of its group."""
        values = {"": number("0"), **self.measures}
        parts = F.array(*[F.struct(F.lit(k).alias("what"), F.expr(a).alias("number"), F.expr(b).alias("word")) for k, (a, b) in values.items()])
        seen = changes.select(*self.keys, F.col(sign).cast("long").alias("n"), F.explode(parts).alias("v")).select(*self.keys, "v.*", "n")
        return self.added(seen.where("what = '' or number is not null or word is not null"))

    def added(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy(*self.keys, "what", "number", "word").agg(F.sum("n").alias("n")).where("n <> 0")

    def groups(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy(*self.keys).agg(*[F.expr(c).alias(k) for k, c in self.results.items()])


SONG_CHARTS = Model(
    ("song_id", "artist_id", "chart_name", "chart_territory"),
    {"position": number("position"), "weeks": number("weeks_on_chart"), "week": day("chart_week")},
    {
        "peak_position": as_int(low("position")),
        "max_weeks_on_chart": as_int(high("weeks")),
        "total_chart_weeks": rows(""),
        "weeks_at_number_1": rows("position", "number = 1"),
        "weeks_in_top_10": rows("position", "number <= 10"),
        "weeks_in_top_40": rows("position", "number <= 40"),
        "first_charted": as_day(low("week")),
        "last_charted": as_day(high("week")),
    },
)
ARTIST_CHARTS = Model(
    ("artist_id", "chart_name", "chart_territory", "role"),
    {"position": number("position"), "week": day("chart_week"), "song": word("song_id")},
    {
        "total_chart_weeks": distinct("week"),
        "distinct_songs_charted": distinct("song"),
        "best_peak_position": as_int(low("position")),
        "weeks_at_number_1": rows("position", "number = 1"),
        "weeks_in_top_10": rows("position", "number <= 10"),
        "first_chart_appearance": as_day(low("week")),
        "latest_chart_appearance": as_day(high("week")),
    },
)
CERTIFICATIONS = Model(
    ("artist_id", "territory", "body"),
    {"level": word("level"), "units": number("units"), "day": day("certified_at")},
    {
        "total_certifications": rows(""),
        **{f"{x}_count": rows("level", f"word = '{x}'") for x in ("diamond", "platinum", "gold", "silver")},
        "total_platinum_units": total("units"),
        "latest_certification": as_day(high("day")),
        "earliest_certification": as_day(low("day")),
    },
)


def song_chart_rows(entries: DataFrame) -> DataFrame:
    """Rows of ``SONG_CHARTS`` from chart entries (with ``sign``, where they are changes)."""
    return _signed(entries).where("song_id is not null and artist_id is not null").withColumn("chart_territory", views.territory())


def certification_rows(certifications: DataFrame) -> DataFrame:
    return _signed(certifications).where("artist_id is not null")


def artist_chart_rows(entries: DataFrame, features: DataFrame, role: str | None = None) -> DataFrame:
    """Rows of ``ARTIST_CHARTS``: each entry for its artist, and for each artist featured on its song; ``role`` gives one kind."""
    e = _signed(entries).where("song_id is not null").withColumn("chart_territory", views.territory())
    columns = ["chart_name", "chart_territory", "song_id", "chart_week", "position", "sign"]
    own = e.select("artist_id", F.lit("primary").alias("role"), *columns)
    f = _signed(features).select("song_id", F.col("featured_artist_id").alias("artist_id"), F.col("sign").alias("f_sign"))
    other = e.drop("artist_id").join(f, "song_id").withColumn("sign", F.col("sign") * F.col("f_sign")).select("artist_id", F.lit("feature").alias("role"), *columns)
    both = own.unionByName(other) if role is None else own if role == "primary" else other
    return both.where("artist_id is not null")


def artist_chart_changes(entries: DataFrame, features: DataFrame, entry_changes: DataFrame, feature_changes: DataFrame) -> DataFrame:
    """Changed rows of ``ARTIST_CHARTS``: changed entries with the features there were (``features``), and changed features with
    the entries there are now (``entries``, after the changes)."""
    return artist_chart_rows(entry_changes, features).unionByName(artist_chart_rows(entries, feature_changes, "feature"))


def _signed(changes: DataFrame) -> DataFrame:
    return changes if "sign" in changes.columns else changes.withColumn("sign", F.lit(1))


class Stored:
    """A model kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, model: Model, buckets: int = 64) -> None:
        self.spark, self.folder, self.model, self.buckets = spark, folder.rstrip("/"), model, buckets
        self.log = Log(spark, f"{self.folder}/_log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.model.keys[: self.model.placed]]), F.lit(self.buckets)).cast("int")

    def _write(self, counts: DataFrame, buckets: list[int]) -> dict[str, dict[str, str]]:
        """Counts and groups of some buckets, in a folder of their own; where they are."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        counts.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
        kept = self.spark.read.schema(StructType([*counts.schema.fields, StructField("bucket", IntegerType())])).option("basePath", f"{path}/counts").parquet(f"{path}/counts")
        groups = self.model.groups(kept.drop("bucket"))
        groups.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/groups")
        there = {r.bucket for r in kept.select("bucket").distinct().collect()}  # at most one number for each bucket
        return {part: {str(b): f"{path}/{part}/bucket={b}" if b in there else "" for b in buckets} for part in ("counts", "groups")}

    def build(self, changes: DataFrame) -> None:
        """The first version, or a new one from nothing."""
        entry = self._write(self.model.counts(_signed(changes)), list(range(self.buckets)))
        self.log.commit(entry, len(self.log.entries()))

    def apply(self, changes: DataFrame) -> list[int]:
        """A version after ``changes`` (rows with ``sign``: how many come, below 0: go); the buckets that were read and written."""
        entries = self.log.entries()
        last = entries[-1]
        delta = staged(self.model.counts(_signed(changes)), "delta")
        touched = sorted(r.b for r in delta.select(self._bucket().alias("b")).distinct().collect())  # at most one number for each bucket
        if not touched:
            return []
        old = self.read("counts", touched, last)
        counts = delta if old is None else self.model.added(old.unionByName(delta))
        new = self._write(counts, touched)
        self.log.commit({part: last[part] | new[part] for part in ("counts", "groups")}, len(entries))
        return touched

    def read(self, part: str = "groups", buckets: list[int] | None = None, entry: dict | None = None) -> DataFrame | None:
        """The groups (or ``counts``) of the last version, or of some buckets of it; None where there are none."""
        entry = entry or self.log.last()
        if entry is None:
            return None
        own = entry[part] if buckets is None else {str(b): entry[part][str(b)] for b in buckets}
        paths = [p for p in own.values() if p]
        return self.spark.read.parquet(*paths) if paths else None


#: What each view is made of, where that is another view.
PARENTS = {"artist_trending_summary": "artist_growth_summary", "song_trending_summary": "song_growth_summary", "artist_country_summary": "artist_stream_summary"}
CHILDREN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "artist_trending_summary": views.artist_trending_of, "song_trending_summary": views.song_trending_of, "artist_country_summary": views.artist_country_of
}


def current(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The version of a view that readers see."""
    last = Log(spark, f"{folder}/{name}/_log").last()
    return spark.read.parquet(last["path"]) if last else None


def refresh(t: Tables, folder: str, names: list[str] | None = None) -> dict[str, str]:
    """New versions of views, each after those it is made of, which it reads as stored. A view that fails keeps the version that
    it has, and the others go on; its message is returned."""
    out = {}
    for name in [v for v in views.VIEWS if names is None or v in names]:
        try:
            parent = PARENTS.get(name)
            stored = current(t.spark, folder, parent) if parent and out.get(parent) == "ok" else None
            rows_ = CHILDREN[name](stored) if stored is not None else views.VIEWS[name](t)
            log, path = Log(t.spark, f"{folder}/{name}/_log"), f"{folder}/{name}/{uuid.uuid4().hex}"
            rows_.write.parquet(path)
            log.commit({"path": path}, len(log.entries()))
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001
            out[name] = str(e)[:200]
    return out
