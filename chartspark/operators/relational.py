"""Relational building blocks: latest row, date lookback, as-of previous, top-k, fusion, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; the rank limit is applied before the shuffle too (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookback(key: str, date: str, value: str, days: int) -> Column:
    """The value exactly ``days`` days earlier for the same key, null where that day is missing: one range frame, no self join."""
    w = Window.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(-days, -days)
    return F.max(value).over(w)


def previous_position() -> Column:
    """The position in the latest earlier week of the same song, chart and territory; a null territory has none."""
    w = Window.partitionBy("song_id", "chart_name", "chart_territory").orderBy("chart_week")
    return F.when(F.col("chart_territory").isNotNull(), F.lag("position").over(w))


def trend(previous: Column, position: Column) -> Column:
    return F.when(previous.isNull(), "NEW").when(position < previous, "UP").when(position > previous, "DOWN").otherwise("SAME")


def chart_trend(entries: DataFrame) -> DataFrame:
    prev = entries.select(F.col("id").alias("entry_id"), "position", previous_position().alias("prev"))
    return prev.select("entry_id", F.col("prev").cast("short").alias("prev_rank"), F.abs(F.col("position") - F.col("prev")).cast("short").alias("delta"), trend(F.col("prev"), F.col("position")).alias("trend"))


def points(rank: Column, max_rank: int) -> Column:
    return F.when(rank.between(1, max_rank), max_rank + 1 - rank).otherwise(0)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str], seq: str | None = None) -> DataFrame:
    """``target`` after INSERT ... ON CONFLICT (keys) DO UPDATE of the columns ``update``.

    The last source row of a key (by ``seq``) counts. As in SQL, a key with a null never conflicts.
    """
    columns = target.columns
    if seq:
        whole = source.where(" and ".join(f"`{k}` is not null" for k in keys))
        rest = source.where(" or ".join(f"`{k}` is null" for k in keys))
        source = latest_by(whole, keys, [F.col(seq).desc()]).unionByName(rest).drop(seq)
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in columns], F.lit(True).alias("t_"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("s_"))
    on = [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys]

    def value(c: str) -> Column:
        both = F.col("s_" if c in update else "t_")
        return F.when(both.isNotNull() if c in update else F.col("t_").isNotNull(), F.col(f"{'s' if c in update else 't'}_{c}")).otherwise(F.col(f"{'t' if c in update else 's'}_{c}")).alias(c)

    return t.join(s, on, "full").select(*[value(c) for c in columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """``target`` after INSERT ... ON CONFLICT (keys) DO NOTHING."""
    whole = source.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = source.where(" or ".join(f"`{k}` is null" for k in keys))
    first = latest_by(whole, keys, [F.col(seq)]) if seq else whole.dropDuplicates(list(keys))
    fresh = first.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(target.columns)).unionByName(rest.select(target.columns))


def greedy_insert(entries: DataFrame) -> DataFrame:
    """Chart rows that are accepted in order of ``seq`` when neither their song nor their position is taken in the same
    chart, territory and week. A chart has at most a few hundred rows, so a group fits one task; a null territory conflicts with nothing."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        songs, places, keep = set(), set(), []
        for song, place in zip(rows["song_id"], rows["position"], strict=True):
            ok = song not in songs and place not in places
            keep.append(ok)
            if ok:
                songs.add(song)
                places.add(place)
        return rows[keep]

    placed = entries.where("chart_territory is not null and song_id is not null")
    free = entries.where("chart_territory is null or song_id is null")
    return placed.groupBy("chart_name", "chart_territory", "chart_week").applyInPandas(run, entries.schema).unionByName(free)


def keyset_page(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)
