"""Chart trends on a stream whose weeks come in any order.

The state of a (song, chart, territory) is a map from week to position. A row that comes late takes its place in it: its own
trend is told against the week before it, and the week after it is told again, as its predecessor has changed. So the last
row told for each week is what a batch over all rows gives, in whatever order they came. The first position that comes for a
week counts; a row without a territory, song or week has no state and is told as new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["song_id", "chart_name", "chart_territory"]
OUT = "song_id string, chart_name string, chart_territory string, chart_week date, position int, prev_rank int, delta int, trend string"
#: What a stream with this operator needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Weeks(StatefulProcessor):
    def __init__(self, keep_days: int) -> None:
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "week int", "position int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = {w[0]: p[0] for w, p in self.weeks.iterator()}
        new: dict[int, int] = {}
        for part in rows:
            for week, position in zip(part["week"].tolist(), part["position"].tolist(), strict=True):
                if week not in had:
                    had[week] = new[week] = position
                    self.weeks.updateValue((week,), (position,))
        order = sorted(had)
        told = [(w, order[i - 1] if i else None) for i, w in enumerate(order) if w in new or (i and order[i - 1] in new)]
        prev = [None if p is None else had[p] for _, p in told]
        now = [had[w] for w, _ in told]
        out = pd.DataFrame({"chart_week": [w for w, _ in told], "position": now, "prev_rank": pd.array(prev, "Int32")})
        # Weeks beyond the horizon go, but the last of them stays as a predecessor.
        old = [w for w in order if w < order[-1] - self.keep_days][:-1] if self.keep_days else []
        for w in old:
            self.weeks.removeKey((w,))
        if len(out):
            for name, value in zip(KEY, key, strict=True):
                out[name] = value
            yield out[[*KEY, "chart_week", "position", "prev_rank"]]

    def close(self) -> None:
        pass


def _told(rows: DataFrame) -> DataFrame:
    p, q = F.col("position"), F.col("prev_rank")
    trend = F.when(q.isNull(), "NEW").when(p < q, "UP").when(p > q, "DOWN").otherwise("SAME")
    return rows.select(*KEY, "chart_week", p.cast("int").alias("position"), q.cast("int").alias("prev_rank"), F.abs(p - q).cast("int").alias("delta"), trend.alias("trend"))


def trends(stream: DataFrame, keep_days: int = 0) -> DataFrame:
    """Updates of ``song_id, chart_name, chart_territory, chart_week, position, prev_rank, delta, trend`` from rows (those keys,
    chart_week, position) in any order; the last one of a key and week counts.

    ``keep_days``: weeks so far behind the newest of their key leave the state, so that it stays bounded (0 keeps all); a
    row that comes later than that is told against what is left.
    """
    whole = " and ".join(f"{c} is not null" for c in (*KEY, "chart_week", "position"))
    rows = stream.select(*[F.col(c).cast("string").alias(c) for c in KEY], F.unix_date("chart_week").alias("week"), F.col("position").cast("int").alias("position"))
    kept = rows.where(whole.replace("chart_week", "week")).groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=_Weeks(keep_days), outputStructType="song_id string, chart_name string, chart_territory string, chart_week int, position int, prev_rank int", outputMode="Update", timeMode="None",
    )
    kept = kept.withColumn("chart_week", F.date_from_unix_date("chart_week"))
    rest = rows.where(f"not ({whole.replace('chart_week', 'week')})").select(*KEY, F.date_from_unix_date("week").alias("chart_week"), "position", F.lit(None).cast("int").alias("prev_rank"))
    return _told(kept).unionByName(_told(rest))
