"""Structured Streaming forms of the daily jobs: keyed snapshots and the trend of chart positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chartspark.operators import relational as rel


def _there(spark: SparkSession, path: str, delete: bool = False) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.delete(hadoop, True) if delete else files.exists(hadoop)


def upsert_days(batch: DataFrame, path: str, keys: list[str], day: str, seq: str, batch_id: int = 0) -> None:
    """Upsert ``batch`` into the table at ``path``, partitioned by ``day``; the last row of a key (by ``seq``) counts.

    Only the days of the batch are read and rewritten, so the cost follows the batch and not the history. The new days
    are written beside the table first; a batch that failed while they replaced the old ones is finished from there when
    it is delivered again, and one that is delivered twice gives the same table.
    """
    spark = batch.sparkSession
    staged = f"{path.rstrip('/')}-staged/{batch_id}"
    if not _there(spark, f"{staged}/_SUCCESS"):
        fresh = rel.latest_by(batch, [*keys, day], [F.col(seq).desc()]).drop(seq)
        if _there(spark, path):
            days = fresh.select(day).distinct()
            old = spark.read.schema(fresh.schema).parquet(path).join(days, day, "left_semi")
            kept = old.join(fresh.select(*keys, day), [*keys, day], "left_anti").select(fresh.columns)
            fresh = fresh.unionByName(kept)
        fresh.write.mode("overwrite").parquet(staged)
    merged = spark.read.parquet(staged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    _there(spark, staged, delete=True)


def snapshot_sink(stream: DataFrame, path: str, keys: list[str], day: str, seq: str, checkpoint: str) -> DataStreamWriter:
    """A writer that upserts each micro-batch; ``checkpoint`` is the query's own folder."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: upsert_days(b, path, keys, day, seq, i))


TREND = "song_id string, chart_name string, chart_territory string, chart_week date, position int, prev_rank int, trend string"


def chart_trends(entries: DataFrame) -> DataFrame:
    """The trend of each chart row against the last week seen of its song, chart and territory.

    The state is one week and position a key. A row of an older week than the state is compared with nothing later and
    does not change the state, so it is NEW; the batch form gives the corrected answer.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("chart_week", kind="stable")
        before, says = [], []
        for week, place in zip(rows["chart_week"], rows["position"], strict=True):
            day = week.toordinal()
            prev = last[1] if last is not None and last[0] < day else None
            before.append(prev)
            says.append("NEW" if prev is None else "UP" if place < prev else "DOWN" if place > prev else "SAME")
            if last is None or last[0] < day:
                last = (day, int(place))
        state.update(last)
        yield rows.assign(prev_rank=pd.array(before, "Int32"), trend=says)

    rows = entries.where("song_id is not null and chart_week is not null and position is not null").selectExpr("cast(song_id as string) song_id", "chart_name", "chart_territory", "chart_week", "cast(position as int) position")
    return rows.groupBy("song_id", "chart_name", "chart_territory").applyInPandasWithState(step, TREND, "week int, position int", "append", GroupStateTimeout.NoTimeout)
