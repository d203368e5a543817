import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chartspark.operators.relational import chart_trend
from chartspark.streaming import late_weeks

SCHEMA = "id int, song_id string, chart_name string, chart_territory string, chart_week date, position int"


@pytest.fixture
def run(spark, tmp_path):
    for k, v in late_weeks.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def streamed(batches, **kw):
        source, told = str(tmp_path / "in"), {}
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            out = late_weeks.trends(spark.readStream.schema(SCHEMA).parquet(source), **kw)

            def keep(df, _):
                for r in df.collect():
                    told[r.song_id, r.chart_name, r.chart_territory, r.chart_week] = (r.position, r.prev_rank, r.delta, r.trend)

            q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(90), n
        return told

    yield streamed
    for k in (*late_weeks.STATE_STORE, "spark.sql.shuffle.partitions"):
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_any_order_of_arrival_gives_the_batch_answer(spark, run):
    rnd = random.Random(8)
    rows = [(i, f"s{i % 4}", "c", "t" if i % 3 else "u", date(2024, 1, 5) + timedelta(weeks=i // 4), rnd.randrange(1, 9)) for i in range(60)]
    mixed = rows.copy()
    rnd.shuffle(mixed)
    told = run([mixed[:25], mixed[25:40], mixed[40:] + mixed[:5]])
    all_rows = spark.createDataFrame(rows, SCHEMA)
    want = chart_trend(all_rows).join(all_rows.select(F.col("id").alias("entry_id"), *late_weeks.KEY, "chart_week", "position"), "entry_id").collect()
    assert told == {(r.song_id, r.chart_name, r.chart_territory, r.chart_week): (r.position, r.prev_rank, r.delta, r.trend) for r in want}


def test_nulls_first_positions_and_expiry(spark, run):
    day = lambda n: date(2024, 1, 5) + timedelta(weeks=n)
    first = [(0, "s", "c", "t", day(0), 5), (1, "s", "c", None, day(0), 5), (2, "s", "c", "t", day(10), 2), (3, "s", "c", "t", day(11), 4), (4, None, "c", "t", day(1), 3)]
    later = [(5, "s", "c", "t", day(10), 9), (6, "s", "c", "t", day(12), 1), (7, "s", "c", "t", day(5), 7)]
    told = run([first, later], keep_days=21)
    assert told["s", "c", None, day(0)] == (5, None, None, "NEW") and told[None, "c", "t", day(1)][3] == "NEW"
    assert told["s", "c", "t", day(10)] == (2, 7, 5, "UP")  # the first position counts, told again after week 5 came
    assert told["s", "c", "t", day(12)] == (1, 4, 3, "UP") and told["s", "c", "t", day(5)] == (7, 5, 2, "DOWN")
