import pytest
from pyspark.sql import functions as F

from chartspark.operators.job_state import Job
from chartspark.plans.staging import Conflict


def rows_of(spark, n):
    return spark.createDataFrame([(i, f"s{i}") for i in range(n)], "id int, name string").repartition(3)


def enriched(page):
    return page.withColumn("ok", F.when(F.col("id") % 3 > 0, F.col("id") % 5 > 0))


@pytest.mark.parametrize("by", ["key", "offset"])
def test_a_run_that_is_lost_neither_skips_nor_repeats(spark, tmp_path, monkeypatch, by):
    rows, folder = rows_of(spark, 10), f"file://{tmp_path}/job"
    job = Job(spark, folder, "id", 4, by)
    assert job.run(rows, enriched)["total"] == 4
    with monkeypatch.context() as m:
        m.setattr(job.log, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost between page and cursor")))
        with pytest.raises(OSError):
            job.run(rows, enriched)
    with pytest.raises(ValueError, match="lost within"):
        job.run(rows, lambda page: (_ for _ in ()).throw(ValueError("lost within the page")))
    job = Job(spark, folder, "id", 4, by)  # another driver
    assert [job.run(rows, enriched)["total"] for _ in range(2)] == [4, 2]
    assert sorted(r.id for r in job.results().collect()) == list(range(10))
    assert job.totals() == {"total": 10, "succeeded": 5, "failed": 1, "skipped": 4}
    assert job.run(rows, enriched)["again"]  # it starts over
    assert sorted(r.id for r in job.results().collect()) == sorted([*range(10), *range(4)])


def test_two_runs_at_once(spark, tmp_path):
    rows, folder = rows_of(spark, 6), f"file://{tmp_path}/job"
    one, other = (Job(spark, folder, "id", 2) for _ in range(2))

    def meanwhile(page):
        other.run(rows, enriched)
        return enriched(page)

    with pytest.raises(Conflict):
        one.run(rows, meanwhile)
    assert sorted(r.id for r in one.results().collect()) == [0, 1]


def test_status_reset_and_empty_lists(spark, tmp_path):
    rows = rows_of(spark, 10)
    job = Job(spark, f"file://{tmp_path}/job", "id", 4, "offset")
    assert job.status(rows) == {"cursor": None, "totalPending": 10, "percentComplete": 0, "nextBatch": (1, 4)}
    job.run(rows, enriched)
    assert job.status(rows) == {"cursor": 4, "totalPending": 10, "percentComplete": 40, "nextBatch": (5, 8)}
    assert job.status(rows.where("id < 3")) == {"cursor": 4, "totalPending": 3, "percentComplete": 100, "nextBatch": (1, 3)}
    job.reset()
    assert job.cursor() is None and [r.id for r in job.page(rows)[0].collect()] == [0, 1, 2, 3]
    none = rows.where("false")
    assert job.status(none) == {"cursor": None, "totalPending": 0, "percentComplete": 100, "nextBatch": None}
    assert job.status(none, nothing=0)["percentComplete"] == 0
    assert job.run(none, enriched)["total"] == 0 and job.cursor() is None
    by_key = Job(spark, f"file://{tmp_path}/keys", "id", 3)
    by_key.run(rows.where("id > 5"), enriched)
    assert by_key.cursor() == "8" and by_key.status(rows)["percentComplete"] == 90


def test_counters_need_no_second_scan(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = rows_of(spark, 9).coalesce(1).mapInArrow(count, "id int, name string")
    Job(spark, f"file://{tmp_path}/job", "id", 100).run(rows, enriched)
    assert reads.value == 9
