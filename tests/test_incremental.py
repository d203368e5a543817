from datetime import date

from pyspark.sql import functions as F

from chartspark.plans import incremental, views
from chartspark.plans.fixtures import Tables
from chartspark.plans.staging import Log


def _entries(spark, rows):
    return spark.createDataFrame(rows, "song_id int, artist_id int, chart_name string, chart_territory string, weeks_on_chart int, position int, chart_week date, sign int")


def test_changes_touch_their_buckets_only(spark, tmp_path):
    first = [(s, s % 5, "c", None, w, (s + w) % 50 + 1, date(2024, 1, 1 + w), 1) for s in range(60) for w in range(4)]
    kept = incremental.Stored(spark, f"file://{tmp_path}/m", incremental.SONG_CHARTS, 16)
    kept.build(incremental.song_chart_rows(_entries(spark, first)))
    before = {f for f in kept.read().inputFiles()}
    change = [first[0][:-1] + (-1,), (0, 0, "c", None, 9, 1, date(2024, 2, 1), 1), (999, 1, "c", "X", None, 7, date(2024, 2, 1), 1)]
    touched = kept.apply(incremental.song_chart_rows(_entries(spark, change)))
    assert 1 <= len(touched) <= 2
    read = kept.read("counts", touched)
    assert all(any(f"bucket={b}/" in f for b in touched) for f in read.inputFiles())
    after = {f for f in kept.read().inputFiles()}
    assert {f for f in before - after} and all(any(f"bucket={b}/" in f for b in touched) for f in before ^ after)
    want = incremental.Stored(spark, f"file://{tmp_path}/n", incremental.SONG_CHARTS, 16)
    want.build(incremental.song_chart_rows(_entries(spark, first[1:] + change[1:])))
    assert sorted(map(tuple, kept.read().collect()), key=repr) == sorted(map(tuple, want.read().collect()), key=repr)


def test_a_group_goes_with_its_last_row_and_an_empty_model_fills(spark, tmp_path):
    kept = incremental.Stored(spark, f"file://{tmp_path}/m", incremental.SONG_CHARTS, 4)
    row = (1, 2, "c", "t", 3, 4, date(2024, 1, 1), 1)
    kept.build(incremental.song_chart_rows(_entries(spark, [row]).where("false")))
    assert kept.read() is None
    kept.apply(incremental.song_chart_rows(_entries(spark, [row, row])))
    assert [(r.total_chart_weeks, r.peak_position, r.max_weeks_on_chart) for r in kept.read().collect()] == [(2, 4, 3)]
    kept.apply(incremental.song_chart_rows(_entries(spark, [row[:-1] + (-1,)] * 2)))
    assert kept.read() is None
    assert kept.apply(incremental.song_chart_rows(_entries(spark, [row]).where("false"))) == []


def test_a_version_is_seen_when_it_is_committed(spark, tmp_path):
    kept = incremental.Stored(spark, f"file://{tmp_path}/m", incremental.SONG_CHARTS, 4)
    kept.build(incremental.song_chart_rows(_entries(spark, [(1, 2, "c", "t", 3, 4, date(2024, 1, 1), 1)])))
    number = len(kept.log.entries())
    commit, kept.log.commit = kept.log.commit, lambda *_: None  # the writer is lost before its entry
    kept.apply(incremental.song_chart_rows(_entries(spark, [(1, 2, "c", "t", 3, 1, date(2024, 1, 8), 1)])))
    assert kept.read().first().peak_position == 4 and len(kept.log.entries()) == number
    kept.log.commit = commit
    kept.apply(incremental.song_chart_rows(_entries(spark, [(1, 2, "c", "t", 3, 1, date(2024, 1, 8), 1)])))
    assert kept.read().first().peak_position == 1


def test_views_refresh_one_by_one_from_stored_parents(spark, model, tmp_path):
    folder, t = f"file://{tmp_path}", Tables(spark, model)
    names = ["song_stream_summary", "artist_country_summary", "artist_stream_summary"]
    assert incremental.refresh(t, folder, names) == dict.fromkeys(["artist_stream_summary", "song_stream_summary", "artist_country_summary"], "ok")
    want = sorted(map(tuple, views.artist_country_summary(t).collect()), key=repr)
    assert sorted(map(tuple, incremental.current(spark, folder, "artist_country_summary").collect()), key=repr) == want
    # A child of a stored parent does not read the parent's tables.
    broken = Tables(spark, model)
    broken.made["songs"] = spark.range(1)
    stored = incremental.current(spark, folder, "song_stream_summary").inputFiles()
    out = incremental.refresh(broken, folder, names)
    assert out["song_stream_summary"] != "ok" and out["artist_country_summary"] == "ok"
    assert incremental.current(spark, folder, "song_stream_summary").inputFiles() == stored
    assert len(Log(spark, f"{folder}/artist_country_summary/_log").entries()) == 2
    child = incremental.CHILDREN["artist_country_summary"](incremental.current(spark, folder, "artist_stream_summary"))
    assert all("artist_stream_summary" in f for f in child.inputFiles())
    assert incremental.current(spark, folder, "song_growth_summary") is None
    assert child.select(F.count(F.lit(1))).first()[0] == len(want)
