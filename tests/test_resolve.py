from datetime import date

from chartspark.operators import resolve
from chartspark.streaming import snapshots


def test_artists(spark):
    known = spark.createDataFrame([(1, "Ann Lee", "ann-lee", "s1"), (2, "Beyoncé", "beyonce", None)], "id int, name string, slug string, spotify_id string")
    alias = spark.createDataFrame([(1, "Annie")], "artist_id int, alias string")
    ask = [(0, "ANN  LEE", None), (1, "x", "s1"), (2, "annie", None), (3, "Beyonce", None), (4, "New One", None), (5, "new  one", None), (6, None, None), (7, "New One", None)]
    out = resolve.resolve_artists(spark.createDataFrame(ask, "seq int, name string, spotify_id string"), known, alias, provisional=True).orderBy("seq").collect()
    assert [r.matched_by for r in out] == ["slug", "spotify", "alias", "slug", "created", "created", None, "created"]
    assert [r.entity_id for r in out[:4]] == ["1", "1", "1", "2"]
    assert len({out[i].entity_id for i in (4, 5, 7)}) == 1 and out[4].entity_status == "provisional"
    assert resolve.resolve_artists(spark.createDataFrame(ask, "seq int, name string, spotify_id string"), known.limit(0), create=False).where("entity_id is not null").count() == 0


def test_songs(spark):
    known = spark.createDataFrame([(1, 7, "Essence (feat. T)", "ann-essence", "t1"), (2, 8, "Essence", "bob-essence", None)], "id int, artist_id int, title string, slug string, spotify_track_id string")
    ask = [(0, 7, "ann", "ESSENCE", None), (1, 8, "bob", "essence", None), (2, 9, "cy", "essence", None), (3, 9, "cy", "z", "t1"), (4, None, None, "essence", None)]
    out = resolve.resolve_songs(spark.createDataFrame(ask, "seq int, artist_id int, artist_slug string, title string, spotify_track_id string"), known).orderBy("seq").collect()
    assert [(r.entity_id if r.matched_by != "created" else "", r.matched_by) for r in out] == [("1", "title"), ("2", "title"), ("", "created"), ("1", "track"), (None, None)]


def test_discovery_routes(spark):
    known = spark.createDataFrame([(1, "Ann", "ann", "s1"), (2, "Bob", "bob", None)], "id int, name string, slug string, spotify_id string")
    ask = [(0, "s1", "Other", 5), (1, "s2", "bob", 6), (2, "s3", "Ann", 7), (3, "s4", "Cy", None)]
    out = resolve.route_discovered(spark.createDataFrame(ask, "seq int, spotify_id string, name string, monthly_listeners long"), known).orderBy("seq").collect()
    assert [(r.route, r.artist_id) for r in out] == [("known", "1"), ("link", "2"), ("drop", None), ("create", None)]


def test_streamed_trends_and_snapshots(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "song_id string, chart_name string, chart_territory string, chart_week date, position int, seq int"
    d = lambda n: date(2024, 1, n)
    for n, rows in enumerate([[("a", "c", "t", d(5), 3, 0)], [("a", "c", "t", d(12), 1, 1), ("a", "c", "t", d(5), 3, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = snapshots.snapshot_sink(stream, table, ["song_id"], "chart_week", "seq", str(tmp_path / "q1")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        q = snapshots.chart_trends(stream).writeStream.format("parquet").option("path", str(tmp_path / "trend")).option("checkpointLocation", str(tmp_path / "q2")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert sorted((r.chart_week, r.position) for r in spark.read.parquet(table).collect()) == [(d(5), 3), (d(12), 1)]
    assert sorted((r.chart_week, r.prev_rank, r.trend) for r in spark.read.parquet(str(tmp_path / "trend")).where("position = 1").collect()) == [(d(12), 3, "UP")]


def test_external_ids_of_songs_and_write_back(spark):
    known = spark.createDataFrame([(1, 7, "Joro", "joro", None)], "id int, artist_id int, title string, slug string, spotify_track_id string")
    external = spark.createDataFrame([(1, "spotify", "t9"), (1, "other", "t8")], "song_id int, source string, external_id string")
    ask = spark.createDataFrame([(0, 7, "wiz", "Other", "t9"), (1, 7, "wiz", "Else", "t8")], "seq int, artist_id int, artist_slug string, title string, spotify_track_id string")
    out = resolve.resolve_songs(ask, known, external=external, create=False).orderBy("seq")
    assert [(r.entity_id, r.matched_by) for r in out.collect()] == [("1", "external"), (None, None)]
    aliases, ids = resolve.write_back(out, "chart", name="title", external="spotify_track_id")
    assert [tuple(r) for r in aliases.collect()] == [("1", "other", "Other", "chart", 0)]
    assert [tuple(r) for r in ids.collect()] == [("1", "spotify", "t9", 0)]
