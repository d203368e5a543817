import random
from datetime import date, timedelta

import pytest

from chartspark.operators import backfill, charts, resolve
from chartspark.operators.components import components
from chartspark.plans import staging


def test_components_of_chains_hubs_and_pairs(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, 1000 + i) for i in range(300)]
    pairs = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    rnd.shuffle(chain)
    links = [*chain, *hub, *pairs, (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_identities_by_ids_of_any_source_and_stored_forms(spark):
    known = spark.createDataFrame([(1, "Renamed", "ann", None, "ann lee"), (2, "Bob", "bob", "s2", "bob")], "id int, name string, slug string, spotify_id string, normalized_name string")
    external = spark.createDataFrame([(2, "deezer", "d2"), (1, "spotify", "s1")], "artist_id int, source string, external_id string")
    ask = [
        (0, "Ann Lee", None, None, False),  # the stored form, not that of the name
        (1, "Renamed", None, [("deezer", "x1")], True),  # new: its form is stored by none
        (2, "Else", None, [("deezer", "d2")], False),  # by an id of another source
        (3, "Zed", None, [("deezer", "x1"), ("mb", "m1")], False),  # with 1
        (4, "Zoo", None, [("mb", "m1")], False),  # with 3, so with 1
        (5, "Q", None, [("d2", "deezer")], False),  # source and id are not mixed up
        (6, "R", "s1", None, False),
        (7, "Elsewhere", None, [("tidal", "t")], False), (8, "ELSE", None, [("tidal", "t")], False),  # 8 has the form that 2 gave to Bob
        (9, "!!", None, None, False), (10, None, None, [("mb", None)], False),
    ]
    mentions = spark.createDataFrame(ask, "seq int, name string, spotify_id string, external_ids array<struct<source:string,external_id:string>>, provisional boolean")
    got = {r.seq: r for r in resolve.resolve_artists(mentions, known, external=external).collect()}
    assert [got[i].entity_id for i in (0, 2, 6)] == ["1", "2", "1"]
    assert {got[i].entity_id for i in (1, 3, 4)} == {got[1].entity_id} and len(got[1].entity_id) == 64
    assert {got[i].entity_status for i in (1, 3, 4)} == {"provisional"}  # as the first mention says
    assert got[5].matched_by == "created" and got[5].entity_status == "canonical"
    assert [(got[i].entity_id, got[i].matched_by) for i in (7, 8)] == [("2", "batch")] * 2
    assert [got[i].entity_id for i in (9, 10)] == [None, None]


def test_featured_artists_are_provisional_and_leads_are_not(spark):
    artists = spark.createDataFrame([], "id int, name string, slug string, spotify_id string")
    songs = spark.createDataFrame([], "id int, artist_id int, title string, slug string, spotify_track_id string")
    rows = spark.createDataFrame([(0, "Ann", "T", ["Bob"]), (1, "Bob", "U", ["Cy"]), (2, "Cy", "T", ["Ann"])], "seq int, artist string, title string, featured array<string>")
    got = {r.name: r.entity_status for r in charts.resolved(rows, artists, songs)["mentions"].collect()}
    assert got == {"Ann": "canonical", "Bob": "provisional", "Cy": "provisional"}


def _pages(spark):
    rows = []
    for w in range(12):
        day = date(2020, 1, 3) + timedelta(weeks=w)
        rows += [(day, p, f"Act {p % 4} Featuring Guest {w % 3}", f"Song {(p + w) % 6}", p, w) for p in range(1, 9)]
    return spark.createDataFrame(rows, "week date, this_week int, artist string, song string, peak_position int, weeks_on_chart int")


def _tables(spark):
    return {
        "artists": spark.createDataFrame([(1, "Act 1", "act-1", None)], "id int, name string, slug string, spotify_id string"),
        "songs": spark.createDataFrame([(5, 1, "Song 3", "act-1-song-3", None)], "id int, artist_id int, title string, slug string, spotify_track_id string"),
        "chart_entries": spark.createDataFrame([("billboard_hot_100", "US", date(2020, 1, 10), "5", 2), ("other", "US", date(2020, 1, 3), "9", 1)], "chart_name string, chart_territory string, chart_week date, song_id string, position int"),
        "song_features": spark.createDataFrame([], "song_id int, featured_artist_id int"),
    }


def _plain(pages, tables):
    """The rows of a run that takes one week and one row after another."""
    kept, taken = [], {(r.chart_week, r.song_id) for r in tables["chart_entries"].where("chart_name <> 'other'").collect()}
    places = {(r.chart_week, r.position) for r in tables["chart_entries"].where("chart_name <> 'other'").collect()}
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in sorted(pages.collect(), key=lambda r: (r.week, r.this_week)):
        act = r.artist.split(" Featuring ")[0]
        slug = act.lower().replace(" ", "-")
        artist = "1" if act == "Act 1" else sha(slug)
        song = "5" if (act, r.song) == ("Act 1", "Song 3") else sha(f"{slug}-{r.song.lower().replace(' ', '-')}")
        if (r.week, song) in taken or (r.week, r.this_week) in places:
            continue
        taken.add((r.week, song))
        places.add((r.week, r.this_week))
        kept.append((r.week, r.this_week, artist, song, r.peak_position, r.weeks_on_chart))
    return sorted(kept)


def _entries(result):
    return sorted(tuple(r) for r in result["entries"].select("chart_week", "position", "artist_id", "song_id", "peak_position", "weeks_on_chart").collect())


def test_a_backfill_that_breaks_off_goes_on_to_the_same_tables(spark, tmp_path):
    pages, tables = _pages(spark), _tables(spark)
    want = _plain(pages, tables)
    seen = []

    def broken(p):
        seen.append(p)
        if len(seen) == 3:
            raise OSError("the driver is lost")

    folder = f"file://{tmp_path}/run"
    with pytest.raises(OSError, match="lost"):
        backfill.run(pages, backfill.HOT_100, tables, folder, weeks_a_batch=2, progress=broken)
    half = len(staging.Log(spark, f"{folder}/_log").entries())
    assert half == 4
    later = []
    done = backfill.run(pages, backfill.HOT_100, tables, folder, weeks_a_batch=2, progress=later.append)
    assert len(later) == 3 and [p["totalDates"] for p in [*seen, *later]] == [2, 4, 6, 8, 10, 12]
    assert later[-1] == {"totalDates": 12, "totalCharts": 12, "totalEntries": len(want), "currentDate": "2020-01-03", "percent": 100}
    assert _entries(done) == want
    assert _entries(backfill.run(pages, backfill.HOT_100, tables, folder)) == want  # nothing is left to do
    whole = backfill.run(pages, backfill.HOT_100, tables, f"file://{tmp_path}/whole")
    for k in ("features", "mentions"):
        assert sorted(map(tuple, whole[k].collect())) == sorted(map(tuple, done[k].collect()))
    assert {r.entity_status for r in done["mentions"].where("name like 'Guest%'").collect()} == {"canonical"}
    assert backfill.counters(pages, done).collect()[0].asDict() == {"dates": 12, "entries": len(want)}


def test_a_backfill_of_nothing(spark, tmp_path):
    done = backfill.run(_pages(spark).where("false"), backfill.UK_SINGLES, _tables(spark), f"file://{tmp_path}/none")
    assert done["entries"].count() == 0 and done["features"].count() == 0


def test_a_log_takes_each_number_once(spark, tmp_path):
    log = staging.Log(spark, f"file://{tmp_path}/log")
    assert log.entries() == [] and log.last() is None
    log.commit({"a": 1}, 0)
    with pytest.raises(staging.Conflict):
        log.commit({"a": 2}, 0)
    log.commit({"b": "é"}, 1)
    assert staging.Log(spark, f"file://{tmp_path}/log").entries() == [{"a": 1}, {"b": "é"}]
    assert [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")] == []


def test_persistence_makes_each_step_once(spark):
    """The plan of a batch's entries reads staged tables: a few exchanges, not the batch over and over."""
    rows = spark.createDataFrame([(0, "c", "t", date(2020, 1, 3), 1, "Ann", "T", ["Bob"])], "seq int, chart_name string, chart_territory string, chart_week date, rank int, artist string, title string, featured array<string>")
    t = _tables(spark)
    plan = charts.persisted(rows, t["artists"], t["songs"], t["chart_entries"], t["song_features"])["entries"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 10


def test_a_part_of_a_batch_is_made_alone(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "c", "t", date(2020, 1, 3), 1, "Ann", "T", ["Bob"])], "seq int, chart_name string, chart_territory string, chart_week date, rank int, artist string, title string, featured array<string>")
    t = _tables(spark)
    monkeypatch.setattr(charts, "accepted", lambda *_: pytest.fail("entries are not asked for"))
    got = charts.persisted(rows, t["artists"], t["songs"], t["chart_entries"], t["song_features"], parts=["features"])
    assert list(got) == ["features"] and got["features"].count() == 1
