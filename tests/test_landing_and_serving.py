from datetime import date
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from chartspark.plans import serving, views
from chartspark.plans.fixtures import Tables
from chartspark.sources import landing, pages


def land(folder, rows):
    """As a fetcher writes pages."""
    for url, html, kind, day in rows:
        if html is not None:
            at = folder / f"kind={kind}" / f"day={day}"
            at.mkdir(parents=True, exist_ok=True)
            (at / quote_plus(url)).write_text(html, encoding="utf-8")


def test_landed_pages_are_read_in_batches_and_streams_alike(spark, tmp_path):
    zone = f"file://{tmp_path}/zone"
    html = '<li><b class="position">1</b><h4>One</h4><p>Ann</p></li>'
    rows = [("https://x.com/charts/uk/20240105/1/", html, "weekly", date(2024, 1, 5)), ("https://x.com/a?b=c d", html.replace("One", "Två\nZ"), "weekly", date(2024, 1, 12)), ("u", html, "daily", date(2024, 1, 5)), ("v", None, "daily", date(2024, 1, 5))]
    land(tmp_path / "zone", rows)
    assert spark.createDataFrame([(rows[1][0],)], "u string").select(landing.file_name(F.col("u"))).first()[0] == quote_plus(rows[1][0])
    got = sorted(tuple(r) for r in landing.read(spark, zone).collect())
    assert got == sorted(r for r in rows if r[1] is not None)
    wanted = (F.col("kind") == "weekly", F.col("day") >= date(2024, 1, 6))
    one = landing.read(spark, zone, *wanted)
    assert [r.url for r in one.collect()] == [rows[1][0]]
    # Unwanted files are not opened: a folder that cannot be read does no harm.
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "kind#" in plan.split("PartitionFilters")[1].split("]")[0]
    bad = tmp_path / "zone/kind=daily/day=2024-01-05/u"
    bad.chmod(0)
    assert landing.read(spark, zone, *wanted).count() == 1
    bad.chmod(0o644)
    assert [tuple(r) for r in pages.weekly_chart(one).select("position", "song", "artist").collect()] == [(1, "Två Z", "Ann")]
    seen = []
    for more in ([], [("w", html, "weekly", date(2024, 1, 19))]):
        if more:
            land(tmp_path / "zone", more)
        q = landing.stream(spark, zone, wanted[0]).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert sorted(seen) == sorted(tuple(r) for r in landing.read(spark, zone, wanted[0]).collect()) and len(seen) == 3


@pytest.mark.parametrize("name", ["current_charts", "songs_by_artist", "artist_momentum", "country_streams"])
def test_served_models_answer_from_the_files_of_a_part(spark, model, tmp_path, name):
    view, layout = serving.LAYOUTS[name]
    rows, folder = views.VIEWS[view](Tables(spark, model)), f"file://{tmp_path}/{name}"
    with pytest.raises(LookupError):
        serving.served(spark, folder, layout)
    serving.publish(rows, folder, layout)
    asked = {
        "current_charts": {"chart_territory": "ASIA", "chart_name": "1-URGENT"}, "songs_by_artist": {"artist_id": 3},
        "artist_momentum": {"snapshot_date": date(2024, 1, 15)}, "country_streams": {"origin_country": rows.first()["origin_country"]} if name == "country_streams" else {},
    }[name]
    found = serving.served(spark, folder, layout, **asked)
    want = rows
    for c, v in asked.items():
        want = want.where(F.col(c) == F.lit(v))
    got = [tuple(r) for r in serving.top(found.select(rows.columns), layout, 10).collect()]
    assert got == [tuple(r) for r in serving.top(want, layout, 10).collect()] and got
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "part_" in text.split("PartitionFilters: [")[1].split("]")[0]
    read = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    every = serving.served(spark, folder, layout).inputFiles()
    assert 0 < len(read) < len(every)
    part = want.limit(1)
    serving.publish(part, folder, layout)  # the next version
    assert serving.served(spark, folder, layout).count() == 1
