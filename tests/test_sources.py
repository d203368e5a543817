from datetime import date

import pytest

from chartspark.sources import documents, pages
from chartspark.sources.html import elements, parse


@pytest.fixture
def page(spark):
    return lambda html: spark.createDataFrame([("u", html), ("none", None), ("empty", "")], "url string, html string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_tree_closes_open_cells():
    t = parse("<table><tr><td>a<td>b &amp; c<tr><td>d<br>e</table><p>x<p>y")
    assert [[c.text() for c in r.find("td")] for r in t.find("tr")] == [["a", "b & c"], ["de"]]
    assert [p.text() for p in t.find("p")] == ["x", "y"]


def test_daily_chart(page):
    html = "<h1>Chart - 2024-01-05 | x</h1><table><tr><td>note</td></tr><tr><th>Pos</th><th>Artist and Title</th></tr><tr><td>2</td><td>B - Two (feat. C &amp; D)</td></tr><tr><td>1</td><td><a>A</a> <a>One</a></td></tr><tr><td>-</td><td>E - None</td></tr><tr><td>3</td><td>F - Three</td></tr></table>"
    got = rows(pages.daily_chart(page(html), limit=2).orderBy("rank"), "page_date", "rank", "artist", "title", "featured")
    assert got == [(date(2024, 1, 5), 1, "A", "One", []), (date(2024, 1, 5), 2, "B", "Two", ["C", "D"])]
    assert rows(pages.daily_chart(page(html), max_rank=1), "rank") == [(1,)]


def test_discovery_pages(page):
    html = '<a href="/artist/x1.html"></a><a href="/artist/x1.html">X</a><a href="/artist/x1.html">Y</a><a href="/artist/q/">Q</a>'
    assert rows(pages.discovered_on_charts(page(html)), "spotify_id", "name") == [("x1", "X")]
    html = '<table><tr><td>1<td><a href="artist/a_songs.html">A</a><td>1,000<td>-5<td>2<td>2,000</tr><tr><td>2<td><a href="artist/b.html">B</a><td>9<td>1<td>10</tr><tr><td>3<td><a href="artist/c.html"></a><td>9<td>1<td>10</tr><tr><td>4<td><a href="artist/c.html">C</a><td>9<td>1<td>10</tr></table>'
    assert rows(pages.listener_page(page(html)).orderBy("seq"), "spotify_id", "monthly_listeners", "daily_change", "peak_rank", "peak_listeners") == [("a", 1000, -5, 2, 2000), ("b", 9, 1, None, 10)]


def test_totals_page(page):
    html = '<body><h1>Ann - Spotify Top Songs</h1>Last updated: 2026/04/09<table><tr><td>Streams<td>1,0<td>2<td>3<td>4</tr><tr><td>Daily<td>5<td>6<td>7<td>8</tr><tr><td>Tracks<td>9<td><td><td></tr></table><table><tr><td>* <a href="https://open.spotify.com/track/t1">Song</a><td>12<td>3</tr><tr><td>*<td>1<td>1</tr></table></body>'
    assert rows(pages.artist_totals(page(html)), "artist_name", "source_updated_at", "total_streams", "total_streams_as_feature", "daily_streams_as_feature", "track_count") == [("Ann", date(2026, 4, 9), 10, 4, 8, 9)]
    assert rows(pages.song_totals(page(html)), "track_id", "title", "spotify_streams", "daily_streams", "is_feature") == [("t1", "Song", 12, 3, True)]


def test_award_page(page):
    row = '<tr class="table_award_row" id="default_7"><td class="artists_cell">Ann</td><td class="others_cell">Song</td><td class="others_cell">May 1, 2020</td><td class="others_cell">Label</td><td class="format_cell">SINGLE MORE DETAILS</td><td><i class="share_text" data-share-desc="{}"></i></td></tr>'
    html = "<table>" + row.format("earned RIAA 2x Platinum Award for GOLD") + row.format("nothing") + "</table>"
    assert rows(pages.award_rows(page(html)), "riaa_id", "level", "units", "certified_at", "format") == [("7", "platinum", 2, "May 1, 2020", "SINGLE")]


def test_weekly_page(page):
    html = '<div class="chart-item"><b class="position">2</b><h3>NEW song two</h3><p>Song TwoBob</p><i class="peak">1</i><i class="weeks">1,2</i></div><div class="chart-item"><b class="position">2</b><h3>later</h3><p>X</p></div><li><b class="position">1</b><h4>One</h4><p>Ann</p></li><li><b class="position">101</b><h4>One</h4><p>Ann</p></li><li><b class="position">3</b><h4>One</h4></li>'
    got = rows(pages.weekly_chart(page(html)).orderBy("position"), "position", "song", "artist", "peak_position", "weeks_on_chart")
    assert got == [(1, "One", "Ann", None, None), (2, "Song Two", "Bob", 1, 12)]


def test_weekly_page_prefers_the_surest_mark(page):
    html = (
        '<li><b class="position">1</b><h4>First on the page</h4><p>Low</p></li><article data-chart-position="1"><h3>RE one</h3><p></p><p>ONE New Ann</p></article>'
        '<div class="chart-item"><i data-chart-position="No. 2"></i><b class="position">9</b><h3>two</h3><p>NewBob</p></div><li><b class="position">99999999999</b><h4>x</h4><p>y</p></li>'
        '<li><b class="position">3</b><h4>Same</h4><p>same</p></li><li class="chart-list-item"><b class="chart-key">4</b><span class="track-title">re-run</span><span class="artist">Re</span><i class="peak">1,2</i></li>'
    )
    got = rows(pages.weekly_chart(page(html)).orderBy("position"), "seq", "position", "song", "artist", "peak_position", "weeks_on_chart")
    assert got == [(0, 1, "One", "New Ann", None, None), (1, 2, "Two", "Bob", None, None), (3, 4, "Re-run", "Re", 12, None)]


def test_documents(spark):
    def landed(*bodies, **more):
        return spark.createDataFrame([(b,) for b in bodies], "body string")

    a = documents.artists(landed('{"artists":[null,{"id":"1","genres":["x",null]}]}', None, "junk"))
    assert rows(a, "spotify_id", "name", "followers", "genres") == [("1", "", 0, ["x"])]
    t = documents.tracks(landed('{"tracks":[{"id":"1","name":"n","album":{"images":[{"url":"i"}]}}]}'))
    assert rows(t, "title", "album_type", "album_image_url", "explicit") == [("n", "album", "i", False)]
    assert rows(documents.chart_dates(landed('["2020-01-01","2021-01-01","2022-01-01"]'), "2021-01-01"), "chart_week") == [("2022-01-01",), ("2021-01-01",)]
    w = spark.createDataFrame([("2020-01-01", '{"data":[{"song":"s","artist":"a","this_week":1}]}'), ("2020-01-08", None)], "chart_week string, body string")
    assert rows(documents.weekly_entries(w), "chart_week", "song", "this_week") == [("2020-01-01", "s", 1)]
    s = spark.createDataFrame([("Ann", '{"artists":[{"name":"Bob","score":90,"country":"US"},{"name":"ann","score":"94","area":{"iso-3166-1-codes":["ng"]},"country":"US"}]}'), ("Low", '{"artists":[{"name":"x","score":50,"country":"US"}]}'), ("None", "{}"), ("Null", None)], "name string, body string")
    assert sorted(rows(documents.origin_country(s), "name", "origin_country")) == [("Ann", "NG"), ("Low", None), ("None", None), ("Null", None)]


def test_discovery_from_pages_to_unique_artists(spark):
    from chartspark.operators import jobs

    link = lambda *who: "".join(f'<a href="/artist/{i}.html">{n}</a>' for i, n in who)
    row = lambda i, n, heard: f'<tr><td>1<td><a href="artist/{i}.html">{n}</a><td>{heard}<td>1<td>9</tr>'
    charts = spark.createDataFrame([("c1", link(("a", "Ann"), ("b", "Bob"))), ("c2", link(("a", "ANN x"), ("d", "ann")))], "url string, html string")
    heard = spark.createDataFrame([("l1", "<table>" + row("a", "Ann", "1,000") + row("d", "ann", "7") + "</table>")], "url string, html string")
    merged = jobs.merge_discovered(pages.discover_all(charts, heard))
    assert sorted(tuple(r) for r in jobs.unique_discovered(merged).select("spotify_id", "name", "appeared", "monthly_listeners").collect()) == [("a", "Ann", 3, 1000), ("b", "Bob", 1, None)]
    assert [(r.normalized, r.kept_id, [x.spotify_id for x in r.rejected]) for r in jobs.duplicate_report(merged).collect()] == [("ann", "a", ["d"])]


def test_ranks_beyond_32_bits_are_no_ranks():
    assert pages._digits("99999999999") == 0 and pages._digits("#1,2") == 12


def test_long_pages_are_read_row_by_row(spark):
    """Of a long page one row is held at a time, rows come before the page has ended, and its pieces may be cut anywhere."""
    row = '<tr class="x"><td>{0} &amp; é😀<!-- <tr> --><td><a href="artist/a{0}.html">A{0}</a><td>1,000<td>-5<td>2<td>2,000</tr>\n'
    html = "<body><p>top<table>" + "".join(row.format(i) for i in range(50)) + '<tr><td><table><tr><td>in</table><tr/></table><tr><td>out<script>"<tr>"</script>'
    tree = lambda n: (n.tag, n.attrs, n.text())
    want = [tree(r) for t in parse(html).find("table")[:1] for r in t.find("tr")]
    assert len(want) == 53
    for size in (1, 2, 7, 4096):
        cut = [html[i : i + size] for i in range(0, len(html), size)]
        assert [tree(r) for r in elements(cut, lambda n: n.tag == "tr", "table")] == want
        assert tree(parse(cut)) == tree(parse(html)) and [tree(n) for n in parse(cut).walk()] == [tree(n) for n in parse(html).walk()]

    def endless():
        for i in range(10**9):
            assert i < 100, "a row has to come before its page has ended"
            yield row.format(i)

    assert next(elements(endless(), lambda n: n.tag == "tr")).text().startswith("0 & é😀")

    many = spark.range(4).selectExpr("concat('u', id) AS url", f"concat('<table>', array_join(transform(sequence(1, 3000), i -> replace('{row.strip()}', '{{0}}', concat(id, 'x', i))), ''), '</table>') AS html")
    sent = []

    def reader(pieces):
        for p in pieces:
            yield (len(sent), str(len(p)), None, None, None, None, None)

    sizes = pages.read_pages(many.coalesce(1), reader, pages.LISTENERS).groupBy("url").agg({"spotify_id": "count", "name": "count"}).collect()
    assert len(sizes) == 4 and all(r["count(spotify_id)"] > 50 for r in sizes)
    got = pages.listener_page(many.coalesce(1)).selectExpr("count(*)", "count(DISTINCT spotify_id)", "max(seq)", "min(monthly_listeners)").first()
    assert tuple(got) == (12000, 12000, 2999, 1000)
