"""Readers of landed source pages (``url, html``), one row for each record, without a shuffle.

A landing zone holds pages as they were fetched; a fetch that failed has no row there. A null page
gives no records. ``seq`` is the place of a record in its page, for rules of the kind "first wins".
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspark.functions import parse as values
from chartspark.functions import text
from chartspark.sources.html import Node, elements, first_text, parse

CHART = "url string, seq int, heading string, rank int, credit string, link_artist string, link_title string"
LISTENERS = "url string, seq int, spotify_id string, name string, listeners string, daily string, peak_rank string, peak_listeners string"
TOTALS = "url string, artist_name string, last_updated string, streams array<string>, daily array<string>, tracks string"
SONGS = "url string, seq int, raw_title string, track_id string, streams string, daily string"
AWARDS = "url string, seq int, riaa_id string, share string, artist string, title string, certified_at string, label string, format string"


#: Characters of a page that go to a reader as one row, and records that come back as one batch.
PIECE, RECORDS = 4096, 4096


def of_tree(of: Callable[[Node], Iterable[tuple]]) -> Callable[[Iterator[str]], Iterable[tuple]]:
    """A reader of the tree of a page."""
    return lambda pieces: of(parse(pieces))


def of_elements(of: Callable[[Iterator[Node]], Iterable[tuple]], test: Callable[[Node], bool], within: str = "") -> Callable[[Iterator[str]], Iterable[tuple]]:
    """A reader of a page's elements (see ``html.elements``), one after another: for lists of any length."""
    return lambda pieces: of(elements(pieces, test, within))


def read_pages(pages: DataFrame, reader: Callable[[Iterator[str]], Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that ``reader`` finds in each page, in the order of ``schema`` after the url. Pages go to it in pieces, in order
    and without a shuffle, so neither a batch of pages nor a long page is in a reader's memory whole."""
    target = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in pages.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, str, str]]:
            page = 0
            for b in batches:
                for url, at, piece in zip(*(b.column(c) for c in ("url", "at", "piece")), strict=True):
                    page += at.as_py() == 0
                    yield page, url.as_py(), piece.as_py()

        found = ((url, *r) for (_, url), of in groupby(pieces(), lambda p: p[:2]) for r in reader(p[2] for p in of))
        while out := list(islice(found, RECORDS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    cut = F.regexp_extract_all("html", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    return pages.select("url", F.posexplode(cut).alias("at", "piece")).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[kind]


def _cells(row: Node, tags: str = "td") -> list[Node]:
    return row.find(tags)


def _digits(s: str) -> int:
    """The digits of a rank cell as a number; 0, which is no rank, without digits or beyond 32 bits."""
    got = re.sub(r"[^0-9]", "", s)
    return int(got) if got and int(got) < 2**31 else 0


def _daily_chart(page: Node) -> list[tuple]:
    tables = page.find("table")
    table = next((t for t in tables if len(t.find("tr")) > 50), tables[0] if tables else None)
    if table is None:
        return []
    heading, rows = first_text(page.find("h1,h2")), table.find("tr")
    heads = [[c.text().strip().lower() for c in _cells(r, "th,td")] for r in rows[:6]]
    is_head = [any(c in ("pos", "position", "rank", "#") for c in h) and any("artist" in c or "title" in c for c in h) for h in heads]
    head = is_head.index(True) if True in is_head else 0
    names = heads[head] if heads else []
    rank_at = next((i for i, c in enumerate(names) if any(k in c for k in ("pos", "rank", "#"))), 0)
    credit_at = next((i for i, c in enumerate(names) if "artist" in c or "title" in c), max(len(names) - 1, 1))
    out = []
    for seq, row in enumerate(rows[head + 1 :]):
        cells = _cells(row)
        if len(cells) > max(rank_at, credit_at) and (rank := _digits(cells[rank_at].text())) > 0:
            links = [a.text() for a in cells[credit_at].find("a")]
            out.append((seq, heading, rank, cells[credit_at].text(), *(links[:2] if len(links) > 1 else ("", ""))))
    return out


def daily_chart(pages: DataFrame, limit: int | None = None, max_rank: int | None = None) -> DataFrame:
    """``url, label, page_date, rank, artist, title, featured``: the first ``limit`` accepted rows of each page's chart table.

    ``limit`` of none takes all rows; ``max_rank`` leaves out greater ranks first.
    """
    rows = read_pages(pages, of_tree(_daily_chart), CHART)
    if max_rank is not None:
        rows = rows.where(F.col("rank") <= max_rank)
    parts = rows.withColumn("p", text.split_artist_title(text.normalize_all(F.col("credit"))))
    whole = (F.col("p.artist") != "") & (F.col("p.title") != "")
    parts = parts.withColumn("artist", F.when(whole, F.col("p.artist")).otherwise(text.normalize_all(F.col("link_artist")))).withColumn("raw", F.when(whole, F.col("p.title")).otherwise(text.normalize_all(F.col("link_title"))))
    found = parts.where("artist <> '' and raw <> ''")
    if limit is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where(F.col("n") <= limit)
    clean = text.extract_features(F.col("raw"))
    day = F.try_to_date(F.nullif(F.regexp_extract("heading", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    return found.select("url", F.col("heading").alias("label"), day.alias("page_date"), "rank", "artist", clean["title"].alias("title"), clean["featured"].alias("featured"))


def _chart_artists(links: Iterator[Node]) -> Iterator[tuple]:
    for seq, a in enumerate(links):
        if m := re.search(r"/artist/([A-Za-z0-9]+)\.html$", a.attrs["href"]):
            yield seq, m[1], a.text().strip(), None, None, None, None


def discovered_on_charts(pages: DataFrame) -> DataFrame:
    """``url, seq, spotify_id, name`` of the artists linked from each chart page, first named link of an id."""
    reader = of_elements(_chart_artists, lambda n: n.tag == "a" and "/artist/" in n.attrs.get("href", ""))
    rows = read_pages(pages, reader, LISTENERS).where("name <> ''")
    return rows.groupBy("url", "spotify_id").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))


def _listeners(rows: Iterator[Node]) -> Iterator[tuple]:
    seen = set()
    for seq, row in enumerate(rows):
        cells = _cells(row)
        links = row.find(lambda n: n.tag == "a" and "artist/" in n.attrs.get("href", ""))
        m = re.search(r"(?:^|/)artist/([A-Za-z0-9]+)(?:_[a-z]+)?\.html$", links[0].attrs["href"]) if links else None
        if len(cells) < 5 or m is None or m[1] in seen:
            continue
        seen.add(m[1])  # before the name is looked at
        if name := links[0].text().strip():
            t = [c.text() for c in cells]
            yield seq, m[1], name, t[2], t[3], *((t[4], t[5]) if len(t) > 5 else (None, t[4]))


def listener_page(pages: DataFrame) -> DataFrame:
    """Monthly listeners; pages of five columns have no peak rank."""
    n = values.signed_number
    return read_pages(pages, of_elements(_listeners, lambda n: n.tag == "tr", "table"), LISTENERS).select("url", "seq", "spotify_id", "name", n(F.col("listeners")).alias("monthly_listeners"), n(F.col("daily")).alias("daily_change"), n(F.col("peak_rank")).cast("int").alias("peak_rank"), n(F.col("peak_listeners")).alias("peak_listeners"))


def _totals(page: Node) -> list[tuple]:
    name = first_text(page.find("h1,h2")).replace("- Spotify Top Songs", "", 1).strip()
    body = page.find("body")
    day = re.search(r"Last updated:\s*(\d{4}/\d{2}/\d{2})", (body[0] if body else page).text())
    found: dict[str, list[str]] = {}
    for row in (page.find("table") or [Node("table", {})])[0].find("tr"):
        cells = [c.text() for c in _cells(row)]
        if len(cells) > 4:
            found[cells[0].strip().lower()] = cells[1:5]
    return [(name, day[1] if day else "", found.get("streams", [""] * 4), found.get("daily", [""] * 4), found.get("tracks", [""])[0])]


def artist_totals(pages: DataFrame) -> DataFrame:
    """One row a page: the artist's totals; what a page lacks is 0."""
    n = values.unsigned_number
    t = read_pages(pages, of_tree(_totals), TOTALS)
    wide = {"total_streams": F.col("streams")[0], "total_streams_as_lead": F.col("streams")[1], "total_streams_solo": F.col("streams")[2], "total_streams_as_feature": F.col("streams")[3], "daily_streams": F.col("daily")[0], "daily_streams_as_lead": F.col("daily")[1], "daily_streams_as_feature": F.col("daily")[3]}
    return t.select("url", "artist_name", values.source_date(F.col("last_updated")).alias("source_updated_at"), *[n(c).alias(k) for k, c in wide.items()], n(F.col("tracks")).cast("int").alias("track_count"))


def _songs(page: Node) -> list[tuple]:
    tables, out = page.find("table"), []
    for seq, row in enumerate(tables[1].find("tr") if len(tables) > 1 else []):
        cells = _cells(row)
        if len(cells) > 2:
            href = next((a.attrs.get("href", "") for a in cells[0].find("a")), "")
            m = re.search(r"open\.spotify\.com/track/([A-Za-z0-9]+)", href)
            out.append((seq, cells[0].text().strip(), m[1] if m else "", cells[1].text(), cells[2].text()))
    return out


def song_totals(pages: DataFrame) -> DataFrame:
    """One row a song of each totals page; a leading * marks a feature."""
    n = values.unsigned_number
    t = read_pages(pages, of_tree(_songs), SONGS).withColumn("title", F.trim(F.regexp_replace("raw_title", r"^\*\s*", ""))).where("title <> ''")
    return t.select("url", "seq", "track_id", "title", n(F.col("streams")).alias("spotify_streams"), n(F.col("daily")).alias("daily_streams"), F.col("raw_title").startswith("*").alias("is_feature"))


def _awards(rows: Iterator[Node]) -> Iterator[tuple]:
    for seq, row in enumerate(rows):
        of = lambda c: [x for x in row.find("td") if c in x.classes]
        share = next((x.attrs.get("data-share-desc", "") for x in row.find(lambda n: "share_text" in n.classes)), "")
        other = [x.text().strip() for x in of("others_cell")] + ["", "", ""]
        artist, form = ("".join(x.text() for x in of(c)) for c in ("artists_cell", "format_cell"))
        yield seq, row.attrs.get("id", "").replace("default_", "", 1), share, artist.strip(), *other[:3], form.replace("MORE DETAILS", "", 1).strip()


def award_rows(pages: DataFrame) -> DataFrame:
    """Certifications of an award search page; rows without an artist, a title or a level go."""
    reader = of_elements(_awards, lambda n: n.tag == "tr" and "table_award_row" in n.classes)
    rows = read_pages(pages, reader, AWARDS).withColumn("award", values.award_level(F.col("share")))
    return rows.where("artist <> '' and title <> '' and award.level <> ''").select("url", "seq", "riaa_id", "artist", "title", "award.level", "award.units", "certified_at", "label", "format")


def _has(*classes: str, tags: tuple[str, ...] = ()) -> Callable[[Node], bool]:
    return lambda n: n.tag in tags or not n.classes.isdisjoint(classes)


#: What may mark a row of a weekly chart, the surest first, and what stands for its parts.
ROW_MARKS = (lambda n: "data-chart-position" in n.attrs, _has("chart-item"), _has("chart-list-item"), _has(tags=("article",)), _has(tags=("li",)))
PLACE, PEAK, WEEKS = _has("position", "chart-key", "chart-position"), _has("peak", "chart-peak"), _has("weeks", "chart-weeks")
TITLE = _has("title", "chart-name", "track-title", tags=("h3", "h4"))
ARTIST = _has("artist", "chart-artist", "artist-name", tags=("p",))
CANDIDATES = "url string, seq int, mark int, places array<string>, title string, artists array<string>, peak string, weeks string"
#: What a weekly chart puts before a title or credit that is new or back.
FRESH = r"(?i)^(?:New|RE)(?=\s*[A-Z0-9])"


def _candidates(page: Node) -> list[tuple]:
    """Every element that may be a row, once for each mark it bears, with the texts of its parts as they stand."""
    out = []
    for seq, el in enumerate(page.walk()):
        marks = [m for m, bears in enumerate(ROW_MARKS) if bears(el)]
        if not marks:
            continue
        below = list(el.walk())
        texts = lambda of: [n.text() for n in below if of(n)]  # noqa: B023, E731
        first = lambda of: next(iter(texts(of)), "")  # noqa: B023, E731
        attributes = [n.attrs.get("data-chart-position", "") for n in (el, *below)]
        places = [attributes[0], next((x for x in attributes[1:] if x), ""), first(PLACE)]
        parts = (places, first(TITLE), texts(ARTIST), first(PEAK), first(WEEKS))
        out += [(seq, m, *parts) for m in marks]
    return out


def _number(c: Column) -> Column:
    """The first number of a text, commas left out; null without one or beyond 32 bits."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), "([0-9]{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def _small(c: Column) -> Column:
    n = _number(c)
    return F.when(n < 2**31, n.cast("int"))


def weekly_chart(pages: DataFrame) -> DataFrame:
    """Positions 1 to 100 of a weekly chart page: of the candidates for a position that are complete, that with the surest mark,
    the first on the page."""
    rows = read_pages(pages, of_tree(_candidates), CANDIDATES)
    shown = F.get(F.filter("places", lambda x: F.trim(x) != ""), F.lit(0))
    credit = F.get(F.filter("artists", lambda x: F.length(F.trim(x)).between(1, 199)), F.lit(0))
    bare = lambda c: F.trim(F.regexp_replace(text.collapse(c), FRESH, ""))
    rows = rows.select("url", "seq", "mark", _small(shown).alias("position"), text.title_case(bare(F.col("title"))).alias("song"), bare(credit).alias("artist"), _small(F.col("peak")).alias("peak_position"), _small(F.col("weeks")).alias("weeks_on_chart"))
    # Some pages repeat the title before the credit.
    repeated = F.upper(F.col("artist")).startswith(F.upper(F.col("song")))
    rows = rows.withColumn("artist", F.when(repeated, F.trim(F.substr("artist", F.length("song") + 1))).otherwise(F.col("artist")))
    whole = rows.where("position between 1 and 100 and song <> '' and artist <> ''")
    best = Window.partitionBy("url", "position").orderBy("mark", "seq")
    found = whole.withColumn("n", F.row_number().over(best)).where("n = 1")
    return found.select("url", (F.col("position") - 1).alias("seq"), "position", "song", "artist", "peak_position", "weeks_on_chart")


def discover_all(chart_pages: DataFrame, listener_pages: DataFrame) -> DataFrame:
    """Rows for ``jobs.merge_discovered`` from all chart pages, then all listener pages: an appearance for each chart page, none
    for a listener page. Pages count in the order of their URLs."""
    charts = discovered_on_charts(chart_pages).select("url", "seq", "spotify_id", "name", F.lit(1).alias("appeared"))
    heard = listener_page(listener_pages).withColumn("appeared", F.lit(0))
    kinds = dict(heard.dtypes)
    missing = {c: F.lit(None).cast(kinds[c]) for c in ("monthly_listeners", "daily_change", "peak_rank", "peak_listeners")}
    both = charts.withColumns(missing).withColumn("part", F.lit(0)).unionByName(heard.withColumn("part", F.lit(1)))
    return both.withColumn("seq", F.struct("part", "url", "seq")).drop("part", "url")
