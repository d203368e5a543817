"""HTML main text by site style trees.

Pages become trees of block elements. An element's style is its tag, its classes and the noise words
of its id and role; elements with the same chain of styles on pages of one host are merged into one
node of the host's style tree. What a block holds are its features: its sentences, weighted by their
words, and its links, weighted by the words in them. A feature on n of the m pages with its node has

    entropy      log n / log (m + 1), near 1 on a template and 0 where it is on one page only

and one on fewer than a square root of the pages counts as the page's own, with 0. Markup is a
feature too: ``article`` and its like is one of entropy 0, ``nav``, words such as ``comments`` in a
class, and a place outside of the page's main branch are ones of entropy 1, as every site has them
(``MARKS`` has their weights, in words of the block). The importance of a block is

    1 - the weighted mean entropy of its features

and blocks below KEPT go, so no kind of feature decides alone: repeated text goes from inside an
``article`` too, a class word removes text that is nowhere else only with a second sign, and a menu
goes by its links where no element names it. A page of which nothing would be left keeps the blocks of
its main branch, or those whose text is not on nearly all pages.

Feature statistics are partial sums by (host, node, feature); what is joined back to a page is its
host's list of repeated features, at most a square root of its pages for each feature of a page.

Defined results: null html is empty; a page without a URL has the empty host; broken markup is
read to its end (unclosed elements close with their parents, an unclosed comment, script or style
hides the rest); pages are judged row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.scratch import written
from chartspark.llm.url_filter import host_of

KEPT, LEAST, OWN = 0.55, 0.5, 0.1
#: Hosts whose lists a task keeps at hand.
HOSTS = 64
#: Weights of markup, in words of the block: a main branch, an element for other things, words for such things inside a
#: main branch and elsewhere (``STRONG`` words first), a place outside of the main branch of a page that has one (by 1 + 1/m
#: on a host of m pages: where nothing can be compared, such a place counts more).
MARKS = {"main": 1.0, "element": 2.0, "strong": (2.0, 1.0), "word": (1.5, 0.7), "outside": 0.6}
#: What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset("nav footer aside form head menu select dialog button search option fieldset".split())
MAIN = frozenset(("article", "main"))
NOISE_WORDS = frozenset("ad ads advert adverts advertisement adverting banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion reactions related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
STRONG = frozenset("ad ads advert adverts advertisement adverting comment comments cookie cookies consent disqus newsletter promo promoted reactions replies reply respond sponsored".split())
MAIN_WORDS = frozenset(("article", "content", "entry", "main", "post", "story"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


class Block:
    """Text of one block: ``path`` of its element, words in links, and what markup says: ``main`` (2: by element or role),
    ``word`` (2: strong) and ``noise`` (noise by words, by element)."""

    __slots__ = ("path", "text", "linked", "main", "word", "noise")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, main: int, word: int, noise: bool) -> None:
        self.path, self.text, self.linked, self.main, self.word, self.noise = path, text, linked, main, word, noise


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int, int, bool]] = [("", (), 0, 0, False)]  # tag, path, main, word, noise
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(stack[-1][1], text, linked, *stack[-1][2:]))
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        if in_link:
            linked += len(held[-1].split())
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "a":
            in_link = not m[1]
        if not tag:
            continue
        if tag in HIDDEN and not m[1]:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if m[1]:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        closes = CLOSES.get(tag, set())
        while stack[-1][0] == "p" or stack[-1][0] in closes:
            stack.pop()
        if tag in VOID:
            continue
        _, path, main, word, noise = stack[-1]
        names = {k.lower(): a or b or c for k, a, b, c in _CLASS.findall(m[3])}
        words = set(_LETTERS.findall(" ".join(names.values()).lower()))
        listed = words & NOISE_WORDS
        classes = _LETTERS.findall(names.get("class", "").lower())
        style = tag + "".join(f".{w}" for w in classes) + "".join(f"#{w}" for w in sorted(listed.difference(classes)))
        if tag in MAIN or names.get("role", "").lower() == "main":
            main, word = 2, 0
        elif tag not in ("html", "body"):
            word = max(word, 2 if listed & STRONG else int(bool(listed)))
            main = main or int("main" in words or bool(words & MAIN_WORDS) and tag in ("div", "section"))
        noise = noise or tag in NOISE or tag == "header" and not main
        stack.append((tag, (*path, style), main, word, noise))
    flush()
    return out


def _signed(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode()) - 2**63


def judged(page: str) -> list[Block]:
    """The blocks of a page. Words count for nothing where all of an ``article`` or ``main`` element has them."""
    found = blocks(page)
    inside = [b for b in found if b.main == 2 and not b.noise]
    if inside and all(b.word for b in inside):
        for b in inside:
            b.word = 0
    return found


LINK = _signed("a")


def features(b: Block) -> list[tuple[int, int]]:
    """(feature, weight) of a block: its sentences, and its links."""
    out = [(_signed(s), len(s.split())) for s in _SENTENCE.split(b.text)]
    return [*out, (LINK, b.linked)] if b.linked else out


def importance(b: Block, entropy: dict[tuple[int, int], float], main: bool, pages: int) -> float:
    node = _signed("/".join(b.path))
    own = features(b)
    words = sum(w for f, w in own if f != LINK)
    inside = bool(b.main)
    marks = MARKS["element"] if b.noise else 0.0
    if b.word:
        marks += MARKS["strong" if b.word > 1 else "word"][0 if inside else 1]
    if main and not inside:
        marks += MARKS["outside"] * (1 + 1 / pages)
    plain = MARKS["main"] if inside else 0.0
    kept = sum(w * (1 - entropy.get((node, f), 0.0)) for f, w in own) + plain * words
    return kept / (sum(w for _, w in own) + (plain + marks) * words)


def extract(page: str, entropy: dict[tuple[int, int], float], pages: int = 1) -> str:
    """The main text of a page. ``entropy`` has that of the (node, feature) of its host that repeat, ``pages`` is the host's number."""
    found = judged(page)
    main = any(b.main and not b.word and not b.noise for b in found)
    kept = [b for b in found if importance(b, entropy, main, pages) >= KEPT]
    if main and not any(b.main for b in kept):
        kept = [b for b in found if b.main and not b.word and not b.noise]
    elif not kept:
        plain = [b for b in found if not b.word and not b.noise]
        kept = [b for b in plain if importance(b, entropy, False, pages) >= OWN]
    return "\n".join(b.text for b in kept)


def host_lists(pages: DataFrame) -> DataFrame:
    """``host, pages, entropies`` (node, feature, entropy; of the repeated features) of each host. ``pages``: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    own = {(_signed("/".join(x.path)), f) for x in judged(page or "") for f, _ in features(x)}
                    rows += [(h, node, f, False) for node, f in own] + [(h, node, 0, True) for node in {n for n, _ in own}] + [(h, 0, 0, True)] * bool(own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["host", "node", "feature", "whole"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, node long, feature long, whole boolean")
    counts = written(seen.groupBy("host", "node", "feature", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or node = 0"), "features")
    of = counts.where("whole").select("host", "node", F.col("n").alias("m"))
    entropy = F.log("n") / F.log(F.col("m") + 1)
    often = counts.where("not whole").join(of, ["host", "node"]).select("host", "node", "feature", entropy.cast("float").alias("entropy")).where(F.col("entropy") >= LEAST)
    lists = often.groupBy("host").agg(F.collect_list(F.struct("node", "feature", "entropy")).alias("entropies"))
    return counts.where("node = 0").select("host", F.col("n").cast("int").alias("pages")).join(lists, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    lists = written(host_lists(rows), "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict, int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, texts = b.slice(at, 256), []
                column = part.column("entropies")
                for i, (h, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                    if h not in known:
                        if len(known) >= HOSTS:
                            known.clear()
                        known[h] = {(x["node"], x["feature"]): x["entropy"] for x in column[i].as_py() or ()}, part.column("pages")[i].as_py() or 1
                    texts.append(extract(page or "", *known[h]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(lists, "host", "left").select("page_id", "url", "html", "host", "pages", "entropies")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
