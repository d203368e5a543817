"""A small element tree of an HTML page, or of one element after another, with the few searches that the page readers need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

#: Elements without an end tag, and the open elements that a new element of the same kind ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "div", "section", "article", "body", "select"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, test: Callable[[Node], bool] | str) -> list[Node]:
        if isinstance(test, str):
            tags = set(test.split(","))
            return [n for n in self.walk() if n.tag in tags]
        return [n for n in self.walk() if test(n)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack.extend(reversed(at.children))
        return "".join(out)


class _Builder(HTMLParser):
    """The tree of a page, or only the outermost elements that meet ``test`` inside of a ``within`` element (empty: anywhere),
    which are put among ``ended`` when they end; of all else only the open elements are kept."""

    def __init__(self, test: Callable[[Node], bool] | None = None, within: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.test, self.within = test, within
        self.at = 0 if test is None else -1  # the place of the element that is kept among the open ones
        self.ended: list[Node] = []

    def _add(self, node: Node, opens: bool) -> None:
        if self.at >= 0:
            self.open[-1].children.append(node)
        elif self.test(node) and (not self.within or any(n.tag == self.within for n in self.open)):
            self.at = len(self.open)
        self.open.append(node)
        if not opens:
            self._end(len(self.open) - 1)

    def _end(self, at: int) -> None:
        if self.test is not None and 0 <= at <= self.at:
            self.ended.append(self.open[self.at])
            self.at = -1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended = ENDS.get(tag, set())
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in SCOPE:
                break
            if self.open[at].tag in ended:
                self._end(at)
        self._add(Node(tag, {k: v or "" for k, v in attrs}), tag not in VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(Node(tag, {k: v or "" for k, v in attrs}), False)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._end(at)
                return

    def handle_data(self, data: str) -> None:
        if self.at >= 0:
            self.open[-1].children.append(data)

    def take(self, pieces: Iterable[str]) -> Iterator[None]:
        """Read a page in pieces, with a stop after each. What waits for its end (a comment, a script) is looked through again only
        when as much has come."""
        come: list[str] = []
        size = 0
        for piece in pieces:
            come.append(piece)
            size += len(piece)
            if size >= len(self.rawdata):
                self.feed("".join(come))
                come, size = [], 0
                yield
        self.feed("".join(come))
        self.close()
        self._end(1)
        yield


def parse(page: str | Iterable[str] | None) -> Node:
    """The tree of a page, given whole or in pieces."""
    builder = _Builder()
    for _ in builder.take([page] if isinstance(page, str) else page or ()):
        pass
    return builder.root


def elements(pieces: Iterable[str], test: Callable[[Node], bool], within: str = "") -> Iterator[Node]:
    """The elements of a page that meet ``test`` inside of a ``within`` element, in document order, each when the outermost of those
    around it has ended: a page of any length is read with one of them in memory."""
    builder = _Builder(test, within)
    for _ in builder.take(pieces):
        for node in builder.ended:
            yield node
            yield from node.find(test)
        builder.ended.clear()


def first_text(nodes: list[Node]) -> str:
    return nodes[0].text().strip() if nodes else ""
