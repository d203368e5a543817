"""Signature trees: nodes hold OR-combined token bitmaps and size ranges.

``Block.spanning`` gives, for the sets of one block, pairs that are enough to connect all that may
be connected: a dual traversal of the tree with itself drops each pair of nodes whose largest
possible overlap is below what the threshold asks of their least sizes, or that lie in one
component already.

For sets x and y with bitmaps b of one width, each shared element sets a bit in both, so
|x & y| <= popcount(bx & by) + min(|x| - popcount(bx), |y| - popcount(by)); the same holds for
nodes with OR-combined bitmaps and the largest |x| - popcount(bx) below them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from chartspark.llm.words import U, mix

FAN = 8
#: 64-bit words of bitmaps that one step compares.
STEP_WORDS = 1 << 21
PIVOTS = 3
#: Bits of a wide bitmap for one of a narrow one.
WIDE = 16


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n elements: a power of two, twice to four times n."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    at = mix(tokens, 91) & U(width - 1)
    bits = np.zeros(width, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) at a smaller width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(bits) > FAN:
            begin = np.arange(0, len(bits), FAN)
            bits = np.bitwise_or.reduceat(bits, begin, axis=0)
            _, low, high, spare = self.levels[-1]
            low, high, spare = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin), np.maximum.reduceat(spare, begin)
            self.levels.append((bits, low, high, spare))


def needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (x + y) // (100 + percent))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    (bits_a, low_a, high_a, spare_a), (bits_b, low_b, high_b, spare_b) = a, b
    fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    i, j = i[fits], j[fits]
    most = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare_a[i], spare_b[j])
    fits[fits] = np.minimum(most, np.minimum(high_a[i], high_b[j])) >= needed(low_a[i], low_b[j], percent)
    return fits


class _Union:
    def __init__(self, labels: np.ndarray) -> None:
        self.label, self.joined = labels.copy(), 0

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.joined += 1
        self.label[self.label == max(a, b)] = min(a, b)
        return True

    def gather(self, i: int, labels: np.ndarray) -> None:
        """Join the components ``labels`` with that of ``i``."""
        every = np.append(labels, self.label[i])
        self.joined += 1
        self.label[np.isin(self.label, every)] = every.min()


def _span(labels: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [(labels, labels)]
    for _ in range(levels - 1):
        low, high = out[-1]
        begin = np.arange(0, len(low), FAN)
        out.append((np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)))
    return out


def _children(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(FAN)
    i = np.repeat(i[:, None] * FAN + k, FAN, axis=1).ravel()
    j = np.tile(j[:, None] * FAN + k, (1, FAN)).ravel()
    ok = (i < n_a) & (j < n_b)
    return i[ok], j[ok]


def _traverse(ta: Tree, tb: Tree, rows_a: np.ndarray, rows_b: np.ndarray, same: bool, union: _Union, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of leaf pairs that may link, of sets in different components by then."""
    depth = min(len(ta.levels), len(tb.levels)) - 1
    most = max(1024, STEP_WORDS // ta.levels[0][0].shape[1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(ta.levels[depth][0])), np.arange(len(tb.levels[depth][0])), indexing="ij"))
    stack, spans_a, spans_b, seen = [(depth, i, j)], [], [], -1
    while stack:
        level, i, j = stack.pop()
        if len(i) > most:
            stack.append((level, i[most:], j[most:]))
            i, j = i[:most], j[:most]
        if same:
            keep = i <= j if level else i < j
            i, j = i[keep], j[keep]
        if seen != union.joined:
            seen = union.joined
            spans_a = _span(union.label[rows_a], depth + 1)
            spans_b = spans_a if same else _span(union.label[rows_b], depth + 1)
        (low_a, high_a), (low_b, high_b) = spans_a[level], spans_b[level]
        keep = (low_a[i] != high_a[i]) | (low_b[j] != high_b[j]) | (low_a[i] != low_b[j])
        i, j = i[keep], j[keep]
        keep = _possible(ta.levels[level], tb.levels[level], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level:
            stack.append((level - 1, *_children(i, j, len(ta.levels[level - 1][0]), len(tb.levels[level - 1][0]))))
        else:
            yield rows_a[i], rows_b[j]


class Block:
    """The sets of one block: bitmaps of any widths, sizes, and the components known so far. ``names`` (integers) choose pivots."""

    def __init__(self, bitmaps: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int = 75, names: np.ndarray | None = None) -> None:
        self.union, self.percent = _Union(labels), percent
        self.rank = mix((np.arange(len(sizes)) if names is None else names).astype(np.int64).view(U), 95)
        width = np.array([len(b) for b in bitmaps])
        order = np.argsort(sizes, kind="stable")
        self.trees: dict[int, tuple[Tree, np.ndarray]] = {}
        self.crossed: list[tuple[Tree, Tree, np.ndarray, np.ndarray]] = []
        for w in np.unique(width).tolist():
            rows = order[width[order] == w]
            self.trees[w] = Tree(np.stack([bitmaps[r] for r in rows]), sizes[rows]), rows
        for w, (tree, rows) in self.trees.items():
            if 2 * w in self.trees:
                wide, above = self.trees[2 * w]
                self.crossed.append((tree, Tree(folded(wide.levels[0][0], w), sizes[above]), rows, above))

    def _pivots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The members of least rank against all: in a group of near copies this connects most at once, and blocks of
        one group have the same pivots, so together they give about as many pairs as the group has members."""
        for tree, rows in self.trees.values():
            for pivot in np.argsort(self.rank[rows])[:PIVOTS].tolist():
                j = np.flatnonzero(self.union.label[rows] != self.union.label[rows[pivot]])
                j = j[_possible(tree.levels[0], tree.levels[0], np.full(len(j), pivot), j, self.percent)]
                yield np.full(len(j), rows[pivot]), rows[j]

    def _all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tree, rows in self.trees.values():
            yield from _traverse(tree, tree, rows, rows, True, self.union, self.percent)
        for a, b, rows_a, rows_b in self.crossed:
            yield from _traverse(a, b, rows_a, rows_b, False, self.union, self.percent)

    def spanning(self, check: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
        """Pairs that may link (or do, by ``check``) and connect what is not connected yet.

        Taking all of them as links, no other such pair joins two components.
        """
        out = []
        label, join = self.union.label, self.union.join
        for pairs in (self._pivots(), self._all()):
            for a, b in pairs:
                if check is None and len(a) and (a == a[0]).all():
                    _, first = np.unique(label[b], return_index=True)
                    out += [(int(a[0]), int(j)) for j in b[first]]
                    self.union.gather(int(a[0]), label[b[first]])
                    continue
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if label[i] != label[j] and (check is None or check(i, j)):
                        join(i, j)
                        out.append((i, j))
        return out
