"""A dual-sorted wavelet tree: the posting lists of a shard, each ordered by impact and navigable by document.

The lists of all terms stand one after another, each from its highest impact down, as one sequence of local document
numbers. A level of the tree holds a bit of every number, from the highest bit down, and sorts the sequence by it, stably: so
the part of a list that falls in a node (a range of documents) is one interval of the level, still from the highest impact
down. The impact at the start of the interval bounds the term's share in the score of every document of the node.
"""

from __future__ import annotations

import heapq

import numpy as np

#: The id of a row without one: it counts, and is never returned.
NO_ID = np.iinfo(np.int64).min


def levels_of(n_docs: int) -> int:
    return max(1, int(n_docs - 1).bit_length())


def build_bits(sequence: np.ndarray, levels: int) -> bytes:
    """The bits of each level, packed, from the root down."""
    out = []
    for shift in range(levels - 1, -1, -1):
        bit = (sequence >> shift) & 1
        out.append(np.packbits(bit.astype(bool)).tobytes())
        sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
    return b"".join(out)


class Tree:
    """A loaded tree. ``docs`` are ids by local number, ascending; ``starts`` are the lists' places in the sequence."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, impacts: np.ndarray, bits: bytes) -> None:
        n, self.levels = len(impacts), levels_of(len(docs))
        self.docs, self.starts, self.n = docs, starts, n
        self.ones = np.zeros((self.levels, n + 1), np.int32)  # of each level, before each place
        self.impact = np.empty((self.levels + 1, n), np.int32)
        self.impact[0] = impacts
        step = -(-n // 8)
        for i in range(self.levels):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, step, i * step), count=n).astype(bool)
            np.cumsum(bit, out=self.ones[i, 1:])
            self.impact[i + 1] = np.concatenate([self.impact[i][~bit], self.impact[i][bit]])
        self.zeros = n - self.ones[:, n].astype(np.int64)
        self.ones, self.impact = self.ones.ravel(), self.impact.ravel()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, batch: int = 32) -> None:
        """Offer to ``best`` the documents with the highest sums of weight times impact over the lists ``terms``.

        Nodes wait in a heap by their bound. The best ones are taken, ``batch`` at a time, and every list in them is split
        over their two children; a leaf's bound is its document's score. It ends when no bound is as good as the kth score.
        """
        l, r = self.starts[terms], self.starts[terms + 1]
        if not len(terms):
            return
        # (-bound, first id, number, level, prefix, list, from, to)
        bound = int((weights * self.impact[l]).sum())
        heap = [(-bound, int(self.docs[0]), 0, 0, 0, np.arange(len(terms)), l, r)]
        number = 1
        while heap and best.wants(-heap[0][0], heap[0][1]):
            nodes = [heapq.heappop(heap)]
            while heap and len(nodes) < batch and best.wants(-heap[0][0], heap[0][1]):
                nodes.append(heapq.heappop(heap))
            size = [len(x[5]) for x in nodes]
            lists, l, r = (np.concatenate([x[i] for x in nodes]) for i in (5, 6, 7))
            level = np.repeat([x[3] for x in nodes], size)
            node = np.repeat(np.arange(len(nodes)), size)
            row = level * (self.n + 1)
            before, upto = self.ones[row + l].astype(np.int64), self.ones[row + r].astype(np.int64)
            right = self.zeros[level]
            for side, low, high in ((0, l - before, r - upto), (1, right + before, right + upto)):
                there = high > low
                low, high, own, kind = low[there], high[there], node[there], lists[there]
                if not len(own):
                    continue
                share = weights[kind] * self.impact[(level[there] + 1) * self.n + low]
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                ends = np.r_[cut[1:], len(own)]
                for bound, i, a, b in zip(np.add.reduceat(share, cut).tolist(), own[cut].tolist(), cut.tolist(), ends.tolist(), strict=True):
                    depth, prefix = nodes[i][3] + 1, 2 * nodes[i][4] + side
                    first = int(self.docs[prefix << (self.levels - depth)])
                    if depth == self.levels:
                        best.offer(bound, first)
                    elif best.wants(bound, first):
                        heapq.heappush(heap, (-bound, first, number, depth, prefix, kind[a:b], low[a:b], high[a:b]))
                        number += 1


class Best:
    """The ``k`` best (score, id) so far, ties to the smaller id; ``floor`` is a (score, id) that the kth reaches at least."""

    def __init__(self, k: int, floor: tuple[int, int] | None = None) -> None:
        self.k, self.rows = k, []
        self.floor = (floor[0], -floor[1]) if floor else (1, -np.iinfo(np.int64).max)

    def wants(self, score: int, first: int) -> bool:
        """Whether a score, of ids of ``first`` and above, could be among the best."""
        return (score, -first) >= self.floor

    def offer(self, score: int, doc: int) -> None:
        if doc == NO_ID or not self.wants(score, doc):
            return
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, (score, -doc))
        else:
            heapq.heappushpop(self.rows, (score, -doc))
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[0])
