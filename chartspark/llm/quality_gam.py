"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles. Boosting goes round the features, one shallow tree
(up to three leaves over the feature's bins) at a time with a small step, and adds the trees up in
one lookup table a feature; then the pairs of features that explain most of what is left get
two-dimensional tables in the same way. A score is the logistic of the sum of one table entry for
each feature and pair: vectorised bin additions.

Features come from the whole text, and from nothing but the text. The model is fitted on at most
``SAMPLE`` labelled rows, those with the smallest hash of their id; all else covers all rows. The
model is a few thousand numbers in the task's closure; scoring needs no shuffle.

Defined results: a null text is an empty text; rows without a label in {0, 1} are not learnt from;
a document with several labels is learnt from with each; without labels of both kinds the score is
the share of label 1, or 0.5 without any; rows with one doc_id are scored row by row, and each of
them is learnt from with the labels of the doc_id, up to ``SAMPLE`` rows in all; equal rows have
equal scores; an empty table of documents gives an empty table; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.words import Hasher, mix, raw, rows_of, slices

SAMPLE = 20_000
FEATURES = (
    "bytes", "upper", "digit", "punctuation", "exclaim", "bar", "symbol", "stop", "comma", "newline",
    "beyond_ascii", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_lines", "marked_words",
)


def _byte_classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    of = lambda s: np.isin(b, list(s.encode()))
    letters = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit = (b >= 48) & (b <= 57)
    return {
        "upper": (b >= 65) & (b <= 90), "lower": (b >= 97) & (b <= 122), "digit": digit, "punctuation": (b > 32) & (b < 127) & ~letters & ~digit,
        "exclaim": of("!?"), "bar": of("|"), "symbol": of("#$%&*+=<>@^_~\\/{}[]"), "stop": of("."), "comma": of(",;:"), "newline": of("\n"), "beyond_ascii": (b & 0xC0) == 0xC0,
    }


def features(column: pa.Array, hasher: Hasher) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    base = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    count = {k: per_row(m[base]) for k, m in _byte_classes().items()}
    words, w = hasher(column)
    n_words = np.diff(w)
    row = rows_of(w)
    order = np.lexsort((words, row))
    ordered, ordered_row = words[order], row[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]) | (ordered_row[1:] != ordered_row[:-1])] if len(words) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    run = np.diff(np.r_[begin, len(words)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, ordered_row[begin], run)
    distinct = np.bincount(ordered_row[begin], minlength=n)
    again = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
    # Lines: a hash of each from prefix sums of a byte hash.
    ends = np.flatnonzero(base == 10)
    stops = np.unique(np.concatenate([ends, at[1:][size > 0] - 1])) if len(base) else np.zeros(0, np.int64)
    starts = np.r_[0, stops[:-1] + 1] if len(stops) else stops
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(base.astype(np.uint64), 1) >> np.uint64(20), dtype=np.uint64)])
    line = (sums[stops + 1] - sums[starts]) if len(stops) else np.zeros(0, np.uint64)
    line_row = np.searchsorted(at, starts, "right") - 1
    order = np.lexsort((line, line_row))
    lines = np.bincount(line_row, minlength=n)
    fresh = np.r_[True, (line[order][1:] != line[order][:-1]) | (line_row[order][1:] != line_row[order][:-1])] if len(line) else np.zeros(0, bool)
    distinct_lines = np.bincount(line_row[order][fresh], minlength=n)
    # Words that end with a mark other than . , ; :
    odd = _byte_classes()
    last = np.r_[base[1:] <= 32, True] if len(base) else np.zeros(0, bool)
    last[at[1:][size > 0] - 1] = True
    marked = per_row((odd["punctuation"] & ~odd["stop"] & ~odd["comma"])[base] & last)
    text = np.maximum(size, 1)
    cols = [
        np.log1p(size), share(count["upper"], count["upper"] + count["lower"]), *(count[k] / text for k in ("digit", "punctuation", "exclaim", "bar", "symbol", "stop", "comma", "newline", "beyond_ascii")),
        share(size, n_words), share(distinct, n_words) * np.log1p(n_words), share(top, n_words), share(again, n_words), share(distinct_lines, lines), share(marked, n_words),
    ]
    # Rounded, as the last bit of a logarithm may depend on the place of a row in its batch.
    return np.column_stack(cols).astype(float).round(9)


class Gam:
    """Lookup tables for features and pairs of features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.1) -> None:
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.rate = bins, pair_bins, rounds, pairs, rate
        self.base, self.cuts, self.tables, self.pairs = 0.0, [], [], []

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n, k = x.shape if x.size else (0, len(FEATURES))
        share = (y.sum() + 1) / (n + 2) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [self._cuts(x[:, j], self.bins) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        if n == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        raw_score = np.full(n, self.base)
        for _ in range(self.rounds):
            for j in range(k):
                g, h = self._gradient(raw_score, y)
                step = self._tree(np.bincount(at[j], g, len(self.tables[j])), np.bincount(at[j], h, len(self.tables[j])))
                self.tables[j] += step
                raw_score += step[at[j]]
        coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(k)]
        low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
        g, h = self._gradient(raw_score, y)
        gain = []
        for a in range(k):
            for b in range(a):
                cell = low[a] * (len(coarse[b]) + 1) + low[b]
                gain.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + 5)).sum()), a, b))
        chosen = sorted(gain, reverse=True)[: self.n_pairs]
        self.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in chosen]
        for _ in range(self.rounds // 2):
            for a, b, ca, cb, table in self.pairs:
                g, h = self._gradient(raw_score, y)
                cell = low[a] * table.shape[1] + low[b]
                step = self._tree2(np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape))
                table += step
                raw_score += step[low[a], low[b]]
        return self

    @staticmethod
    def _gradient(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def _leaf(self, g: float, h: float) -> float:
        return self.rate * g / (h + 1)

    @staticmethod
    def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The best gain of one cut, and the number of bins left of it."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
        i = int(gain.argmax())
        return float(gain[i]), i + 1

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g))
        _, cut = self._split(g, h)
        parts = [(0, cut), (cut, len(g))] if cut else [(0, len(g))]
        best = max(((self._split(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda s: s[0][0])
        if best[0][1]:
            parts.remove((best[1], best[2]))
            parts += [(best[1], best[1] + best[0][1]), (best[1] + best[0][1], best[2])]
        for a, b in parts:
            out[a:b] = self._leaf(g[a:b].sum(), h[a:b].sum())
        return out

    def _tree2(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One cut on the axis that gains more, then one on the other axis in each half."""
        if self._split(g.sum(1), h.sum(1))[0] < self._split(g.sum(0), h.sum(0))[0]:
            return self._tree2_rows(g.T, h.T).T
        return self._tree2_rows(g, h)

    def _tree2_rows(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(g.shape)
        _, cut = self._split(g.sum(1), h.sum(1))
        for a, b in ((0, cut), (cut, len(g))):
            if a == b:
                continue
            _, c = self._split(g[a:b].sum(0), h[a:b].sum(0))
            for x, z in ((0, c), (c, g.shape[1])):
                out[a:b, x:z] = self._leaf(g[a:b, x:z].sum(), h[a:b, x:z].sum())
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, ca, cb, table in self.pairs:
            total += table[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def is_held_out() -> F.Column:
    """Whether crc32 of the doc_id as text leaves no remainder by 5; a null doc_id does not count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """A model of ``label``, from labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", F.col(label).cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"), hasher)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *map(pa.array, x.T)], names=["doc_id", "y", *FEATURES])

    # At most ``sample`` rows of two numbers: a bounded broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, y double, " + ", ".join(f"{f} double" for f in FEATURES))
    # A repeated doc_id gives more rows than were picked; the driver gets ``sample`` rows of numbers at most.
    order = ["doc_id", "y", *FEATURES]
    got = found.orderBy(F.xxhash64("doc_id"), *order).limit(sample).toPandas().sort_values(order)
    return Gam().fit(got[list(FEATURES)].to_numpy(), got["y"].to_numpy())


def scored(documents: DataFrame, model: Gam) -> DataFrame:
    """``carried`` (a row of ``documents``, whatever its columns are called) and ``score``."""
    schema = f"carried {documents.select(F.struct('*').alias('c')).schema[0].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(features(part.column("text"), hasher))
                yield pa.RecordBatch.from_arrays([part.column("carried"), pa.array(score)], names=["carried", "score"])

    return documents.select("text", F.struct("*").alias("carried")).mapInArrow(run, schema)
