"""URL filter: one bit-parallel automaton runs every glob rule over each canonical URL.

All rules are packed, one bit per literal byte, into 64-bit words (multiword Shift-And). ``*`` is
a self-loop on the bit before it; in the host part it does not cross ``/``. A block of URLs
advances one byte at a time in numpy, so the cost is (bytes x mask words), whatever the number of
rules in a word. No shuffle and no join: the masks are a few hundred bytes in the task's closure.

Defined results: a null URL, or one without ``://``, has an empty host and path and matches no
rule; bytes above 0x7F match only ``*``; repeated rows are judged alike; other columns are not read;
an empty table gives an empty table; a URL of any length is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.words import raw

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is a host suffix and a path prefix, like ``net/de/``."""

    verdict: str
    name: str

    @property
    def glob(self) -> str:
        return f"*.{self.name}*"


#: The rules of the query.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


class ShiftAnd:
    """Simulates all globs at once; ``match`` gives a boolean per text and glob."""

    def __init__(self, globs: Sequence[str]) -> None:
        bits: list[tuple[int | None, int]] = []  # (literal byte or None for the start, loop: 0 none, 1 within the host, 2 any)
        self.last: list[int] = []
        first: list[int] = []
        for glob in globs:
            first.append(len(bits))
            bits.append((None, 0))
            in_host = True
            for byte in glob.encode():
                if byte == ord("*"):
                    bits[-1] = (bits[-1][0], 1 if in_host else 2)
                    continue
                in_host &= byte != ord("/")
                bits.append((byte, 0))
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.step, self.loop = np.zeros((2, 256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (byte, loop) in enumerate(bits):
            at, bit = i // 64, np.uint64(1 << (i % 64))
            if byte is not None:
                self.step[byte, at] |= bit
            if loop:
                self.loop[:, at] |= bit
            if loop == 1:
                self.loop[ord("/"), at] &= ~bit
        for i in first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def match(self, column: pa.Array) -> np.ndarray:
        data, offsets = raw(column)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        live = int(np.count_nonzero(size > 0))
        at = 0
        while live:
            byte = data[begin[:live] + at]
            d = state[:live]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.step[byte]) | (d & self.loop[byte])
            at += 1
            live = int(np.searchsorted(-size[:live], -at, "left"))
        hit = np.zeros((len(order), len(self.last)), bool)
        for k, i in enumerate(self.last):
            hit[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        return hit


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, key: str, url: str = "url", rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row: the longest rule that fits, else ``default``."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    automaton = ShiftAnd([r.glob for r in ranked])
    names, verdicts = [r.name for r in ranked] + [None], [r.verdict for r in ranked] + [default]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, verdict = pa.array(names, pa.string()), pa.array(verdicts, pa.string())
        for b in batches:
            hit = automaton.match(b.column("canonical"))
            best = pa.array(np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("host"), b.column("path"), name.take(best), verdict.take(best)], names=[key, "host", "path", "rule", "verdict"])

    found = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = found.withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    kind = dict(found.dtypes)[key]
    return found.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
