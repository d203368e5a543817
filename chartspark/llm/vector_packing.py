"""Vector bin packing of tokenised texts with the dot-product heuristic.

Each sequence has limits on tokens, on segments and on loss-bearing tokens. Of the pieces that
wait (at most WAITING), the one whose demand has the greatest dot product with what the sequence
still has free, both as shares of the limits, goes in, as long as one fits; then a piece is cut to
fill the rest. What is left at the end of a task is cut into sequences whose lengths are powers of
two. So only the limits on segments and loss can leave padding.

Every task packs the rows that it reads: no shuffle, and memory for WAITING texts. A sequence id
is the task's partition number times 2**32 plus a count, so a task that runs again gives the same
rows.

Defined results: a null text is empty; an empty text is the end id alone; rows with one doc_id are
packed row by row, equal ones too; a text of any length is cut; a doc_id of any simple type, or
null, is returned as it is; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

WAITING = 128
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Places (key, ids as bytes, bytes an id) texts; gives rows as FIELDS."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int = 0, loss: Callable[[int, int], int] | None = None) -> None:
        self.limits = np.array(limits, float)
        self.loss = loss or (lambda start, length: length)
        self.sequence = first_sequence
        self.items: list[list] = []  # key, ids, start, end
        self.need = np.zeros((WAITING + 1, 3))

    def add(self, key: object, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        most = int(self.limits[0])
        while total - start >= most and self.loss(start, most) <= self.limits[2]:
            yield self._row(key, ids, start, most, 0)
            self.sequence += 1
            start += most
        if start == total:
            return
        self._set(len(self.items), [key, ids, start, total])
        if len(self.items) > WAITING:
            yield from self._fill(most)

    def finish(self) -> Iterator[tuple]:
        while self.items:
            waiting = sum(i[3] - i[2] for i in self.items)
            yield from self._fill(min(int(self.limits[0]), 1 << (waiting.bit_length() - 1)))

    def _set(self, at: int, item: list) -> None:
        if at == len(self.items):
            self.items.append(item)
        self.items[at] = item
        size = item[3] - item[2]
        self.need[at] = size, 1, self.loss(item[2], size)

    def _drop(self, at: int) -> None:
        last = self.items.pop()
        if at < len(self.items):
            self.items[at] = last
            self.need[at] = self.need[len(self.items)]

    def _row(self, key: object, ids: bytes, start: int, length: int, offset: int) -> tuple:
        return key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, self.sequence, offset

    def _fill(self, size: int) -> Iterator[tuple]:
        """One sequence of at most ``size`` tokens."""
        free = self.limits.copy()
        free[0] = size
        while self.items and free.min() > 0:
            need = self.need[: len(self.items)]
            fits = (need <= free).all(axis=1)
            if fits.any():
                value = need @ (free / self.limits**2)
                value[~fits] = -1
                at = int(value.argmax())
                key, ids, start, end = self.items[at]
                take = end - start
            else:
                at = int(need[:, 0].argmax())
                key, ids, start, end = self.items[at]
                take = min(int(free[0]), end - start)
                while take and self.loss(start, take) > free[2]:
                    take -= max(1, int(self.loss(start, take) - free[2]))
                if take <= 0:
                    break
            yield self._row(key, ids, start, take, size - int(free[0]))
            free -= (take, 1, self.loss(start, take))
            if start + take == end:
                self._drop(at)
            else:
                self._set(at, [key, ids, start + take, end])
        self.sequence += 1


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], limits: tuple[int, int, int], end_id: int = 0) -> DataFrame:
    """Pieces of the texts of ``docs`` (doc_id, text), as FIELDS. ``encoder`` makes, in each task, a function from texts to ids (little-endian unsigned 32-bit)."""
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode, rows = Packer(limits, TaskContext.get().partitionId() << 32), encoder(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for key, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    rows += packer.add(key, ids + end)
                if len(rows) > 4096:
                    yield _batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=list(FIELDS))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} long" for f in FIELDS[1:]))
