"""Members of prefix blocks against all pairs in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chartspark.llm import jaccard_join as jj


def rows_of_sets(seed):
    """Sets of shingles, near copies among them, and their rows sorted by token and node."""
    rnd = random.Random(seed)
    common = [rnd.getrandbits(63) for _ in range(150)]
    sets = []
    for _ in range(60):
        s = {rnd.getrandbits(63) for _ in range(rnd.randrange(0, 60))} | set(rnd.sample(common, rnd.randrange(1, 40)))
        sets += [s, set(sorted(s)[rnd.randrange(3) :]), s | {rnd.getrandbits(63) for _ in range(rnd.randrange(1, 12))}]
    rows = []
    for node, s in enumerate(sets):
        ordered = np.sort(np.array(list(s), np.uint64))
        rows += [(int(t), node, len(s)) for t in jj._placed(ordered[: jj.prefix_size(len(s), 75)])] if s else []
    return sets, sorted(rows)


@pytest.mark.parametrize("seed,batch", [(1, 10**6), (2, 10**6), (3, 40), (4, 1)])
def test_blocks_keep_all_that_link_and_drop_what_cannot(seed, batch):
    sets, rows = rows_of_sets(seed)
    batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + batch], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["token", "node", "n"]) for i in range(0, len(rows), batch))
    blocks = {}
    for b in jj._members(batches, 75):
        for r in b.to_pylist():
            blocks.setdefault(r["token"], []).append(r["node"])
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(linked) > 30
    assert all(any(i in m and j in m for m in blocks.values()) for i, j in linked)
    if batch < 10**6:
        return
    at = {(t >> jj.PLACE, node): t & ((1 << jj.PLACE) - 1) for t, node, _ in rows}
    every = {}
    for t, node in at:
        every.setdefault(t, []).append(node)

    def fits(t, i, j):
        x, y = len(sets[i]), len(sets[j])
        return 175 * min(x - at[t, i], y - at[t, j]) >= 75 * (x + y)

    want = {t: {i for i in m if any(i != j and fits(t, i, j) for j in m)} for t, m in every.items()}
    inner = sorted(want)[1:-1]
    assert {t: set(blocks[t]) for t in inner if t in blocks} == {t: want[t] for t in inner if want[t]}
    assert sum(map(len, blocks.values())) < 0.8 * sum(len(m) for m in every.values() if len(m) > 1)
