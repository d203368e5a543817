import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chartspark.llm import importance_resampling as ir


def grams(text, n):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    return len(w), [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, seed, percent, min_words):
    of = lambda text: Counter(zlib.crc32(g) % buckets for g in grams(text, n)[1])
    rows = [(d, grams(t, n)[0], of(t)) for d, t in docs]
    s, t = sum((c for _, _, c in rows), Counter()), sum((of(x) for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, words, c in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append([d, words, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    best = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(best[: len(best) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_crc32_of_spans():
    rnd = random.Random(3)
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 2, 63, 64, 65, 300, *(rnd.randrange(20) for _ in range(200))]]
    ends = np.cumsum([len(p) for p in parts])
    got = ir.crc32(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, ir.crc_table())
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_words_do_not_cross_rows():
    counter = ir.Counter(2, 1000)
    column = pa.array(["skip", "ab", "cd", None, "", "É-x_Y", "e", "x" * 100])[1:]
    n_words, pointers, buckets, counts = counter(column)
    assert n_words.tolist() == [1, 1, 0, 0, 3, 1, 1]
    for i, t in enumerate(["ab", "cd", "", "", "É x y", "e", "x" * 100]):
        want = Counter(zlib.crc32(g) % 1000 for g in grams(t, 2)[1])
        part = slice(pointers[i], pointers[i + 1])
        assert dict(zip(buckets[part].tolist(), counts[part].tolist(), strict=True)) == want


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 55, 1), (2, 7, 100, 0)])
def test_draw_equals_brute_force_on_awkward_rows(spark, n, buckets, percent, least):
    rnd = random.Random(n)
    rows = [(None, "a b " * 12), (0, None), (1, ""), (2, " \n\t- "), (3, "one"), (3, "one"), (4, " ".join(f"v{i % 997}" for i in range(60_000))), (5, "y" * 100_000), (6, "Ünï ünÏ A-B_c 9é€𝄞")]
    rows += [(i, " ".join(rnd.choice(["The", "of", "ruby", "wort", "été"]) + str(rnd.randrange(9)) for _ in range(rnd.randrange(1, 60)))) for i in range(7, 80)]
    rows += [(90, rows[20][1]), (91, rows[20][1])] * 2
    target = ["the1 of2 ruby3", None, "", "The1 été4 and 9é€𝄞"]
    docs = spark.createDataFrame([(d, t, 1, "k", 2.0) for d, t in rows], "doc_id long, text string, rank int, key string, score double").repartition(5)
    got = ir.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, "s", percent, least).collect()
    want = brute(rows, target, n, buckets, "s", percent, least)
    plain = [tuple(r) for r in got]
    # Rows that are equal in id and text may change places.
    assert sorted((r[:5] for r in plain), key=repr) == sorted((r[:5] for r in want), key=repr)
    assert sorted((r[5], r[4], r[0]) for r in plain if r[5]) == sorted((r[5], r[4], r[0]) for r in want if r[5])


def test_empty_tables_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([("a", "x y z"), ("b", "x x")], "doc_id string, text string")
    assert ir.resampled(none, some).count() == 0
    got = {r.doc_id: r for r in ir.resampled(some, none.select("text"), percent=100, min_words=1).collect()}
    assert {got["a"].rank, got["b"].rank} == {1, 2} and got["a"].n_features == 3


def test_small_blocks_give_the_same_matrix(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} t") for i in range(200)], "doc_id int, text string")
    want = sorted(map(tuple, ir.resampled(docs, docs, min_words=1).collect()), key=repr)
    monkeypatch.setattr(ir, "BLOCK", 64)
    assert sorted(map(tuple, ir.resampled(docs, docs, min_words=1).collect()), key=repr) == want
