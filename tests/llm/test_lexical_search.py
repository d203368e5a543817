import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chartspark.llm import lexical_search
from chartspark.llm.wavelet import Best, Tree, build_bits, levels_of


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    rows = [(d, Counter(terms(t))) for d, t in docs]
    rows = [(d, c, c.total()) for d, c in rows if c]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in rows:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, "t", 2.0) for r in rows], f"{schema}, rank int, terms string, score double")


@pytest.mark.parametrize(("k", "shard", "block"), [(20, 8 << 20, 2048), (3, 500, 2), (200, 2000, 2048)])
def test_search_equals_brute_force_on_awkward_rows(spark, monkeypatch, k, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    rnd = random.Random(k)
    word = lambda: rnd.choice(["The", "of", "Été", "ruby", "9", "x_y", "ÉTÉ", "wörter"]) + str(int(rnd.paretovariate(0.7)))[:4]
    docs = [(None, "the1 of1 ruby1"), (1, None), (2, ""), (3, " \n- "), (4, "the1"), (4, "the1"), (5, "the1 " * 30_000), (6, "\u0000the1\u007fof2`ruby1é€𝄞")]
    docs += [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(7, 250)]
    docs += [(i, docs[40][1]) for i in range(300, 420)]  # ties
    items = [(1, "The1 of1 the1 ruby2"), (2, None), (3, ""), (4, "nowhere at all"), (5, docs[40][1]), (6, docs[6][1]), (None, "été1"), (7, " ".join(word() for _ in range(400)))]
    found = lexical_search.top_documents(table(spark, docs, "doc_id int, text string").repartition(6), table(spark, items, "item_id int, text string"), k)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "y z"), (2, "w")], "doc_id long, text string")
    assert lexical_search.top_documents(none, items).count() == 0
    assert lexical_search.top_documents(docs, items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.top_documents(docs, items).collect()] == [("a", 1, 1)]


def test_tree_keeps_lists_by_impact_in_every_node():
    rnd = np.random.default_rng(5)
    n_docs, n_lists = 37, 6
    lists = [np.sort(rnd.choice(n_docs, rnd.integers(1, n_docs), replace=False)) for _ in range(n_lists)]
    impacts = [rnd.integers(1, 9, len(x)) for x in lists]
    order = [np.lexsort((d, -i)) for d, i in zip(lists, impacts, strict=True)]
    sequence = np.concatenate([d[o] for d, o in zip(lists, order, strict=True)])
    by_impact = np.concatenate([i[o] for i, o in zip(impacts, order, strict=True)])
    starts = np.cumsum([0, *map(len, lists)])
    tree = Tree(np.arange(n_docs) * 3, starts, by_impact, build_bits(sequence, levels_of(n_docs)))
    weights = np.array([5, 0, 2, 7, 1, 3])
    total = np.zeros(n_docs, np.int64)
    for d, i, w in zip(lists, impacts, weights, strict=True):
        total[d] += w * i
    want = sorted(((-s, 3 * d) for d, s in enumerate(total.tolist()) if s > 0))
    for k in (1, 4, 50):
        best = Best(k)
        tree.search(np.arange(n_lists), weights, best, batch=3)
        assert sorted((-s, -d) for s, d in best.rows) == want[:k]
        again = Best(k, (-want[min(k, len(want)) - 1][0], want[min(k, len(want)) - 1][1]))
        tree.search(np.arange(n_lists), weights, again)
        assert sorted(again.rows) == sorted(best.rows)
