"""Operators without SQL, and the whole pipeline, against plain Python versions."""

import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_llm_queries import awkward, brute_contamination, brute_removed, brute_spans

from chartspark.llm import chat_format, passages, quality_gam, queries, style_tree, suffix_dedup, tokens, topk_search, url_filter, vector_packing


def plain_features(text):
    """The features of one text, counted character by character."""
    raw = (text or "").encode()
    words = raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    mark = lambda b: 32 < b < 127 and not chr(b).isalnum()
    of = lambda chars: sum(b in chars.encode() for b in raw) / max(len(raw), 1)
    lines = [sorted(x) for x in raw.splitlines(keepends=True)] if b"\r" not in raw else None
    if lines is None or any(c in raw for c in b"\x0b\x0c\x1c\x1d\x1e"):
        parts = raw.split(b"\n")
        lines = [sorted(x + b"\n") for x in parts[:-1]] + ([sorted(parts[-1])] if parts[-1] else [])
    n = max(len(words), 1)
    ends = sum(mark(b) and b not in b".,;:" and (i + 1 == len(raw) or raw[i + 1] <= 32) for i, b in enumerate(raw))
    return [
        float(np.log1p(len(raw))), upper / max(upper + lower, 1), of("0123456789"), sum(map(mark, raw)) / max(len(raw), 1), of("!?"), of("|"), of("#$%&*+=<>@^_~\\/{}[]"), of("."), of(",;:"), of("\n"),
        sum(b & 0xC0 == 0xC0 for b in raw) / max(len(raw), 1), len(raw) / n, len(set(words)) / n * float(np.log1p(len(words))), max(Counter(words).values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(map(tuple, lines))) / max(len(lines), 1), ends / n,
    ]


def plain_score(model, text):
    x = [round(v, 9) for v in plain_features(text)]
    total = model.base
    for value, cuts, table in zip(x, model.cuts, model.tables, strict=True):
        total += table[bisect.bisect_right(list(cuts), value)]
    for a, b, ca, cb, table in model.pairs:
        total += table[bisect.bisect_right(list(ca), x[a])][bisect.bisect_right(list(cb), x[b])]
    return 1 / (1 + math.exp(-total))


def plain_split(g, h):
    best, at = 0.0, 0
    for i in range(1, len(g)):
        gain = sum(g[:i]) ** 2 / (sum(h[:i]) + 1) + sum(g[i:]) ** 2 / (sum(h[i:]) + 1) - sum(g) ** 2 / (sum(h) + 1)
        if i == 1 or gain > best + 1e-12:
            best, at = gain, i
    return best, at


def plain_tables(xs, ys, rounds, rate, bins):
    """Cyclic boosting of trees of three leaves, by loops."""
    cuts = []
    for j in range(len(xs[0])):
        order = sorted(x[j] for x in xs)
        cuts.append(sorted({order[int((len(order) - 1) * (i / bins) + 1e-9)] for i in range(1, bins)}))
    tables = [[0.0] * (len(c) + 1) for c in cuts]
    share = (sum(ys) + 1) / (len(ys) + 2)
    scores = [math.log(share / (1 - share))] * len(ys)
    for _ in range(rounds):
        for j, c in enumerate(cuts):
            at = [bisect.bisect_right(c, x[j]) for x in xs]
            p = [1 / (1 + math.exp(-s)) for s in scores]
            g, h = [0.0] * (len(c) + 1), [0.0] * (len(c) + 1)
            for i, b in enumerate(at):
                g[b] += ys[i] - p[i]
                h[b] += p[i] * (1 - p[i])
            _, cut = plain_split(g, h)
            parts = [(0, cut), (cut, len(g))] if cut else [(0, len(g))]
            gains = [plain_split(g[a:b], h[a:b]) for a, b in parts]
            k = max(range(len(parts)), key=lambda i: gains[i][0])
            if gains[k][1]:
                a, b = parts.pop(k)
                parts += [(a, a + gains[k][1]), (a + gains[k][1], b)]
            for a, b in parts:
                step = rate * sum(g[a:b]) / (sum(h[a:b]) + 1)
                for i in range(a, b):
                    tables[j][i] += step
            scores = [s + 0 for s in scores]
            for i, b in enumerate(at):
                step = next(rate * sum(g[x:y]) / (sum(h[x:y]) + 1) for x, y in parts if x <= b < y)
                scores[i] += step
    return tables


AWKWARD = [None, "", " ", "a", "A a A", "x\ny\nx\n", "\n\n", "Été, été! ?|", "w1! w2? #tag 100% (ok)", "word " * 3000, "é" * 50]


def test_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{queries_dir}/documents.parquet").select("doc_id", "text").limit(150)
    model = quality_gam.train(spark.read.parquet(f"{queries_dir}/documents.parquet"), spark.read.parquet(f"{queries_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(1, "a"), (1, "a")]
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, score int, carried string").repartition(3)
    got = sorted((r.carried.doc_id, r.carried.text or "", r.score) for r in quality_gam.scored(df, model).collect())
    want = sorted((d, t or "", plain_score(model, t)) for d, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [(g[:2], w[2]) for g, w in zip(got, want, strict=True) if abs(g[2] - w[2]) > 1e-9] == []


def test_fit_against_plain_python():
    rnd = random.Random(3)
    xs = [[rnd.random(), rnd.choice([0.0, 1.0, 2.0]), 5.0] for _ in range(200)]
    ys = [int(x[0] + 0.3 * x[1] + 0.2 * rnd.random() > 0.8) for x in xs]
    model = quality_gam.Gam(bins=8, rounds=4, pairs=0, rate=0.1).fit(np.array(xs), np.array(ys, float))
    for own, plain in zip(model.tables, plain_tables(xs, ys, 4, 0.1, 8), strict=True):
        assert np.allclose(own, plain, atol=1e-9)


def test_fit_is_bounded_and_ignores_row_order(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} " * (i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    a, b = (quality_gam.train(d, labels, sample=20) for d in (docs, docs.repartition(7)))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_gam.scored(empty, quality_gam.train(empty, labels)).count() == 0


queries_dir = "/root/testdata/sf0.001"


def plain_entropies(pages):
    """(host, path, feature) -> entropy of the repeated features, by plain counting."""
    on, whole = Counter(), Counter()
    for url, html in pages:
        host = (re.search("://([^/?#]*)", url or "") or ["", ""])[1].lower()
        seen = set()
        for b in style_tree.judged(html or ""):
            for s in re.split(r"(?<=[.!?。！？])\s+", b.text):
                seen.add((host, "/".join(b.path), s))
            if b.linked:
                seen.add((host, "/".join(b.path), "a"))
        on.update(seen)
        whole.update({x[:2] for x in seen})
    out = {k: math.log(n) / math.log(whole[k[:2]] + 1) for k, n in on.items() if n > 1}
    return {k: v for k, v in out.items() if v >= style_tree.LEAST}


def site(rnd, n):
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Home", "News", "Sport"))
    pages = []
    for i in range(n):
        own = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
        links = "".join(f"<li><a>l{rnd.randrange(10**6)} l{rnd.randrange(10**6)}</a></li>" for _ in range(5))
        pages.append((f"http://S.org/{i}", f"<div class=m><ul>{menu}</ul></div><div class=x><ul>{links}</ul></div><div class=t><p>{own}. Read more here. Second {i}.</p></div><div class=b>All rights reserved.</div>"))
    return pages


def test_entropies_against_plain_counting(spark):
    rnd = random.Random(4)
    pages = site(rnd, 9) + [("http://t.org/1", "<p>One. Two.</p>"), ("http://t.org/2", "<p>Two. Three.</p>"), (None, None), (None, "<p>Two.</p>")]
    df = spark.createDataFrame([(u, h, 1) for u, h in pages], "url string, html string, node int").repartition(4)
    lists = style_tree.host_lists(df.select("html", style_tree.host_of(df.url).alias("host"))).collect()
    got = {(r.host, e.node, e.feature): e.entropy for r in lists for e in r.entropies or ()}
    assert {r.host: r.pages for r in lists} == {"s.org": 9, "t.org": 2, "": 1}
    sign = style_tree._signed
    want = {(h, sign(p), sign(s)): e for (h, p, s), e in plain_entropies(pages).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_entropies_decide_unmarked_branches(spark):
    pages = site(random.Random(5), 12)
    rows = [(i, u, h, "x", 3) for i, (u, h) in enumerate(pages)] + [(0, *pages[0], "x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, entropies int")
    got = [(r.page_id, r.text) for r in style_tree.main_text(df).orderBy("page_id").collect()]
    assert len(got) == 13 and got[0] == got[1]  # a repeated row is judged alike
    assert all(t.startswith("w") and "Second" in t and "Home" not in t and "All rights" not in t and not re.search(r"\bl\d", t) for _, t in got)
    without = {i: style_tree.extract(h, {}) for i, (_, h) in enumerate(pages)}
    assert all(without[i] != t for i, t in got)  # with all entropies 0, nothing here would go


def test_comments_and_very_long_pages(spark):
    long = " ".join(f"n{i}." for i in range(40_000))
    pages = [(i, f"http://c.org/{i}", f"<article><p>Body {i}.</p><div class='comments'><p>Reader {i} said so.</p></div></article><aside>x {i}</aside>") for i in range(8)]
    pages += [(8, "http://c.org/8", f"<article><p>{long}</p></article>"), (9, "http://d.org", "<article class='post comments'><p>Kept</p></article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in style_tree.main_text(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert [got[i][0] for i in range(8)] == [f"Body {i}." for i in range(8)]
    assert got[8] == (long, len(long)) and got[9][0] == "Kept"


def near_roots(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return [x if s and d is not None else None for (d, _), s, x in zip(rows, sets, label, strict=True)]


def plain_pipeline(rows, model, bench):
    """(doc_id, text) after the four filters; ``rows`` may repeat."""
    rows = [r for r in rows if plain_score(model, r[1]) >= 0.3]
    best = {}
    for (d, t), root in zip(rows, near_roots(rows), strict=True):
        if root is not None:
            h = xxhash.xxh64_intdigest(t.encode(), seed=42)
            key = (d, h - 2**64 if h >= 2**63 else h, t)
            best[root] = min(best.get(root, key), key)
    rows = [r for r, root in zip(rows, near_roots(rows), strict=True) if root is None] + [(d, t) for d, _, t in best.values()]
    low = {}
    for d, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 49 if d is not None else 0):
            low[tuple(w[p : p + 50])] = min(low.get(tuple(w[p : p + 50]), d), d)
    out = []
    for (d, t), (_, n_words, n_removed, _) in zip(rows, brute_removed(rows), strict=True):
        w = (t or "").split()
        gone = {i for p in range(len(w) - 49 if d is not None else 0) if low[tuple(w[p : p + 50])] < d for i in range(p, p + 50)}
        assert len(gone) == n_removed
        if not n_removed:
            out.append((d, t))
        elif n_removed < n_words:
            out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return [r for r in out if not brute_contamination([r], bench)[0][4]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages, benchmark passages, junk, repeated and null ids; labels and benchmark."""
    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice(["the", "river", "runs", "slowly", "past", "old", "towns", "and", "quiet"]) + str(rnd.randrange(900)) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    junk = lambda n: " ".join(rnd.choice(["BUY!!!", "$$$", "win###", "cl1ck|"]) for _ in range(n))
    rows = [(i, prose(rnd.randrange(30, 200)) if i % 3 else junk(rnd.randrange(5, 60))) for i in range(60)]
    labels = [(i, int(i % 3 > 0)) for i in range(60)]
    bench = [(1, prose(20)), (2, prose(13)), (3, "short item"), (None, prose(15)), (4, None)]
    passage = prose(70)
    rows += [(100, rows[1][1]), (101, rows[2][1] + " tail"), (102, passage + " " + prose(40)), (103, prose(30) + " " + passage), (104, passage), (105, bench[0][1]), (106, prose(40) + " " + bench[1][1])]
    rows += [(4, prose(80)), (4, rows[4][1]), (5, rows[5][1]), (None, rows[7][1]), (None, passage), (200, None), (201, ""), (202, prose(9000)), (7, rows[7][1] + " x")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_pipeline_against_plain_python(spark, corpus):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    folder, rows, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = plain_pipeline(rows, model, bench)
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folder).toArrow(), docs.schema)
        assert kept.columns == docs.columns, name
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 40 < len(got) < len(rows)
    full = Tokenizer.from_file(queries.tokenizer_file())
    sizes = sorted(((d, len(full.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in want), key=repr)
    pieces = p.run(spark, folder).collect()
    assert sorted(((x.doc_id, x.doc_tokens) for x in pieces if x.start == 0), key=repr) == sizes
    assert sum(x.length for x in pieces) == sum(n for _, n in sizes)


def test_pipeline_of_nothing_and_of_other_columns(spark, corpus, tmp_path):
    import corpus_pipeline as p

    folder = corpus[0]
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        assert stage(spark, empty, folder).count() == 0
    clash = spark.createDataFrame([(1, "some good text here now", "en", "s", 23, 1, 2, "k", 0.5, 3, 4, "r", "c", 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, node long, best int, spans string, score double, n int, d long, row string, carried string, h long, row_id long")
    for name, stage in p.STAGES[1:-1]:
        assert stage(spark, clash, folder).collect() == clash.collect(), name


def test_equal_rows_do_not_multiply(spark):
    text = " ".join(f"e{i}" for i in range(120))
    docs = passages.keyed(spark.createDataFrame([(1, text)] * 2000 + [(2, text + " x")] * 3, "doc_id long, text string").repartition(6))
    runs = passages.runs_of(docs, 50)
    assert runs.count() > 2000
    found = passages.texts_with(docs, runs, "runs", ["anchor", "first", "last"])
    assert found.count() == 2 and passages.windows_of(found, 50).count() == 71 + 72


@pytest.mark.parametrize("held", [1, 7])
def test_suffix_groups_over_many_ranges(spark, monkeypatch, held):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    docs = awkward(spark, 7)
    want = brute_spans([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {tuple(r) for r in suffix_dedup.repeats(docs).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids_of_other_types_and_other_columns(spark):
    encode = tokens.byte_bpe(queries.tokenizer_file())
    for kind, value in (("smallint", 7), ("decimal(20,0)", 8), ("string", "k"), ("date", None)):
        docs = spark.createDataFrame([("a b c",), (None,)], "text string").selectExpr(f"cast({value!r} as {kind}) doc_id" if value is not None else f"cast(null as {kind}) doc_id", "text", "1 start", "2 offset")
        pieces = vector_packing.pack(docs, encode, (64, 8, 64)).collect()
        assert sorted(p.doc_tokens for p in pieces) == [1, 4] and {str(p.doc_id) for p in pieces} == {str(value)}
        turns = spark.createDataFrame([(0, "user", "hi")], "turn int, role string, text string").selectExpr(f"cast({value!r} as {kind}) conv_id" if value is not None else f"cast(null as {kind}) conv_id", "turn", "role", "text", "3 formatted", "4 n_turns")
        assert [r.n_turns for r in chat_format.read_back(chat_format.format_turns(turns)).collect()] == [1]


def test_chat_of_nothing_and_of_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], schema))).count() == 0
    rows = [(5, i, ("user", "assistant")[i % 2], f"</s> turn {i}") for i in range(30_000)]
    got = chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, schema).repartition(4))).first()
    assert got.n_turns == 30_000 and got.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_urls_repeated_long_and_empty(spark):
    long = "http://x.com/en/" + "a" * 100_000
    df = spark.createDataFrame([(1, long, "h"), (1, long, "h"), (2, "http://com/en/", "h")], "page_id long, url string, host string")
    got = [(r.page_id, len(r.path), r.rule) for r in url_filter.filter_urls(df, "page_id").collect()]
    assert sorted(got) == [(1, 100_004, "com/en/"), (1, 100_004, "com/en/"), (2, 4, "com/en/")]
    assert url_filter.filter_urls(df.where("false"), "page_id").count() == 0


def test_top_k_with_clashing_columns(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i, 0, 0.5) for i in range(1, 9)], "vec_id int, embedding array<double>, rank int, query_id int, score double")
    got = [tuple(r) for r in topk_search.top_k(v, v.where("vec_id = 2"), k=2, scale=1.0).orderBy("rank").collect()]
    assert got == [(2, 1, 8, 17), (2, 2, 7, 15)]
