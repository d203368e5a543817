import hashlib
import random
import re
import zlib

import pytest

from chartspark.llm import chat_format, decontaminate, jaccard_join, quality_gam, queries, style_tree, substring_dedup, suffix_dedup, tokens, topk_search, url_filter, vector_packing

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def awkward(spark, seed=1):
    """Null ids and texts, empty and repeated rows, ties, one long text, columns with names that the operators use."""
    rnd = random.Random(seed)
    base = [[f"W{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 150))] for _ in range(4)]
    rows = [(None, "a b"), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, " ".join(f"v{i % 997}" for i in range(60_000)))]
    for i in range(5, 60):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    rows.append((60, " ".join(base[0] + base[1] + base[2])))
    return spark.createDataFrame([(*r, "s", 1, "k") for r in rows], "doc_id long, text string, spans string, score int, key string")


def brute_removed(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    low = {}
    for d, w in words:
        for p in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[p : p + 50])
            low[k] = min(low.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - 49 if d is not None else 0):
            if low[tuple(w[p : p + 50])] < d:
                gone |= set(range(p, p + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substring_and_suffix_dedup_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_removed(rows)
    got = [tuple(r) for r in substring_dedup.digests(substring_dedup.remove_repeats(docs)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    spans = suffix_dedup.repeats(docs).collect()
    assert sum(r.n_words for r in spans) == sum(w[2] for w in want)
    assert {r.doc_id for r in spans} == {w[0] for w in want if w[2]}


def brute_spans(rows, size=50):
    """Rows of op3: doc_id, start, words, and the least smaller document of any window; ``rows`` with one doc_id are one document."""
    words = [(d, (t or "").encode().split()) for d, t in rows if d is not None]
    low = {}
    for d, w in words:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            low[k] = min(low.get(k, d), d)
    out = set()
    for d, w in words:
        at = None
        for p in range(len(w) - size + 1):
            k = low[tuple(w[p : p + size])]
            if k >= d:
                continue
            if at is not None and p <= at[1]:
                at = [at[0], p + size, min(at[2], k)]
                continue
            if at is not None:
                out.add((d, at[0], at[1] - at[0], at[2]))
            at = [p, p + size, k]
        if at is not None:
            out.add((d, at[0], at[1] - at[0], at[2]))
    return out


def test_suffix_dedup_whole_rows(spark):
    rnd = random.Random(11)
    fresh = lambda n: [f"q{rnd.randrange(10**9)}" for _ in range(n)]
    rows, at = [], 0
    for n in (50, 51, 53, 55, 57, 60, 64, 80):  # an old short passage, and copies of one text that holds it elsewhere
        passage = fresh(n)
        holds = fresh(40) + passage + fresh(40)
        rows += [(at + 2, " ".join(fresh(30) + passage + fresh(30))), (at + 5, " ".join(holds)), (at + 9, " ".join(holds)), (at + 10, " ".join(holds[10:]))]
        at += 10
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), awkward(spark), awkward(spark, 4)):
        want = brute_spans([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert {tuple(r) for r in suffix_dedup.repeats(docs).collect()} == want


@pytest.mark.parametrize(("held", "shingles"), [(8192, 4 << 20), (3, 4 << 20), (8192, 300)])
def test_jaccard_on_awkward_rows(spark, monkeypatch, held, shingles):
    monkeypatch.setattr(jaccard_join, "HELD", held)
    monkeypatch.setattr(jaccard_join, "HELD_SHINGLES", shingles)
    docs = awkward(spark, 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            low[x] = min(low.get(x, d), d)
    want = [(d, len(s), None if d is None else low[x]) for (d, _), s, x in zip(rows, sets, label, strict=True)]
    got = [tuple(r) for r in jaccard_join.linked_components(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark, 3).select("doc_id", "text").distinct()
    full = Tokenizer.from_file(queries.tokenizer_file())
    ids = {r.doc_id: [*full.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = vector_packing.pack(docs, tokens.byte_bpe(queries.tokenizer_file()), queries.PACK_LIMITS).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[d][at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[d]), zlib.crc32(raw))
            at += p.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
        assert len(parts) <= queries.PACK_LIMITS[1]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    full, own = Tokenizer.from_file(queries.tokenizer_file()), tokens.byte_bpe(queries.tokenizer_file())()
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é\n\t 's1.,!<|endoftext|>漢 　") for _ in range(rnd.randrange(60))) for _ in range(400)] + ["a <|endoftext|> b", "", " "]
    for t, got in zip(texts, own(texts), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in full.encode(t, add_special_tokens=False).ids), t


def test_quality_held_out(spark):
    out = queries.op1_quality_gam(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = out.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.93
    assert out.score.between(0, 1).all()
    assert ((m.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5)) == 0).all()


def test_quality_without_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_gam.scored(docs, quality_gam.train(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (3, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    assert quality_gam.scored(docs, quality_gam.train(docs, some)).count() == docs.count()


def test_decontamination_awkward(spark):
    words = [f"t{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "X " + " ".join(words[:13]).upper() + " y"), (2, None), (2, ""), (None, " ".join(words[1:15])), (3, " ".join(words[:12])), (4, "só só"), (5, "a b c " * 200 + "key phrase")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "Key-phrase"), (None, "só"), (9, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 15): (13, ("7",), True), (2, 0): (0, (), False), (None, 14): (14, ("7",), True), (3, 12): (0, (), False), (4, 2): (2, (), True), (5, 602): (2, ("8",), False)}


def brute_contamination(docs, bench, size=13, share=20):
    """(doc_id, n_words, n_hit, items, contaminated) of each row, by scanning every window at every place."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: find((t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
    windows = {}
    for item, text in bench:
        w = low(text)
        for at in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, items = low(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    items |= windows[tuple(w[at : at + n])] - {None}
        out.append((doc, len(w), len(hit), tuple(sorted(items)), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contamination_rows(docs, bench):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()), key=repr)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(8)
    word = lambda: f"b{rnd.randrange(30)}"
    bench = [(i % 9 if i else None, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 12, 13, 14, 30])))) for i in range(14)] + [(3, None)]
    docs = [(i, " ".join(word() for _ in range(20)) + " " + (rnd.choice(bench)[1] or "") + " " + word()) for i in range(60)]
    docs += [(None, bench[5][1]), (1, docs[1][1]), (1, docs[1][1]), (2, ""), (3, None), (99, " ".join(word() for _ in range(30_000)))]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, pos int, term string").repartition(3)
    assert contamination_rows(rows, spark.createDataFrame(bench, "item_id long, text string")) == brute_contamination(docs, bench)


def test_proximity_matches(spark):
    words = [f"p{i}" for i in range(13)]
    moved = words[:5] + ["x"] + words[5:]  # from the sixth on, one place late
    far = words[:5] + ["x"] * 3 + words[5:]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, moved, far, words[:5] + words[6:], moved[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.contamination(docs, bench, slop=2).collect()}
    assert got == {0: (1, 1), 1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a>n</a></nav><div class="ad">buy</div>
<article><h1>Head &amp;  line</h1><p><b>One.<br><p>Two <i>in</i>line&nbsp;x</p><div class="comments"><p>bad</p></div><form><p>f</p></form></article><footer>&copy;</footer>"""


def test_repeated_words_and_long_items_cost_their_length(spark):
    n = 5000
    long = " ".join(f"w{i}" for i in range(n))
    bench = spark.createDataFrame([("same", "again " * n), ("two", "tick tock " * (n // 2)), ("long", long)], "item_id string, text string")
    rows = [(1, "again " * n), (2, "tock tick " * (n // 2) + "end"), (3, "x " + long + " y"), (4, "again " * 12 + "stop " + "again " * 12), (5, "again tick " * 40)]
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.n_near) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    assert got[1] == (n, n, ["same"], 1) and got[2] == (n + 1, n, ["two"], 1) and got[3] == (n + 2, n, ["long"], 1)
    assert got[4][:3] == (25, 0, []) and got[5][:3] == (80, 0, [])


def test_main_text(spark):
    rows = [(1, "http://h/x", PAGE), (2, None, None), (3, "http://h/y", ""), (4, "x", "<p>a<p>b <!-- open")]
    shared = [(10 + i, f"http://same.org/{i}", f"<div class=top><p>Same words</p></div><p>Own {i}</p>") for i in range(8)]
    got = {r.page_id: (r.text, r.n_chars) for r in style_tree.main_text(spark.createDataFrame(rows + shared, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "Head & line\nOne.\nTwo inline x" and got[1][1] == len(got[1][0])
    assert got[2] == got[3] == ("", 0) and got[4][0] == "a\nb"
    assert {got[10 + i][0] for i in range(8)} == {f"Own {i}" for i in range(8)}


def texts_of(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return [r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_main_text_where_entropies_decide(spark):
    box = [(f"http://box.org/{i}", f"<article><p>Own {i}</p><div class=hint><p>Everywhere</p></div></article>") for i in range(8)]
    words = [(f"http://w.org/{i}", f"<div id=share-prices><p>Price {i}</p></div><div class=share><p>Send it</p></div>") for i in range(6)]
    named = [("http://one.org/", "<div class=has-sidebar><article class='post has-sidebar'><p>Whole</p></article></div>"), ("http://two.org/", "<h1>Top</h1><article><div class='x has-sidebar'><p>Text</p></div></article>")]
    outside = [(f"http://o.org/{i}", f"<article><p>A {i}</p></article><div class=lede><p>L {i}</p></div><div class=ad>Buy {i}</div><div class=hint>Same</div>") for i in range(6)]
    some = [(f"http://s.org/{i}", f"<article><p>{'Template' if i < 90 else f'Rare {i}'}</p><h1>{i}</h1></article>") for i in range(100)]
    got = texts_of(spark, box + words + named + outside + some)
    assert got[:8] == [f"Own {i}" for i in range(8)]
    assert got[8:14] == [f"Price {i}" for i in range(6)]
    assert got[14:16] == ["Whole", "Text"]
    assert got[16:22] == [f"A {i}\nL {i}" for i in range(6)]
    assert got[22:] == [str(i) if i < 90 else f"Rare {i}\n{i}" for i in range(100)]


def test_main_text_below_rich_nodes_and_on_small_hosts(spark):
    rich = [(f"http://rich.org/{i}", "<body>" + "".join(f"<div class=c{chr(97 + k)}><p>{i} {k}</p></div>" for k in range(20)) + "<div class=top><p>Menu</p></div></body>") for i in range(6)]
    few = [(f"http://few.org/{i}", f"<div class=top><p>Menu</p></div><p>Own {i}</p>") for i in range(3)]
    copies = [("http://copies.org/a", "<div class=x><p>Twice</p></div>"), ("http://copies.org/b", "<div class=x><p>Twice</p></div>")]
    again = [(f"http://again.org/{i}", "<article><p>Copied</p></article>") for i in range(7)]
    got = texts_of(spark, rich + few + copies + again)
    assert got[:6] == ["\n".join(f"{i} {k}" for k in range(20)) for i in range(6)]
    assert got[6:9] == [f"Own {i}" for i in range(3)]
    assert got[9:] == ["Twice"] * 2 + ["Copied"] * 7


def test_chat_round_trip():
    rnd = random.Random(2)
    for _ in range(2000):
        role = rnd.choice(["user", "assistant", "system", "tool", "", "[/ROLE] "])
        text = "".join(rnd.choice([*chat_format.CONTROL, "\\", " ", "\n", "<", "a", "[INS", "T]", " </s>"]) for _ in range(rnd.randrange(8)))
        out = chat_format.render(role, text)
        assert list(chat_format.parse(out * 2)) == [(role, text, role == "assistant")] * 2


def test_chat_on_awkward_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_turns(chat_format.with_extra(df))).collect()}
    assert got == {1: (4, 2), None: (1, 0), -1: (2, 21)}


def test_top_k_awkward(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [9.0, 9.0]), (6, [1.0]), (7, [-1.0, 0.0]), (50, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk_search.top_k(v, v.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    score = 256 * 256 * 5
    assert got == [(0, 1, 1, score), (0, 2, 2, score), (0, 3, 2, score)]
    few = [tuple(r) for r in topk_search.top_k(v, v.where("vec_id = 0"), k=9).orderBy("rank").collect()]
    assert [f[2] for f in few] == [1, 2, 2, 7]
    blocks = topk_search.top_k(v, v.where("vec_id < 3"), k=2, block=1).count()
    assert blocks == 6


def test_url_filter_awkward(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q#f", "http://x.com", "http://com/en/", "http://b.org/x.com/en/", "ftp://é.net/de/é", "http://example.net/de/81"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, "page_id").collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[i][2] for i in range(3, 8)] == [None, "com/en/", None, "net/de/", "example.net/de/8"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert suffix_dedup.repeats(docs).count() == 0
    assert jaccard_join.linked_components(docs).count() == 0
    assert decontaminate.contamination(docs, bench).count() == 0
    assert vector_packing.pack(docs, tokens.byte_bpe(queries.tokenizer_file()), queries.PACK_LIMITS).count() == 0
    assert style_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(v, v).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, kept, SMALL).toArrow(), docs.schema)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "substring_dedup":
            want = {r[0]: r[3] for r in brute_removed([(r.doc_id, r.text) for r in before.collect()])}
            for r in kept.collect():
                assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id]
    pieces = p.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}


def test_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    rnd = random.Random(6)
    a, b, c = (" ".join(f"n{rnd.randrange(10**9)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (3, c, "z"), (3, c, "y"), (3, c + " more", "a"), (4, None, "x"), (4, None, "x"), (4, b + " end", "x"), (None, a, "x"), (5, "", "x"), (5, c, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in p.near_duplicates(spark, docs, SMALL).collect()]
    third = [r for r in got if r[0] == 3]
    assert len(third) == 1 and third[0] in ((3, c, "y"), (3, c + " more", "a"))
    want = [(1, a, "x"), (2, b, "x"), (4, None, "x"), (4, None, "x"), (None, a, "x"), (5, "", "x"), third[0]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, p.near_duplicates(spark, docs.repartition(3, "source"), SMALL).collect()), key=repr) == sorted(got, key=repr)
    unrelated = spark.createDataFrame([(7, a, "x"), (7, b, "x")], docs.schema)
    assert p.near_duplicates(spark, unrelated, SMALL).count() == 2


@pytest.mark.parametrize("limits", [(64, 3, 64), (64, 64, 20), (64, 4, 25)])
def test_packer_where_segments_or_loss_bind(limits):
    rnd = random.Random(9)
    loss = lambda start, length: (start + length + 1) // 2 - (start + 1) // 2  # noqa: E731  (each second token)
    packer = vector_packing.Packer(limits, loss=loss)
    ids = {k: b"".join(rnd.randrange(2**31).to_bytes(4, "little") for _ in range(rnd.choice([1, 2, 5, 30, 150]))) for k in range(400)}
    rows = [r for k, i in ids.items() for r in packer.add(k, i)] + list(packer.finish())
    by_key, by_sequence = {}, {}
    for key, start, length, crc, total, sequence, offset in rows:
        by_key.setdefault(key, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length, loss(start, length)))
        assert crc == zlib.crc32(ids[key][4 * start : 4 * (start + length)]) and total == len(ids[key]) // 4
    for key, parts in by_key.items():
        ends = [0, *(s + n for s, n in sorted(parts))]
        assert [s for s, _ in sorted(parts)] == ends[:-1] and ends[-1] == len(ids[key]) // 4
    assert by_key.keys() == ids.keys()
    for parts in by_sequence.values():
        assert all(sum(x) <= most for x, most in zip(([n for _, n, _ in parts], [1] * len(parts), [x for *_, x in parts]), limits, strict=True))
    assert max(len(p) for p in by_sequence.values()) == limits[1] or max(sum(x for *_, x in p) for p in by_sequence.values()) == limits[2]
