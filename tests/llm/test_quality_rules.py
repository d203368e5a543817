import re
from collections import Counter

from chartspark.llm import quality_rules

SPACES = " \t\n\x0b\x0c\r"
STOP = set(quality_rules.stop_forms())


def brute(text):
    text = text or ""
    w = re.findall(f"[^{SPACES}]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_marks": sum(c in "!?" for c in text),
        "n_stop": sum(x in STOP for x in re.split(f"[{SPACES}.,;:!?]+", text) if x), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_ellipsis": sum(bool(re.search(r"(\.\.\.|…)\s*\Z", x)) for x in lines), "n_bullet": sum(x.lstrip(SPACES)[:1] in ("-", "*", "•") for x in lines), "n_repeat_words": len(covered),
    }


def verdict(m):
    bad = []
    for r in quality_rules.RULES:
        ratio = 100 * m[r.part] / m[r.whole] if m[r.whole] else None
        if ratio is not None and ((r.least is not None and ratio < r.least) or (r.most is not None and ratio > r.most)):
            bad.append(r.name)
    base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    return base, bad, not base and not bad


def test_rules_equal_brute_force_on_awkward_rows(spark):
    clean = " ".join(f"the word{i} of text{i * 7}" for i in range(30))
    texts = [
        None, "", " \n\t\x0b ", "one", "a b c", "a b c a b c", "a a a a", "a a a", "x y z\n" * 40, clean, clean, clean + " " + clean, clean.upper(), " ".join(f"{w}!!" for w in clean.split()),
        "\n".join(f"- {w}" for w in clean.split()), "\n".join(f"{w} ...\t" for w in clean.split()), clean.replace(" ", " | "), "é€𝄞 " * 60, "a b c \u0085d", " ".join(str(i % 1000) for i in range(50_000)), "y" * 300_000,
    ]
    rows = [(i // 2, t, 1, "w", 2.0, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, w string, failed double, carried string")
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert (r.carried.n_words, r.carried.w, r.carried.failed, r.carried.carried) == (1, "w", 2.0, "kept")
        by_text.setdefault(r.carried.text, []).append(r)
    for t in texts:
        m = brute(t)
        base, bad, kept = verdict(m)
        for r in by_text[t]:
            assert {k: r[k] for k in m} == m
            assert (r.base_failed, r.failed, r.kept) == (base, bad, kept)
    assert by_text[clean][0].kept and not by_text[None][0].kept


def test_rules_of_nothing_and_of_another_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judged(empty).count() == 0
    one = spark.createDataFrame([(1, "#" + " the dog" * 2 + " sat on a mat of reed" * 12)], "doc_id long, text string")
    rule = quality_rules.Rule("no_symbols", "n_symbols", "n_words", None, 0)
    assert quality_rules.judged(one, (rule,)).first().failed == ["no_symbols"]


def test_plan_has_one_projection_and_no_shuffle_or_python(spark):
    plan = quality_rules.judged(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_rows_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).select("carried.doc_id", "kept", "base_failed")
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)
