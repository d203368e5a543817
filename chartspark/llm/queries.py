"""The operators' queries, as ``name -> function(spark, sf_dir)``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import chat_format, decontaminate, importance_resampling, jaccard_join, lexical_search, quality_gam, quality_rules, style_tree, substring_dedup, suffix_dedup, tokens, topk_search, url_filter, vector_packing

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Tokens, segments and loss-bearing tokens of a sequence.
PACK_LIMITS = (1024, 256, 1024)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(documents, table(spark, sf_dir, "labels"))
    out = quality_gam.scored(documents.select("doc_id", "text"), model).select("carried.doc_id", "score").select("doc_id", quality_gam.is_held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), size=50)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"), tokens.byte_bpe(tokenizer_file()), PACK_LIMITS)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=50))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near")


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), "page_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_extra(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_turns(rows))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_marks", "n_ellipsis", "n_bullet", "base_failed", "kept")
    return found.select("carried.doc_id", *names, F.array_join("failed", ",").alias("failed"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed="2024", percent=10, min_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    "op1_quality_gam": op1_quality_gam,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_vector_packing": op4_vector_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_topk": op6_exact_topk,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_style_tree": op9_style_tree,
    "op10_chat_format": op10_chat_format,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
}

_FORMS = ", ".join(f"'{w}'" for w in quality_rules.stop_forms())
_FAILED = " || ',' || ".join(
    "CASE WHEN {whole} > 0 AND ({low} OR {high}) THEN '{name}' ELSE '' END".format(
        whole=r.whole, name=r.name,
        low=f"100 * {r.part} < {r.least} * {r.whole}" if r.least is not None else "false",
        high=f"100 * {r.part} > {r.most} * {r.whole}" if r.most is not None else "false")
    for r in quality_rules.RULES)

_WINDOWS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM p),
low AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS low FROM h),
hit AS (SELECT * FROM low WHERE low < doc_id)"""

SQL: dict[str, str] = {
    "op3_suffix_dedup": _WINDOWS + """,
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g)
SELECT doc_id, min(s) - 1 AS start_word, max(s) + 50 - min(s) AS n_words, min(low) AS match_doc_id FROM i GROUP BY doc_id, island""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM (
    SELECT doc_id, w[s:s + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n u ON u.doc_id = x.doc_id JOIN n v ON v.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(u.n) + any_value(v.n) - count(*))),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT l.a, r.reach FROM r JOIN l ON l.b = r.doc_id),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op7_substring_dedup": _WINDOWS + """,
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (
  SELECT x.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY x.i) AS kept
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id),
tx AS (SELECT row_number() OVER (ORDER BY item_id, w) AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
bp AS (SELECT item, len(w) AS size, unnest(range(len(w))) AS place, unnest(w) AS term FROM tx),
dp AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM d),
tc AS (SELECT term, count(*) AS n FROM dp SEMI JOIN bp USING (term) GROUP BY term),
wp AS (SELECT item, least(size, 13) AS width, place, term, n, unnest(range(greatest(place - 12, 0), least(place, greatest(size - 13, 0)) + 1)) AS a0 FROM bp LEFT JOIN tc USING (term)),
wr AS (SELECT item, a0, width, min({'n': n, 'term': term, 'place': place}) AS r FROM wp GROUP BY item, a0, width HAVING count(n) = width),
al AS (SELECT DISTINCT doc_id, item, a0, width, pos - r.place AS shift FROM wr JOIN dp ON dp.term = r.term),
nm AS (SELECT DISTINCT al.doc_id, al.item, al.a0, al.width, al.shift, bp.place FROM al JOIN bp ON bp.item = al.item AND bp.place >= al.a0 AND bp.place < al.a0 + al.width
  JOIN dp ON dp.doc_id = al.doc_id AND dp.term = bp.term AND abs(dp.pos - al.shift - bp.place) <= 2),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item FROM nm GROUP BY doc_id, item, a0, width, shift HAVING count(*) = width) JOIN tx USING (item) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)""",
    "op2_url_filter": """
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5""",
    "op10_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\\)', chr(1) || '\1', 'g') AS t,
    regexp_replace(role, '(<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\\)', chr(1) || '\1', 'g') AS r FROM c),
n AS (
  SELECT *, length(text) + (length(t) - length(text)) AS chars,
    CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE 21 + length(r) END AS extra FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars + extra) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id""",
    "op11_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, '!?', '')) AS n_marks,
    len(list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D.,;:!?]+'), lambda x: x IN ({_FORMS}))) AS n_stop FROM d),
p AS (SELECT row_number() OVER () AS r, * FROM m),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3)),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(n_stop AS BIGINT) AS n_stop, n_marks,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet
  FROM p LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter(string_split({_FAILED}, ','), lambda x: x <> ''), ',') AS failed FROM s)
SELECT *, NOT base_failed AND failed = '' AS kept FROM f""",
    "op13_importance_resampling": r"""
WITH ct AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, ct.t[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket FROM v, ct),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN h USING (w) GROUP BY bucket),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM z) THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM f, s),
x AS (
  SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * p.n * s.n) // s.l AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN g USING (term), s GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20""",
}
