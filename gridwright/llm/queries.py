"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import chunk_dedup, decontaminate, html_template, lexical_search, mixing, nbsvm, packing, quality_rules, resampling, simhash, suffix_dedup, token_counts, url_graph
from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that aren't held out."""
    docs = spread(table(spark, sf_dir, "documents"))
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Tokens of every document by the 32k byte-pair model (``model``: another one's path)."""
    import public_tokenizers

    vocabulary = token_counts.Vocabulary.load(model or public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(spread(table(spark, sf_dir, "documents")), vocabulary)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds template windows of a benchmark item, with the item."""
    return decontaminate.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with runs of content-defined chunks that repeat."""
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the cascade for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_template.main_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes take from every document, and what strings of 200 bytes cover of it."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical_search.ranked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document by the benchmark's words, and the rank of those drawn."""
    return resampling.resampled(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens (``vocabulary``: another one's path)."""
    import public_tokenizers

    content = Path(vocabulary or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return packing.packed(spread(table(spark, sf_dir, "documents")), content)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8's mix, by source, to the thousandth of a word."""
    sizes = Scratch(spark, "mixing").cut(mixing.measured(table(spark, sf_dir, "documents")))
    return mixing.plan(sizes).select("source", "source_size", F.round(F.col("target") * 1000).cast("bigint").alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every url, as op9 has them."""
    return url_graph.with_rule(url_graph.with_host(table(spark, sf_dir, "pages"))).select("page_id", "host", "path", "rule", "ruled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_simhash_near_dedup, op3_token_counts, op4_decontamination, op5_chunk_dedup, op6_quality_rules, op7_html_template, op8_mixing, op9_url_graph, op10_suffix_dedup, op11_lexical_search, op12_importance_resampling, op13_packing)
    parts = (mix_targets, url_rules)  # of op8 and op9, what SQL can tell
    return {f.__name__: f for f in (*own, *parts)}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6, "op10_suffix_dedup": OP10, "op11_lexical_search": OP11, "op12_importance_resampling": OP12, "mix_targets": TARGETS, "url_rules": URLS}


OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT r, i, CASE WHEN lead(w, 4) OVER o IS NULL THEN NULL ELSE
    concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM win),
cov AS (SELECT r, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM rep),
repeats AS (SELECT r, sum(c) AS n FROM cov GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup,
  count(*) FILTER (WHERE regexp_matches(line, '\.\.\.[\x20\x09-\x0D]*$')) AS n_dots
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.r, w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_dots, 0) AS n_dots, coalesce(repeats.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper
  FROM w LEFT JOIN ls USING (r) LEFT JOIN repeats USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND word_chars <= 25 * n_words
    AND 10 * n_upper <= 3 * n_words AND 2 * n_dots <= n_lines AS kept
FROM b
"""


def _repeats(length: int, name: str) -> str:
    """``{name}_spans(r, a, b)``: the maximal runs of bytes under strings of ``length`` that occur twice."""
    return f"""
{name}_windows AS (SELECT r, i, hash(substr(h, 2 * i + 1, {2 * length})) AS k FROM d, range(0, n - {length - 1}) t(i)),
{name}_found AS (SELECT r, i FROM {name}_windows WHERE k IN (SELECT k FROM {name}_windows GROUP BY k HAVING count(*) > 1)),
{name}_gaps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {length} THEN 0 ELSE 1 END AS s FROM {name}_found),
{name}_runs AS (SELECT r, i, sum(s) OVER (PARTITION BY r ORDER BY i) AS run FROM {name}_gaps),
{name}_spans AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM {name}_runs GROUP BY r, run)"""


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_repeats(400, "long")},
{_repeats(200, "short")},
pieces AS (
  SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS s, a AS e FROM long_spans
  UNION ALL SELECT r, max(b), n FROM long_spans JOIN d USING (r) GROUP BY r, n),
kept AS (SELECT r, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS kept FROM pieces JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM long_spans GROUP BY r),
also AS (SELECT r, sum(b - a) AS n_shared FROM short_spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r) LEFT JOIN also USING (r)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT r, doc_id, ws, len(ws) AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
qt AS (SELECT q, item_id, unnest(ts) AS term FROM q),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
m AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM d, totals),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""

OP12 = rf"""
WITH steps AS (SELECT list(CAST(c AS UBIGINT) ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(0 AS UBIGINT) FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM range(256) r(i))),
words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
wanted AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
own AS (SELECT r, unnest(ws) AS w FROM words), other AS (SELECT unnest(ws) AS w FROM wanted),
bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM own UNION SELECT w FROM other)),
crc AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) FOR i IN range(length(h) // 2)]),
  lambda c, b: xor(t[CAST(xor(c & 255, b) AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) % 10000 AS b FROM bytes, steps),
s AS (SELECT b, count(*) AS s FROM own JOIN crc USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM other JOIN crc USING (w) GROUP BY b),
a AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM other) AS t_all),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * (s_all + 10000) / ((s + 1e0) * (t_all + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), a),
sums AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM own JOIN crc USING (w) JOIN gain USING (b) GROUP BY r),
weighed AS (SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM words LEFT JOIN sums USING (r)),
scored AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

TARGETS = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * size / weight, source NULLS LAST) AS k FROM w),
-- with the k - 1 sources of the least size to weight at twice their size, each other source gets `level` times its weight
l AS (SELECT *, (1.5 * sum(size) OVER () - coalesce(sum(2.0 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
c AS (SELECT min(k) AS k FROM l WHERE level * weight <= 2.0 * size)
SELECT source, size AS source_size, CAST(round(CASE WHEN l.k < c.k THEN 2.0 * size ELSE (SELECT level FROM l x WHERE x.k = c.k) * weight END * 1000) AS BIGINT) AS target FROM l, c
"""

URLS = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(rule, ruled) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
m AS (SELECT page_id, host, path, rule, ruled, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM p LEFT JOIN r
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))))
SELECT page_id, host, path, rule, ruled FROM m WHERE k = 1
"""
