"""Registered queries of the operators, with production parameters over whole tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus.llm import (
    decontaminate, divergence, exact_dedup, language_id, line_dedup, packing, prefix_trie, sharding, simhash, substring_dedup, toxicity, url_reputation, warc,
)
from sqlcorpus.llm.common import table

#: The tokenizer that the packing query is bound to.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, items = F.col("found"), F.col("found.items")
    return decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        F.size(found["hits"]).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs, labels)
    return model.score(docs).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~toxicity.held_out(F.col("doc_id"), 3, 1)))
    return model.predict(docs.drop("lang")).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "language.lang_pred", "language.score")


#: FIXED VALUES: the rules of the URL query as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labelled quality of the document with the page's number, 0 being bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(pages, outcomes, URL_RULES).drop("bad_rate", "bound")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove(docs).select("doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_toxicity, op3_warc_archives, op4_language_id, op5_url_reputation, op6_substring_dedup, op7_exact_dedup, op8_packing,
        op9_line_dedup, op10_simhash_near_dedup, op11_prefix_trie, op12_source_divergence, op13_sharding,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op1_benchmark_decontamination": rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT r, p, n, item FROM grams JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
""",
    "op3_warc_archives": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS sha FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
           ((16 * (instr('0123456789abcdef', substr(sha, 1 + (5 * i) // 4, 1)) - 1)
             + greatest(instr('0123456789abcdef', substr(sha, 2 + (5 * i) // 4, 1)) - 1, 0) * (CASE WHEN 2 + (5 * i) // 4 <= 40 THEN 1 ELSE 0 END))
            // (CASE (5 * i) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
""",
    "op5_url_reputation": r"""
WITH u AS (
    SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h0,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
seen AS (SELECT page_id, translate(h0, '@UP', '@LOW') AS host, path FROM u),
counted AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
hosts AS (
    SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), '(:\d*)?\.?$', '') AS bare
    FROM seen LEFT JOIN counted USING (page_id) GROUP BY host),
split AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^\d+\.\d+\.\d+\.\d+$') OR len(string_split(bare, '.')) < 2 AS whole FROM hosts),
two AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1) : len(l)], '.') AS t2, array_to_string(l[greatest(len(l) - 2, 1) : len(l)], '.') AS t3 FROM split),
units AS (
    SELECT host, n, bad, CASE WHEN whole THEN bare WHEN t2 IN (@SUFFIXES) THEN t3 ELSE t2 END AS domain,
           CASE WHEN whole THEN bare WHEN t2 IN (@SUFFIXES) THEN t2 ELSE l[len(l)] END AS suffix FROM two),
l0 AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM units),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM units, l0 GROUP BY suffix),
ks AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * m) * (bad - n * m) / n - m * (1 - m) END) / sum(CASE WHEN n > 1 THEN m * (1 - m) * (n - 1) END) AS rho FROM s0),
s1 AS (SELECT s0.*, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1000) ELSE 1000 END AS k FROM s0, ks),
s2 AS (SELECT suffix, (bad + k * m) / (n + k) AS post FROM s1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(post) AS m FROM units JOIN s2 USING (suffix) GROUP BY suffix, domain),
kd AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * m) * (bad - n * m) / n - m * (1 - m) END) / sum(CASE WHEN n > 1 THEN m * (1 - m) * (n - 1) END) AS rho FROM d0),
d1 AS (SELECT d0.*, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1000) ELSE 1000 END AS k FROM d0, kd),
d2 AS (SELECT domain, (bad + k * m) / (n + k) AS post FROM d1),
h0 AS (SELECT host, n, bad, post AS m FROM units JOIN d2 USING (domain)),
kh AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * m) * (bad - n * m) / n - m * (1 - m) END) / sum(CASE WHEN n > 1 THEN m * (1 - m) * (n - 1) END) AS rho FROM h0),
h1 AS (SELECT h0.*, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1000) ELSE 1000 END AS k FROM h0, kh),
h2 AS (SELECT host, (bad + k * m) / (n + k) AS rate, n + k AS strength FROM h1),
rules(what, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
    SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(what, length(h || p)) AS what
    FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
SELECT s.page_id, s.host, s.path, rule,
       coalesce(what, CASE WHEN rate - 1.64 * sqrt(rate * (1 - rate) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM seen s JOIN h2 ON s.host = h2.host LEFT JOIN fit f ON f.page_id IS NOT DISTINCT FROM s.page_id AND f.host = s.host AND f.path = s.path
""".replace("@UP", _UPPER).replace("@LOW", _LOWER).replace("@SUFFIXES", ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)),
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
""",
    "op7_exact_dedup": r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER best = 1 AS kept, sha AS text_sha256
FROM n WINDOW best AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
""",
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l FROM documents),
raw AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM d),
lines AS (
    SELECT r, doc_id, line_no, w, array_to_string(w, ' ') AS s
    FROM (SELECT r, doc_id, line_no, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM raw) WHERE len(w) > 0),
classes AS (SELECT s, any_value(w) AS w, row_number() OVER (ORDER BY s) AS c FROM lines GROUP BY s),
tokens AS (
    SELECT DISTINCT c, array_to_string(w[i : i + 4], ' ') AS t
    FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM classes)),
sizes AS (SELECT c, count(*) AS n FROM tokens GROUP BY c),
shared AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM tokens x JOIN tokens y ON x.t = y.t AND x.c <> y.c GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.c = a JOIN sizes q ON q.c = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
degree AS (SELECT a AS c, count(*) AS n FROM links GROUP BY a),
placed AS (SELECT r, doc_id, line_no, c FROM lines JOIN classes USING (s)),
firsts AS (SELECT c, min((doc_id, line_no)) AS p FROM placed GROUP BY c),
best AS (SELECT c, min(p) AS p FROM (SELECT c, p FROM firsts UNION ALL SELECT a, p FROM links JOIN firsts ON firsts.c = b) GROUP BY c),
judged AS (
    SELECT r, line_no, coalesce(n, 0) AS n, CASE WHEN p < (doc_id, line_no) THEN line_no || ':' || p[1] END AS m
    FROM placed JOIN best USING (c) LEFT JOIN degree USING (c)),
summed AS (SELECT r, count(*) AS n_lines, count(m) AS n_removed, CAST(sum(n) AS BIGINT) AS n_links, string_agg(m, ',' ORDER BY line_no) AS m FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_links, 0) AS n_links, coalesce(m, '') AS removed
FROM d LEFT JOIN summed USING (r)
""",
    "op11_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
           xor(4294967295, list_reduce(range(0, 8 * length(s)), lambda a, k: xor(
               (CASE WHEN k % 8 = 0 THEN xor(a, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE a END) >> 1,
               ((CASE WHEN k % 8 = 0 THEN xor(a, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE a END) & 1) * 3988292384), 4294967295)) % 4 AS h
    FROM ids),
r AS (
    SELECT c.conv_id, 0 AS half, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h
    UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
x AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, i) AS d, md5(length(role) || ':' || role || text) AS turn_id,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM r),
pre AS (
    SELECT conv_id, d, words, string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM x
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM pre GROUP BY k, d),
last AS (SELECT conv_id, max(d) AS d FROM pre GROUP BY conv_id),
ended AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS s FROM pre JOIN last USING (conv_id, d) GROUP BY k),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
below AS (
    SELECT a.k, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
    FROM whole a JOIN whole b ON starts_with(b.k, a.k) GROUP BY a.k)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM whole w JOIN below USING (k) LEFT JOIN ended USING (k) LEFT JOIN n p ON p.d = w.d - 1 AND p.k = left(w.k, length(w.k) - 32)
""",
    "op12_source_divergence": rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, total FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n) AS n_group FROM cells GROUP BY lang, source),
shares AS (
    SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (n_group + 5 * v) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (total + 5)) // (n_lang + 5 * v) AS q
    FROM cells JOIN sums USING (lang, source) JOIN v USING (lang)),
pair AS (
    SELECT g.lang, g.source, h.source AS item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value
    FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source LEFT JOIN shares b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
    GROUP BY g.lang, g.source, h.source),
term AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
    FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
