"""Registered queries of the operators: thin calls over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import decontamination, fingerprints, html_extraction, packing, prefix_trie, quality, sharding, simhash, structure_repair, substring, superminhash, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _left_out(modulus: int, remainder: int) -> Column:
    """Rows no label may be learned from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~_left_out(3, 1))
    model = toxicity.fit(documents, "doc_id", "text", labels, "toxic")
    rows = toxicity.score_documents(model, documents, "doc_id", "text", 0.7)
    return rows.select("doc_id", _left_out(3, 1).alias("held_out"), "score", "predicted")


@_query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(16)
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", tree)
    return rows.withColumn("law", F.lit("key"))


@_query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@_query("op10_substring_dedup", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
s AS (
  SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(words[s:s + 49], ' ')) AS first FROM p),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM s WHERE first < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1),
    lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: words[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op3_decontamination", """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
    '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM words),
b AS (
  SELECT DISTINCT id AS item, least(5, len(words)) AS w,
    unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS s
  FROM w WHERE kind = 'b' AND len(words) > 0),
n AS (SELECT item, count(*) AS n FROM b GROUP BY item),
widths AS (SELECT DISTINCT w FROM b),
d AS (
  SELECT DISTINCT id AS doc_id, widths.w, unnest(list_transform(range(1, len(words) - widths.w + 2),
    lambda i: array_to_string(words[i:i + widths.w - 1], ' '))) AS s
  FROM w, widths WHERE kind = 'd' AND len(words) >= widths.w),
m AS (
  SELECT doc_id, item, count(*) / max(n) AS containment
  FROM d JOIN b USING (w, s) JOIN n USING (item) GROUP BY doc_id, item HAVING count(*) / max(n) >= 0.8),
g AS (
  SELECT doc_id, count(*) AS n_items, max(containment) AS max_containment, list_sort(list(item)) AS item_ids
  FROM m GROUP BY doc_id)
SELECT documents.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items,
  coalesce(max_containment, 0.0) AS max_containment, coalesce(item_ids, []) AS item_ids
FROM documents LEFT JOIN g USING (doc_id)
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        _table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text"
    )


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(
        _table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_neighbours(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@_query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~_left_out(5, 0))
    model = quality.fit(documents, "doc_id", "text", labels, "quality")
    rows = quality.score_documents(model, documents, "doc_id", "text", 0.3)
    return rows.select("doc_id", _left_out(5, 0).alias("held_out"), "score", "predicted")


_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@_query("op8_url_filters", """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut FROM pages),
r AS (SELECT page_id, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM u),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict FROM h JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict FROM f GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
""")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "host string, path string, verdict string")
    return url_filters.judge(_table(spark, sf_dir, "pages"), "page_id", "url", rules)


@_query("op9_html_extraction", """
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer|$)', 1) AS body FROM pages),
b AS (
  SELECT page_id, url, list_filter(
    list_transform(regexp_split_to_array(regexp_replace(body, '</?(b|i|br|a|em|strong|span)[^>]*>', ' ', 'g'), '<[^>]*(>|$)'),
      lambda x: trim(regexp_replace(
        replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
        '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM b
""")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extraction.extract_pages(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@_query("op13_superminhash", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
    lambda i: array_to_string(words[i:i + 3], ' '))) AS shingles
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("op11_structure_repair")
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    damaged = structure_repair.damage(conversations, "conv_id", "turn", "role", "text").withColumnRenamed("conv", "conv_id")
    return structure_repair.structure_report(damaged, "conv_id", "turn", "role", "text", conversations)


@_query("op12_prefix_trie", """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT DISTINCT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM t),
r AS (
  SELECT k.c, 0 AS own, pos, role, text FROM k JOIN t ON t.c = k.base WHERE pos < h
  UNION ALL SELECT k.c, 1, pos, role, text FROM k JOIN t ON t.c = k.c WHERE pos >= h),
d AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, md5(role || chr(1) || text) AS turn,
    strlen(text) AS size FROM r),
m AS (
  SELECT c, 0 AS d, '' AS node, 0 AS size FROM k
  UNION ALL SELECT c, d, string_agg(turn, ',') OVER (PARTITION BY c ORDER BY d), size FROM d),
l AS (SELECT c, max(d) AS length FROM m GROUP BY c),
n AS (SELECT d, node, min(c) AS c, count(*) AS n, max(size) AS size FROM m GROUP BY d, node),
up AS (
  SELECT n.*, p.node AS above, q.c AS parent FROM n
  LEFT JOIN m p ON p.c = n.c AND p.d = n.d - 1 LEFT JOIN n q ON q.d = p.d AND q.node = p.node),
ch AS (SELECT d - 1 AS d, above AS node, count(*) AS children FROM up WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN ch USING (d, node)),
w AS (
  SELECT m.d, m.node, count(*) FILTER (s.children = 0) AS leaves, sum((s.n - 1) * s.size) AS saved
  FROM s JOIN m ON m.c = s.c AND m.d <= s.d GROUP BY 1, 2),
e AS (
  SELECT m.d, m.node, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids
  FROM m JOIN l ON l.c = m.c AND l.length = m.d GROUP BY 1, 2)
SELECT up.c AS conv_id, CAST(up.d AS BIGINT) AS depth, parent AS parent_conv_id, up.n AS n_convs, s.children AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM up JOIN s USING (d, node) JOIN w USING (d, node) LEFT JOIN e USING (d, node)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
