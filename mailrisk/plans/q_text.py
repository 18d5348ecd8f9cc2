"""Registered queries on scalar functions and sources, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import domains as dm
from mailrisk.functions import text as tx
from mailrisk.functions import verdicts as vd
from mailrisk.operators import backfill as bf
from mailrisk.operators import corpus as cp
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import corpus_view, h, mail_view
from mailrisk.plans.registry import register
from mailrisk.session import work_dir
from mailrisk.sources import labelled as lb
from mailrisk.sources import profile as pf
from mailrisk.sources import raw_mail as rm
from mailrisk.sources import sinks as sk
from mailrisk.sources.quoted_csv import read_quoted_csv


@register("sender_facts", f"""WITH {ob.MAIL}, T AS (SELECT *, lower(trim(sender)) AS s, split_part(lower(trim(sender)), '@', 1) AS loc, split_part(lower(trim(sender)), '@', 2) AS dm FROM M)
SELECT msg_id, {ob.sender_domain('sender')} AS domain, split_part(sender, '@', 1) AS display_name,
  CASE WHEN dm IN ('gmail.com', 'googlemail.com') THEN replace(split_part(loc, '+', 1), '.', '') || '@gmail.com' ELSE split_part(loc, '+', 1) || '@' || dm END AS mailbox,
  md5(sender || '|' || subject) AS row_identity, md5(sender || '|' || subject || '|' || msg_id % 50) AS placed_identity FROM T""")
def sender_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.col("sender")
    return mail_view(spark, sf_dir).select(
        "msg_id", dm.sender_domain(sender).alias("domain"), dm.display_name(sender).alias("display_name"),
        dm.canonical_mailbox(sender).alias("mailbox"), tx.row_identity(sender, F.col("subject")).alias("row_identity"),
        tx.row_identity(sender, F.col("subject"), F.col("msg_id") % 50).alias("placed_identity"),
    )


@register("same_mailbox_senders", f"""WITH {ob.MAIL}, T AS (SELECT DISTINCT sender, split_part(lower(trim(sender)), '@', 1) AS loc, split_part(lower(trim(sender)), '@', 2) AS dm FROM M),
K AS (SELECT sender, CASE WHEN dm IN ('gmail.com', 'googlemail.com') THEN replace(split_part(loc, '+', 1), '.', '') || '@gmail.com' ELSE split_part(loc, '+', 1) || '@' || dm END AS mailbox FROM T)
SELECT mailbox, count(*) AS n_spellings FROM K GROUP BY mailbox""")
def same_mailbox_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = mail_view(spark, sf_dir).select("sender").distinct()
    return spellings.groupBy(dm.canonical_mailbox(F.col("sender")).alias("mailbox")).agg(
        F.count(F.lit(1)).alias("n_spellings")
    )


@register("link_hosts", f"""WITH {ob.MAIL}, L AS (SELECT msg_id, {ob.sender_domain('sender')} AS domain, unnest(regexp_extract_all(content, {ob.q(ob.URL_PATTERN)})) AS u FROM M),
K AS (SELECT msg_id, domain, u, {ob.url_host('u')} AS host FROM L)
SELECT host, count(*) AS n_links, count(DISTINCT msg_id) AS n_messages, count(*) FILTER (WHERE ({ob.organisation('host')}) = ({ob.organisation('domain')}) AND ({ob.organisation('host')}) <> '') AS n_same_organisation,
  bool_or({ob.below('host', ob.arr(dm.OFFICIAL_DOMAINS))}) AS is_official FROM K GROUP BY host""")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts linked to; hosts are counted per message first, so a host in most mails folds early."""
    links = mail_view(spark, sf_dir).select(
        "msg_id", dm.sender_domain(F.col("sender")).alias("domain"), F.explode(tx.urls_in(F.col("content"))).alias("u")
    ).select("msg_id", "domain", dm.url_host(F.col("u")).alias("host"))
    same = dm.same_organisation(F.col("host"), F.col("domain"))
    per_message = links.groupBy("host", "msg_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("s")
    )
    return per_message.groupBy("host").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_messages"), F.sum("s").alias("n_same_organisation")
    ).withColumn("is_official", dm.belongs_to_any(F.col("host"), dm.OFFICIAL_DOMAINS))


def brand_domains(spark: SparkSession) -> DataFrame:
    """The brand dimension: 135 rows, fixed by the rule set."""
    rows = [
        (brand, i, domain, brand in lx.AMBIGUOUS_BRANDS)
        for i, (brand, domains) in enumerate(lx.BRANDS.items())
        for domain in domains
    ]
    return spark.createDataFrame(rows, "brand string, ord int, domain string, ambiguous boolean")


@register("official_domain_match", f"""WITH {ob.MAIL}, BD(brand, ord, domain) AS (VALUES {', '.join(f"({ob.q(b)}, {i}, {ob.q(d)})" for i, (b, ds) in enumerate(lx.BRANDS.items()) for d in ds)}),
T AS (SELECT msg_id, {ob.sender_domain('sender')} AS sd FROM M)
SELECT msg_id, min(ord) AS first_brand, count(DISTINCT ord) AS n_brands FROM T JOIN BD ON sd = BD.domain OR ends_with(sd, '.' || BD.domain) GROUP BY msg_id""")
def official_domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix match as an equality join: each domain and its parents against the brand table."""
    senders = mail_view(spark, sf_dir).select("msg_id", dm.sender_domain(F.col("sender")).alias("sd"))
    parents = senders.select("msg_id", F.explode(dm.suffixes(F.col("sd"))).alias("domain"))
    hits = parents.join(F.broadcast(brand_domains(spark)), "domain")
    return hits.groupBy("msg_id").agg(F.min("ord").alias("first_brand"), F.count_distinct("ord").alias("n_brands"))


@register("text_facts", f"""WITH {ob.MAIL}
SELECT msg_id, substring(sha256(content), 1, 32) AS fingerprint,
  CASE WHEN regexp_matches(subject || ' ' || content, '{ob.HEBREW_PATTERN}') THEN 'Hebrew' ELSE 'English' END AS language,
  md5(CASE WHEN length(content) <= 6000 THEN content ELSE substring(content, 1, 4000) || chr(10) || '...' || chr(10) || right(content, 1500) END) AS trimmed,
  md5(substring(content, 1, {CFG.content_chars})) AS stored, md5(sender || ' ' || subject || ' ' || content) AS model_input,
  len(regexp_extract_all(content, {ob.q(ob.URL_PATTERN)})) AS n_links FROM M""")
def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return mail_view(spark, sf_dir).select(
        "msg_id", tx.fingerprint(content).alias("fingerprint"),
        tx.language_of(F.concat_ws(" ", "subject", "content")).alias("language"),
        F.md5(tx.head_and_tail(content)).alias("trimmed"),
        F.md5(F.substring(content, 1, CFG.content_chars)).alias("stored"),
        F.md5(tx.model_input(F.col("sender"), F.col("subject"), content)).alias("model_input"),
        F.size(tx.urls_in(content)).alias("n_links"),
    )


@register("reasons_json", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT msg_id, CASE WHEN msg_id % 9 = 0 THEN 0 ELSE len(rule_reasons) END AS n_reasons,
  CASE WHEN msg_id % 9 = 0 THEN '' ELSE array_to_string(rule_reasons, ' | ') END AS reasons FROM S""")
def reasons_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons stored as JSON text and read back; every ninth stored value is damaged."""
    from mailrisk.operators.mail_rules import score_mail

    stored = score_mail(mail_view(spark, sf_dir)).select(
        "msg_id",
        F.when(F.col("msg_id") % 9 == 0, "{broken").otherwise(vd.indicators_to_json(F.col("rule_indicators"))).alias("j"),
    )
    back = stored.select("msg_id", vd.indicators_from_json(F.col("j")).alias("r"))
    return back.select("msg_id", F.size("r").alias("n_reasons"), F.array_join("r", " | ").alias("reasons"))


@register("risk_bands", f"""WITH {ob.MAIL}, B(min_score, label) AS (VALUES ({CFG.bands[2]}, {ob.q(lx.LEVEL_HIGH)}), ({CFG.bands[1]}, {ob.q(lx.LEVEL_MEDIUM)}), ({CFG.bands[0]}, {ob.q(lx.LEVEL_LOW)}), (0, {ob.q(lx.LEVEL_SAFE)}))
SELECT label, min_score, count(*) AS n_messages FROM (SELECT msg_id, arg_max(B.label, min_score) AS label, max(min_score) AS min_score FROM M JOIN B ON model_score >= min_score GROUP BY msg_id) GROUP BY label, min_score""")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the published band table: a range look-up with four broadcast rows."""
    bands = sk.band_table(spark)
    scores = mail_view(spark, sf_dir).groupBy("model_score").agg(F.count(F.lit(1)).alias("n"))
    hits = scores.join(F.broadcast(bands), F.col("model_score") >= F.col("min_score"))
    best = hits.groupBy("model_score").agg(
        F.max("min_score").alias("min_score"), F.max_by("label", "min_score").alias("label"), F.max("n").alias("n")
    )
    return best.groupBy("label", "min_score").agg(F.sum("n").alias("n_messages"))


@register("threshold_bands", """SELECT threshold, round_even(threshold * 6e-1, 0)::INTEGER AS low, threshold AS medium,
  round_even(threshold + (100 - threshold) * 45e-2, 0)::INTEGER AS high, n_messages
FROM (SELECT (doc_id % 101)::INTEGER AS threshold, count(*) AS n_messages FROM documents GROUP BY 1)""")
def threshold_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands derived from a threshold, as a column function over the documents' own numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 101).cast("int").alias("threshold"))
    counted = docs.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_messages"))
    return counted.select("threshold", vd.bands_column(F.col("threshold")).alias("b"), "n_messages").select(
        "threshold", "b.*", "n_messages"
    )


def _lookalike_sql() -> str:
    d, stem = "official", "split_part(official, '.', 1)"
    tail = "substr(official, length(split_part(official, '.', 1)) + 1)"
    swap = " ".join(
        f"WHEN contains({stem}, '{a}') THEN substr({stem}, 1, instr({stem}, '{a}') - 1) || '{b}' || substr({stem}, instr({stem}, '{a}') + 1)"
        for a, b in (("o", "0"), ("l", "1"), ("i", "1"))
    )
    return f"""SELECT doc_id, {d} AS official, CASE {ob.h('ls')} % 6 WHEN 0 THEN {stem} || '-secure' || {tail} WHEN 1 THEN {stem} || '-verify' || {tail}
  WHEN 2 THEN 'secure-' || {stem} || {tail} WHEN 3 THEN (CASE {swap} ELSE {stem} || 's' END) || {tail}
  WHEN 4 THEN {stem} || {ob.pick(lx.POOL_TLDS, ob.h('lt'))} ELSE {stem} || {ob.pick(lx.LOOKALIKE_TAILS, ob.h('lt'))} || {tail} END AS imitation
FROM (SELECT doc_id, {ob.pick(dm.OFFICIAL_DOMAINS, ob.h('lo'))} AS official FROM documents)"""


@register("lookalike_domains", _lookalike_sql())
def lookalike_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    drawn = docs.select("doc_id", tx.pick(dm.OFFICIAL_DOMAINS, h("lo")).alias("official"))
    return drawn.select("doc_id", "official", bf.lookalike(F.col("official"), h("ls"), h("lt")).alias("imitation"))


# Sources -----------------------------------------------------------------------------------------


@register("text_column_choice", """WITH W AS (SELECT avg(length(text)) AS text, avg(length(lang)) AS lang, avg(length(source)) AS source FROM documents)
SELECT 'text' AS column_name, text AS mean_chars, text >= 80 AS wide_enough FROM W""")
def text_column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column of the documents holds the message: chosen by content, not by position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    name, width = lb.pick_text_column(docs)
    return spark.createDataFrame([(name, width, width >= lb.NARROW_TEXT)], "column_name string, mean_chars double, wide_enough boolean")


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


CSV_CHUNK = 1 << 20  # small chunks, so that records cross them


@register("labelled_sources", f"""WITH {ob.CORPUS}, T AS (
  SELECT 'mixed' AS source, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label, text FROM C
  UNION ALL SELECT 'links', 1, url FROM pages
  UNION ALL SELECT 'spam', 0, text FROM C
  UNION ALL SELECT 'plain', CASE WHEN row_id % 7 = 0 THEN 0 ELSE label END, text FROM C)
SELECT source, label, count(*) AS n_rows, count(DISTINCT md5(text)) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM T GROUP BY source, label""")
def labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora written as CSV with the header and label styles met in public ones, and loaded."""
    folder = f"{work_dir(spark)}/csv-{uuid.uuid4().hex}"
    corpus = corpus_view(spark, sf_dir)
    spelled = F.when(F.col("label") == 1, "phishing").when(F.col("row_id") % 2 == 0, "ham").otherwise("spam")
    mixed = _write_csv(corpus.select(spelled.alias("Class"), F.col("text").alias("Email Body")), f"{folder}/mixed")
    links = _write_csv(
        spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id"), "url"), f"{folder}/links"
    )
    spam = _write_csv(corpus.select("text", F.col("label").cast("string").alias("label")), f"{folder}/spam")
    odd = F.when(F.col("row_id") % 7 == 0, "unknown").otherwise((F.col("label") * 3).cast("string"))
    plain = _write_csv(corpus.select("text", odd.alias("label")), f"{folder}/plain")
    frames = [
        lb.mixed_corpus(read_quoted_csv(spark, mixed, CSV_CHUNK)).withColumn("source", F.lit("mixed")),
        lb.positive_corpus(read_quoted_csv(spark, links, CSV_CHUNK)).withColumn("source", F.lit("links")),
        lb.spam_corpus(read_quoted_csv(spark, spam, CSV_CHUNK)).withColumn("source", F.lit("spam")),
        lb.plain_corpus(read_quoted_csv(spark, plain, CSV_CHUNK)).withColumn("source", F.lit("plain")),
    ]
    return cp.union_sources(frames).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.md5("text")).alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@register("schema_profile", f"""WITH {ob.MAIL}, P0 AS (SELECT ['documents', 'conversations', 'events'][user_id % 3 + 1] AS source, CASE WHEN user_id % 3 = 0 THEN sender ELSE '' END AS sender FROM M),
K AS (SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE trim(sender) <> '') AS n_kept FROM P0 GROUP BY source),
FI(stem, sender_columns, subject_columns) AS (VALUES ('documents_mail', 'sender', 'subject'), ('events', '', ''), ('conversations', '', ''), ('orders', '', ''), ('scan_log', 'sender', 'subject'))
SELECT stem, sender_columns, subject_columns, coalesce(K.source, '') AS source, coalesce(n_rows, 0) AS n_rows, coalesce(n_kept, 0) AS n_kept,
  CASE WHEN sender_columns = '' THEN 'absent' WHEN coalesce(n_kept, 0) > 0 THEN 'kept' ELSE 'dropped' END AS status
FROM FI LEFT JOIN K ON K.source = split_part(stem, '_', 1)""")
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = mail_view(spark, sf_dir)
    headers = {
        "documents_mail": mail.columns,
        "scan_log": ["user_email", "sender", "subject", "content"],
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet").columns for t in ("events", "conversations", "orders")},
    }
    names = tx.literal_array(["documents", "conversations", "events"])
    prepared = mail.select(
        F.element_at(names, (F.col("user_id") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("user_id") % 3 == 0, F.col("sender")).otherwise("").alias("sender"),
    )
    return pf.schema_profile(spark, headers, prepared)


@register("raw_mail_parse", """SELECT doc_id, md5(trim('Note ' || doc_id || ' ' || text, ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM documents
WHERE length(trim('Note ' || doc_id || ' ' || text, ' ' || chr(10) || chr(9) || chr(13))) > 30""")
def raw_mail_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as RFC 822 messages, plain or with a transfer-encoded part, parsed back to text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    subject = F.concat(F.lit("Subject: Note "), F.col("doc_id").cast("string"), F.lit("\nMIME-Version: 1.0\n"))
    plain = F.concat(
        subject, F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text")
    )
    parts = F.concat(
        subject, F.lit('Content-Type: multipart/mixed; boundary="==b=="\n\n--==b==\nContent-Type: image/png\n\nx\n'),
        F.lit("--==b==\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(F.encode("text", "UTF-8")), F.lit("\n--==b==--\n"),
    )
    raw = F.when(F.col("doc_id") % 2 == 0, plain).otherwise(parts)
    parsed = rm.parse_messages(docs.select("doc_id", F.encode(raw, "UTF-8").alias("content")))
    return rm.keep_texts(parsed).select("doc_id", F.md5("text").alias("digest"))
