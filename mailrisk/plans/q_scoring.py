"""Registered queries on mail, link and ensemble scoring, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions import text as tx
from mailrisk.operators import ensemble as en
from mailrisk.operators import mail_rules as mr
from mailrisk.operators import url_rules as ur
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import mail_view
from mailrisk.plans.registry import register
from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG


def scored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores, legitimacy flags and every ensemble variant of the derived messages."""
    prepared = mr.prepare(mail_view(spark, sf_dir))
    flagged = mr.with_legitimacy(mr.score_prepared(prepared))
    return en.with_variants(mr.drop_prepared(flagged))


_POINT_SQL = ", ".join(mr.POINTS)


@register("mail_rule_score", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT msg_id, rule_score, {_POINT_SQL}, rule_score >= {CFG.threshold} AS is_phishing,
  {ob.level('rule_score')} AS risk_level, {ob.advice('rule_score', 'rule_reasons')} AS recommendation,
  array_to_string(rule_reasons, ' | ') AS reasons
FROM S""")
def mail_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = mr.score_mail(mail_view(spark, sf_dir))
    return scored.select(
        "msg_id", "rule_score", *mr.POINTS, "is_phishing", "risk_level", "recommendation",
        F.array_join("rule_indicators", " | ").alias("reasons"),
    )


@register("risk_by_source", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT source, count(*) AS n_messages, count(*) FILTER (WHERE rule_score >= {CFG.threshold}) AS n_phishing,
  sum(rule_score)::BIGINT AS score_sum, sum(rule_score)::BIGINT / count(*)::DOUBLE AS mean_score,
  count(*) FILTER (WHERE {ob.level('rule_score')} = {ob.q(lx.LEVEL_HIGH)}) AS n_high,
  count(*) FILTER (WHERE {ob.level('rule_score')} = {ob.q(lx.LEVEL_LOW)}) AS n_caution
FROM S GROUP BY source""")
def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = mr.score_mail(mail_view(spark, sf_dir))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if("is_phishing").alias("n_phishing"),
        F.sum("rule_score").alias("score_sum"),
        (F.sum("rule_score") / F.count(F.lit(1))).alias("mean_score"),
        F.count_if(F.col("risk_level") == lx.LEVEL_HIGH).alias("n_high"),
        F.count_if(F.col("risk_level") == lx.LEVEL_LOW).alias("n_caution"),
    )


@register("brand_impersonation", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT msg_id, dom AS domain, coalesce(brand, '') AS brand, coalesce(brand_where, '') AS brand_where, p_brand FROM S""")
def brand_impersonation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = mr.with_impersonation(mr.prepare(mail_view(spark, sf_dir)))
    points = (
        F.when(F.col("brand_where") == "subject", CFG.impersonation_subject_points)
        .when(F.col("brand_where") == "body", CFG.impersonation_body_points)
        .otherwise(0)
    )
    return judged.select(
        "msg_id", F.col("_domain").alias("domain"), tx.text_or_empty(F.col("brand")).alias("brand"),
        tx.text_or_empty(F.col("brand_where")).alias("brand_where"), points.alias("p_brand"),
    )


@register("trusted_and_transactional_flags", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT msg_id, trusted AS trusted_sender, transactional, promotional, asks_credentials FROM S""")
def trusted_and_transactional_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = mr.with_legitimacy(mr.prepare(mail_view(spark, sf_dir)))
    return flagged.select("msg_id", "trusted_sender", "transactional", "promotional", "asks_credentials")


def _url_sql() -> str:
    q, arr = ob.q, ob.arr
    brand = f"""list_filter({arr(lx.URL_BRANDS)}, lambda b: contains(host, b)
      AND NOT (len(string_split(host, '.')) = 2 AND string_split(host, '.')[1] = b))"""
    lines = [
        f"CASE WHEN u_http > 0 THEN {q(lx.URL_REASON_HTTP)} END",
        f"CASE WHEN u_ip > 0 THEN {q(lx.URL_REASON_IP)} END",
        f"CASE WHEN u_shortener > 0 THEN {q(lx.URL_REASON_SHORTENER)} END",
        f"CASE WHEN u_tld > 0 THEN replace({q(lx.URL_REASON_TLD)}, '%s', string_split(host, '.')[-1]) END",
        f"CASE WHEN u_long > 0 THEN replace({q(lx.URL_REASON_LONG)}, '%d', length(link)::VARCHAR) END",
        f"CASE WHEN u_dots > 0 THEN {q(lx.URL_REASON_DOTS)} END",
        f"CASE WHEN u_homoglyph > 0 THEN {q(lx.URL_REASON_HOMOGLYPH)} END",
        f"CASE WHEN u_brand > 0 THEN replace({q(lx.URL_REASON_BRAND)}, '%s', brands[1]) END",
        f"CASE WHEN u_path > 0 THEN replace({q(lx.URL_REASON_PATH)}, '%s', array_to_string(words, ', ')) END",
    ]
    levels = [q(v) for v in lx.URL_LEVELS]
    return f"""WITH L AS (
  SELECT key, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'http://' || u END AS link FROM (
    SELECT page_id AS key, trim(url) AS u FROM pages
    UNION ALL SELECT -1 - page_id, {_url_variant_sql()} FROM pages)
), H AS (
  SELECT key, link, replace(lower(regexp_extract(link, '^https?://([^/?#]*)', 1)), 'www.', '') AS host,
    lower(regexp_replace(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) AS path
  FROM L
), B AS (
  SELECT *, {brand} AS brands, list_filter({arr(lx.URL_PATH_TERMS)}, lambda w: contains(path, w)) AS words
  FROM H
), U AS (
  SELECT *, CASE WHEN starts_with(link, 'http://') THEN 15 ELSE 0 END AS u_http,
    CASE WHEN regexp_matches(link, '^https?://([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') THEN 35 ELSE 0 END AS u_ip,
    CASE WHEN {ob.below('host', arr(lx.URL_SHORTENERS))} THEN 20 ELSE 0 END AS u_shortener,
    CASE WHEN len(list_filter({arr(lx.URL_TLDS)}, lambda t: ends_with(host, t))) > 0 THEN 25 ELSE 0 END AS u_tld,
    CASE WHEN length(link) > 100 THEN 10 ELSE 0 END AS u_long,
    CASE WHEN len(string_split(host, '.')) > 3 THEN 15 ELSE 0 END AS u_dots,
    CASE WHEN {ob.hits('host', lx.URL_HOMOGLYPHS)} > 0 THEN 40 ELSE 0 END AS u_homoglyph,
    CASE WHEN len(brands) > 0 THEN 30 ELSE 0 END AS u_brand,
    least(len(words) * 10, 25) AS u_path
  FROM B
), T AS (
  SELECT *, least({' + '.join(ur.URL_POINTS)}, 100) AS url_score,
    list_filter([{', '.join(lines)}], lambda r: r IS NOT NULL) AS found FROM U
)
SELECT key, link AS url_scored, {', '.join(ur.URL_POINTS)}, url_score, url_score >= 70 AS is_dangerous,
  CASE WHEN url_score >= 70 THEN {levels[0]} WHEN url_score >= 40 THEN {levels[1]}
    WHEN url_score >= 20 THEN {levels[2]} ELSE {levels[3]} END AS url_level,
  CASE WHEN len(found) = 0 THEN {q(lx.NOTHING_FOUND)} ELSE array_to_string(found, ' | ') END AS reasons
FROM T"""


# Shapes of dangerous links, appended to each page's own address as a second row.
URL_SHAPES = [
    "http://192.168.0.1/login", "paypa1.com", "https://bit.ly/x", "https://accounts.google.com",
    "https://google.com/", "https://www.secure-bank.xyz/verify/account;jsession=1?x=2", "leumi.top/update",
    "https://a.b.c.d.work/Wallet/Signin",
]


def _url_variant_sql() -> str:
    return (
        f"({ob.arr(URL_SHAPES)}[page_id % {len(URL_SHAPES)} + 1]) || "
        "CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '[/?#][^/]*$') ELSE '' END"
    )


@register("url_rule_score", _url_sql())
def url_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    shape = tx.pick(URL_SHAPES, F.col("page_id"))
    tail = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "[/?#][^/]*$", 0)).otherwise("")
    both = pages.select(
        F.explode(
            F.array(
                F.struct(F.col("page_id").alias("key"), F.col("url").alias("url")),
                F.struct((-1 - F.col("page_id")).alias("key"), F.concat(shape, tail).alias("url")),
            )
        ).alias("r")
    ).select("r.*")
    return ur.score_urls(both).select(
        "key", "url_scored", *ur.URL_POINTS, "url_score", "is_dangerous", "url_level",
        F.array_join("url_indicators", " | ").alias("reasons"),
    )


_MODEL_LINE = (
    f"replace(replace({ob.q(lx.REASON_MODEL)}, '%s', round_even(model_score, 0)::INTEGER::VARCHAR), '%%', '%')"
)


@register("ensemble_score", f"""WITH {ob.MAIL}, {ob.scored()},
E0 AS (SELECT * REPLACE (CASE WHEN msg_id % 10 = 0 THEN NULL ELSE model_score END AS model_score),
         {ob.draw('ut', 'msg_id')} % 20 = 0 AS user_trusted FROM S),
E1 AS (SELECT *, CASE WHEN user_trusted THEN {ob.dbl(CFG.trust_damping)} ELSE {ob.DAMPING} END AS damping FROM E0),
E2 AS (SELECT *, CASE WHEN model_score IS NULL THEN rule_score::DOUBLE ELSE {ob.combined('damping')} END AS final_score FROM E1),
E3 AS (SELECT *, CASE WHEN model_score IS NULL THEN final_score ELSE {ob.py_round('final_score')} END AS risk_score,
  CASE WHEN model_score >= {CFG.model_cutoff} THEN list_concat(list_concat(
      list_filter(rule_reasons, lambda r: r <> {ob.q(lx.NOTHING_FOUND)}), [{_MODEL_LINE}]),
      CASE WHEN rule_score < {CFG.corroboration_floor} THEN [{ob.q(lx.NO_TECHNICAL_SIGNS)}] ELSE [] END)
    ELSE rule_reasons END AS reasons_list FROM E2)
SELECT msg_id, damping, rule_score, final_score, risk_score, risk_score >= {CFG.threshold} AS is_phishing,
  {ob.level('risk_score')} AS risk_level, {ob.advice('risk_score', 'reasons_list')} AS recommendation,
  CASE WHEN model_score IS NULL THEN '{CFG.rules_only_version}' ELSE '{CFG.version}' END AS scoring_version,
  array_to_string(reasons_list, ' | ') AS reasons FROM E3""")
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = mail_view(spark, sf_dir).select(
        "*", (tx.draw("ut", F.col("msg_id")) % 20 == 0).alias("user_trusted")
    )
    mail = mail.withColumn("model_score", F.when(F.col("msg_id") % 10 != 0, F.col("model_score")))
    return en.score_ensemble(mail).select(
        "msg_id", "damping", "rule_score", "final_score", "risk_score", "is_phishing", "risk_level",
        "recommendation", "scoring_version", F.array_join("indicators", " | ").alias("reasons"),
    )
