"""Rule scoring of mail: nine checks, their points and their reasons.

Input needs ``sender``, ``subject`` and ``content``. Everything is a narrow projection without a
shuffle. Lowered texts and links are computed once; the terms of all lists are found in one pass.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import domains as dm
from mailrisk.functions import text as tx
from mailrisk.functions import verdicts as vd
from mailrisk.functions.terms import with_hits

_PREPARED = ["_full", "_subject", "_content", "_sender", "_domain", "_urls", "_hebrew", "_hosts",
             "_trusted", "_hits"]
POINTS = ["p_strong", "p_weak", "p_lookalike", "p_links", "p_urgency", "p_suffix", "p_brand", "p_ip",
          "p_shortener", "p_official"]


def word_pattern(name: str) -> str:
    """Whole-word pattern that reads the same in Java and RE2, for Hebrew as well."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(^|{edge}){re.escape(name)}($|{edge})"


def prepare(df: DataFrame) -> DataFrame:
    """Add the lowered texts, links, hosts, sender facts and term hits every check reads."""
    sender, subject, content = (tx.text_or_empty(F.col(c)) for c in ("sender", "subject", "content"))
    base = df.select(
        "*",
        F.lower(F.concat_ws(" ", sender, subject, content)).alias("_full"),
        F.lower(subject).alias("_subject"),
        F.lower(content).alias("_content"),
        F.lower(sender).alias("_sender"),
        dm.sender_domain(sender).alias("_domain"),
        tx.urls_in(content).alias("_urls"),
    )
    facts = base.select(
        "*",
        tx.has_hebrew(F.col("_full")).alias("_hebrew"),
        F.transform("_urls", dm.url_host).alias("_hosts"),
        dm.trusted_company(F.col("_domain")).alias("_trusted"),
    )
    return with_hits(facts)


def drop_prepared(df: DataFrame) -> DataFrame:
    return df.drop(*_PREPARED)


def _brand_table() -> Column:
    """The brand dimension as one constant array; its size is fixed by the rule set."""
    rows = [
        {
            "id": i,
            "name": name,
            "pattern": word_pattern(name),
            "officials": officials,
            "ambiguous": name in lx.AMBIGUOUS_BRANDS,
            "letters": re.sub(r"[^a-z0-9]+", "", name.lower()),
        }
        for i, (name, officials) in enumerate(lx.BRANDS.items())
    ]
    schema = (
        "array<struct<id int, name string, pattern string, officials array<string>, "
        "ambiguous boolean, letters string>>"
    )
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _deciding_brand(text: Column, mentioned: Column, body: bool) -> Column:
    """First brand, in list order, that settles the question; ``exempt`` says "not posing"."""

    def named(b: Column) -> Column:
        return F.array_contains(mentioned, b["id"]) & F.rlike(text, b["pattern"])

    def claimed(b: Column) -> Column:
        return (b["letters"] != "") & F.exists(
            "_carriers",
            lambda c: F.contains(c["letters"], b["letters"])
            & ~F.arrays_overlap(c["suffixes"], b["officials"]),
        )

    def judge(b: Column) -> Column:
        official = F.arrays_overlap(F.col("_domain_suffixes"), b["officials"])
        plain_word = ~official & b["ambiguous"] & ~claimed(b)
        exempt = official
        if body:
            exempt = exempt | F.arrays_overlap(F.col("_link_suffixes"), b["officials"])
        return F.struct(b["name"].alias("name"), exempt.alias("exempt"), plain_word.alias("skip"))

    judged = F.transform(F.filter(_brand_table(), named), judge)
    return F.when(F.size(mentioned) > 0, F.get(F.filter(judged, lambda d: ~d["skip"]), F.lit(0)))


def with_impersonation(df: DataFrame) -> DataFrame:
    """Add ``brand`` and ``brand_where`` (subject/body) for mail that poses as a known brand.

    The body is read only when the subject settled nothing and there is a link.
    """
    eligible = (F.col("_domain") != "") & ~F.col("_trusted")
    carriers = F.transform(
        F.concat(F.array("_domain"), F.col("_hosts")),
        lambda h: F.struct(
            F.regexp_replace(h, "[^a-z0-9]+", "").alias("letters"), dm.suffixes(h).alias("suffixes")
        ),
    )
    facts = df.select(
        "*",
        F.when(eligible, carriers).alias("_carriers"),
        F.when(eligible, dm.suffixes(F.col("_domain"))).alias("_domain_suffixes"),
        F.when(eligible, F.flatten(F.transform("_hosts", dm.suffixes))).alias("_link_suffixes"),
    )
    by_subject = facts.select(
        "*", F.when(eligible, _deciding_brand(F.col("_subject"), F.col("_hits.brands_subject"), body=False)).alias("_s")
    )
    undecided = eligible & F.col("_s").isNull() & (F.size("_urls") > 0)
    both = by_subject.select(
        "*", F.when(undecided, _deciding_brand(F.col("_content"), F.col("_hits.brands_content"), body=True)).alias("_b")
    )
    posing = F.coalesce("_s", "_b")
    hit = posing.isNotNull() & ~posing["exempt"]
    return both.select(
        *df.columns,
        F.when(hit, posing["name"]).alias("brand"),
        F.when(hit, F.when(F.col("_s").isNotNull(), "subject").otherwise("body")).alias("brand_where"),
    )


def with_checks(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Points of each check and the two term counts, on a prepared frame with brands."""
    content, sender = F.col("_content"), F.col("_sender")
    counted = df.select("*", "_hits.n_strong", "_hits.n_weak", F.size("_urls").alias("n_urls"))

    def points(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    mailbox_domain = F.when(
        F.contains(sender, F.lit("@")), F.substring_index(sender, "@", -1)
    ).otherwise("")
    return counted.select(
        "*",
        F.least(F.col("n_strong") * cfg.strong_points, F.lit(cfg.strong_cap)).alias("p_strong"),
        F.least(F.col("n_weak") * cfg.weak_points, F.lit(cfg.weak_cap)).alias("p_weak"),
        points(tx.any_term(sender, lx.LOOKALIKE_PATTERNS), cfg.lookalike_points).alias("p_lookalike"),
        points(F.col("n_urls") > cfg.many_links_over, cfg.many_links_points).alias("p_links"),
        points(F.col("_hits.urgent"), cfg.urgency_points).alias("p_urgency"),
        points(
            F.contains(sender, F.lit("@")) & ~tx.any_term(sender, lx.ACCEPTED_SUFFIXES),
            cfg.odd_suffix_points,
        ).alias("p_suffix"),
        F.when(F.col("brand_where") == "subject", cfg.impersonation_subject_points)
        .when(F.col("brand_where") == "body", cfg.impersonation_body_points)
        .otherwise(0)
        .alias("p_brand"),
        points(
            (F.col("n_urls") > 0) & content.rlike(tx.IP_LINK_PATTERN), cfg.ip_link_points
        ).alias("p_ip"),
        points(F.col("_hits.shortener"), cfg.shortener_points).alias("p_shortener"),
        points(
            F.col("_hits.official") & tx.any_term(mailbox_domain, lx.FREE_MAIL),
            cfg.official_on_free_points,
        ).alias("p_official"),
    )


def _reasons() -> Column:
    """Reasons in display order; a single line when nothing was found."""

    def fmt(template: str, *args: Column) -> Column:
        return F.format_string(template, *args)

    lines = [
        F.when(F.col("n_strong") > 0, fmt(lx.REASON_STRONG, F.col("n_strong"))),
        F.when((F.col("n_weak") > 0) & (F.col("n_strong") == 0), fmt(lx.REASON_WEAK, F.col("n_weak"))),
        F.when(F.col("p_lookalike") > 0, F.lit(lx.REASON_LOOKALIKE)),
        F.when(F.col("p_links") > 0, fmt(lx.REASON_LINKS, F.col("n_urls"))),
        F.when(F.col("p_urgency") > 0, F.lit(lx.REASON_URGENCY)),
        F.when(F.col("p_suffix") > 0, F.lit(lx.REASON_SUFFIX)),
        F.when(F.col("p_brand") > 0, fmt(lx.REASON_BRAND, F.col("brand"), F.col("_domain"))),
        F.when(F.col("p_ip") > 0, F.lit(lx.REASON_IP)),
        F.when(F.col("p_shortener") > 0, F.lit(lx.REASON_SHORTENER)),
        F.when(F.col("p_official") > 0, F.lit(lx.REASON_OFFICIAL)),
    ]
    found = F.array_compact(F.array(*lines))
    return F.when(F.size(found) == 0, F.array(F.lit(lx.NOTHING_FOUND))).otherwise(found)


def score_prepared(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Rule score, points and reasons on a prepared frame; the prepared columns stay."""
    checked = with_checks(with_impersonation(df), cfg)
    total = reduce(lambda a, b: a + b, [F.col(p) for p in POINTS])
    return checked.select(
        "*",
        F.least(total, F.lit(100)).alias("rule_score"),
        _reasons().alias("rule_indicators"),
    )


def score_mail(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Rules-only verdict for every message."""
    scored = drop_prepared(score_prepared(prepare(df), cfg))
    return scored.select(
        "*",
        vd.is_phishing(F.col("rule_score"), cfg).alias("is_phishing"),
        vd.risk_level(F.col("rule_score"), cfg).alias("risk_level"),
        vd.recommendation(F.col("rule_score"), F.col("rule_indicators"), cfg).alias("recommendation"),
    )


def with_legitimacy(df: DataFrame, strict_organisation: bool = False) -> DataFrame:
    """Flags ``asks_credentials``, ``promotional``, ``trusted_sender``, ``transactional``.

    Works on a prepared frame. A transactional message comes from a known company, uses order
    vocabulary, asks for nothing, and every link stays with the sender or a known company.
    """
    stays = F.forall(
        "_hosts",
        lambda h: (h == "")
        | (h == F.col("_domain"))
        | F.endswith(h, F.concat(F.lit("."), F.col("_domain")))
        | dm.same_organisation(h, F.col("_domain"), strict_organisation)
        | dm.belongs_to_any(h, dm.OFFICIAL_DOMAINS),
    )
    asks = F.col("_hits.attack")
    return df.select(
        "*",
        asks.alias("asks_credentials"),
        (F.col("_hits.promo") & ~asks).alias("promotional"),
        F.col("_trusted").alias("trusted_sender"),
        (F.col("_trusted") & F.col("_hits.order_words") & ~asks & stays).alias("transactional"),
    )
