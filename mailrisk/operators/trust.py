"""Personal lists of known senders: normalising, matching, evidence, requests, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import domains as dm
from mailrisk.functions import text as tx
from mailrisk.operators import hot_groups as hg
from mailrisk.operators import mail_rules as mr
from mailrisk.session import materialise

EMAIL_SHAPE = r"^[^@\s]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
DOMAIN_SHAPE = r"^[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


def normalise_entry(raw: Column) -> Column:
    """struct(value, is_domain, error): an address, a domain, or why it is neither."""
    value = F.regexp_replace(F.lower(tx.strip_space(raw)), "^@+", "")
    has_at = F.contains(value, F.lit("@"))
    error = (
        F.when(value == "", "empty")
        .when(has_at & ~value.rlike(EMAIL_SHAPE), "bad_address")
        .when(has_at, None)
        .when(~value.rlike(DOMAIN_SHAPE), "bad_domain")
        .when(value.isin(lx.FREE_MAIL), "free_provider")
    )
    return F.struct(value.alias("value"), (~has_at & (value != "")).alias("is_domain"), error.alias("error"))


def trusted_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The (user_id, sender) pairs the user's list covers: two equality joins, no OR.

    ``pairs`` should be distinct, so that a sender who writes a lot is matched once.
    """
    address = F.lower(tx.strip_space(F.col("sender")))
    by_address = pairs.select("user_id", "sender", address.alias("value")).join(
        entries.filter("NOT is_domain").select("user_id", "value"), ["user_id", "value"], "left_semi"
    )
    parents = F.explode(F.filter(dm.suffixes(dm.sender_domain(address)), lambda d: d != ""))
    by_domain = pairs.select("user_id", "sender", parents.alias("value")).join(
        entries.filter("is_domain").select("user_id", "value"), ["user_id", "value"], "left_semi"
    )
    return by_address.unionByName(by_domain).select("user_id", "sender").distinct()


def with_user_trust(messages: DataFrame, entries: DataFrame, row_id: str = "msg_id") -> DataFrame:
    """Add ``user_trusted``. Pairs are folded first; a hot pair's messages are joined salted."""
    pairs = messages.select("user_id", "sender").distinct()
    covered = trusted_pairs(pairs, entries).withColumn("user_trusted", F.lit(True))
    joined = hg.salted_left_join(messages, covered, ["user_id", "sender"], row_id)
    return joined.withColumn("user_trusted", F.coalesce("user_trusted", F.lit(False)))


def sender_like(sender: Column, value: Column, is_domain: Column) -> Column:
    """The stored-mail match in its original form: case-insensitive, ``_`` and ``%`` as wildcards."""
    pattern = F.when(is_domain, F.concat(F.lit("%@"), value)).otherwise(
        F.concat(F.lit("%"), value, F.lit("%"))
    )
    return F.ilike(sender, pattern)


def _domain_heads(sender: Column, longest: Column) -> Column:
    """Starts, of at most ``longest`` characters, of what follows each ``@``: the domain of a listed address is one."""
    rights = F.transform(
        F.slice(F.split(sender, "@"), F.lit(2), F.size(F.split(sender, "@"))),
        lambda p: F.regexp_extract(p, r"^([a-z0-9.\-]*)", 1),
    )
    heads = F.transform(
        F.filter(rights, lambda r: r != ""),
        lambda r: F.transform(F.sequence(F.lit(1), F.least(F.length(r), longest)), lambda k: F.substring(r, F.lit(1), k)),
    )
    return F.array_distinct(F.flatten(heads))


def matched_senders(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, value, is_domain, sender): stored senders a list entry covers.

    A domain equals what follows the last ``@``. An address is contained in the sender: its domain starts what
    follows some ``@`` of the sender, which is an equality join, and the whole is compared where that
    holds. A sender has as many such starts as characters, but no longer ones than the longest listed domain.
    """
    lowered = pairs.select("user_id", "sender", F.lower("sender").alias("_s")).filter(F.contains("_s", F.lit("@")))
    wanted = entries.select("user_id", "value", "is_domain").distinct()
    by_domain = lowered.select("user_id", "sender", F.substring_index("_s", "@", -1).alias("value")).join(
        wanted.filter("is_domain"), ["user_id", "value"]
    )
    addresses = wanted.filter(~F.col("is_domain")).withColumn("_head", F.substring_index("value", "@", -1))
    longest = F.broadcast(addresses.agg(F.max(F.length("_head")).alias("_longest")))  # one row
    wild = F.col("value").rlike("[_%]")
    holds = F.when(wild, sender_like(F.col("sender"), F.col("value"), F.col("is_domain"))).otherwise(
        F.contains("_s", F.col("value"))
    )
    by_address = (
        lowered.crossJoin(longest.filter("_longest IS NOT NULL"))
        .select("user_id", "sender", "_s", F.explode(_domain_heads(F.col("_s"), F.col("_longest"))).alias("_head"))
        .join(addresses, ["user_id", "_head"])
        .filter(holds)
    )
    columns = ["user_id", "value", "is_domain", "sender"]
    return by_domain.select(columns).unionByName(by_address.select(columns).distinct())


def rule_evidence(emails: DataFrame, entries: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Worst rule score among the 50 newest stored messages of each entry's senders.

    Ids and dates are ranked first, each task passing on 50 per entry; texts are fetched for the messages that
    remain, and each of them is scored once, from its stored text, however many entries name it.
    """
    pairs = emails.select("user_id", "sender").distinct()
    hits = matched_senders(pairs, entries)
    found = emails.select("user_id", "sender", "scanned_at", "email_id").join(hits, ["user_id", "sender"])
    newest = W.partitionBy("user_id", "value").orderBy(F.desc("scanned_at"), F.desc("email_id"))
    recent = found.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= cfg.trust_evidence_window)
    recent = materialise(recent.select("user_id", "value", "is_domain", "email_id", "_nth"), "trust-recent")
    needed = emails.join(recent.select("email_id").distinct(), "email_id", "left_semi")
    scored = mr.score_mail(needed, cfg).select("email_id", "rule_score", "rule_indicators")
    worst = F.max_by("rule_indicators", F.struct("rule_score", -F.col("_nth")))
    return recent.join(scored, "email_id").groupBy("user_id", "value", "is_domain").agg(
        F.max("rule_score").alias("evidence"),
        F.when(F.max("rule_score") > 0, worst).otherwise(F.array().cast("array<string>")).alias("signs"),
        F.count(F.lit(1)).alias("n_examined"),
    )


def add_entries(
    requests: DataFrame, entries: DataFrame, emails: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Outcome per requested value: added, unchanged, full, evidence, or the normalising error.

    Requests carry user_id, raw, requested_at. One row per user and normalised value; the list
    grows in order of the first request until it is full.
    """
    parsed = requests.select("user_id", "requested_at", "raw", normalise_entry(F.col("raw")).alias("n")).select(
        "user_id", "requested_at", "raw", "n.*"
    )
    parsed = materialise(parsed, "trust-requests")
    valid = parsed.filter("error IS NULL").groupBy("user_id", "value", "is_domain").agg(
        F.min("requested_at").alias("first_at")
    )
    evidence = rule_evidence(emails, valid, cfg).select("user_id", "value", "evidence", "signs")
    existing = entries.select("user_id", "value").withColumn("_listed", F.lit(True))
    sizes = entries.groupBy("user_id").agg(F.count(F.lit(1)).alias("_size"))
    judged = (
        valid.join(evidence, ["user_id", "value"], "left")
        .join(existing, ["user_id", "value"], "left")
        .join(sizes, "user_id", "left")
        .withColumn("_size", F.coalesce("_size", F.lit(0)))
        .withColumn("_refused", F.coalesce(F.col("evidence") >= cfg.trust_refusal_score, F.lit(False)))
        .withColumn("_new", ~F.coalesce("_listed", F.lit(False)))
    )
    judged = materialise(judged, "trust-judged")
    line = W.partitionBy("user_id").orderBy("first_at", "value")
    fits = (
        judged.filter("_new AND NOT _refused")
        .withColumn("_pos", F.row_number().over(line))
        .filter(F.col("_pos") <= cfg.trust_list_cap)
        .select("user_id", "value", (F.col("_size") + F.col("_pos") <= cfg.trust_list_cap).alias("_fits"))
    )
    outcome = (
        F.when(F.col("_size") >= cfg.trust_list_cap, "full")
        .when(F.col("_refused"), "evidence")
        .when(~F.col("_new"), "unchanged")
        .when(F.coalesce("_fits", F.lit(False)), "added")
        .otherwise("full")
    )
    decided = judged.join(fits, ["user_id", "value"], "left").select(
        "user_id", "value", "is_domain", outcome.alias("outcome"), F.coalesce("evidence", F.lit(0)).alias("evidence"),
        "first_at",
    )
    broken = parsed.filter("error IS NOT NULL").groupBy("user_id", "value", "is_domain", F.col("error").alias("outcome")).agg(
        F.lit(0).alias("evidence"), F.min("requested_at").alias("first_at")
    )
    return decided.unionByName(broken)


def apply_additions(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The lists with what was added; entries that carry ``added_at`` keep it, new ones get their request's."""
    columns = [c for c in ("user_id", "value", "is_domain", "added_at") if c in entries.columns]
    added = outcomes.filter("outcome = 'added'").withColumnRenamed("first_at", "added_at").select(*columns)
    return entries.select(*columns).unionByName(added)


def newest_first(entries: DataFrame) -> DataFrame:
    """Per user the list of known senders, newest entry first; ties by the entry. At most the cap of a list."""
    entry = F.struct((-F.col("added_at")).alias("age"), "value", "is_domain", "added_at")
    listed = F.array_sort(F.collect_list(entry))
    return entries.groupBy("user_id").agg(
        F.transform(listed, lambda e: e["value"]).alias("values"),
        F.transform(listed, lambda e: e["added_at"]).alias("added_at"),
    )


def remove_entries(entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists after removal, and per request whether there was something to remove."""
    asked = requests.select("user_id", normalise_entry(F.col("raw")).alias("n")).select("user_id", "n.value").distinct()
    left = entries.join(asked, ["user_id", "value"], "left_anti")
    listed = entries.select("user_id", "value").withColumn("_there", F.lit(True))
    outcome = asked.join(listed, ["user_id", "value"], "left").select(
        "user_id", "value", F.when(F.col("_there"), "removed").otherwise("not_listed").alias("outcome")
    )
    return left, outcome


def remove_and_invalidate(
    entries: DataFrame, requests: DataFrame, emails: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``remove_entries``, and the stored mail with the version cleared where a removed entry had covered the sender."""
    left, outcome = remove_entries(entries, requests)
    removed = outcome.filter("outcome = 'removed'").join(entries.select("user_id", "value", "is_domain"), ["user_id", "value"])
    cleared, _ = invalidate(emails, removed.select("user_id", "value", "is_domain"))
    return left, outcome, cleared


def invalidate(emails: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear the version of stored verdicts the entries touch; and how many each entry touched."""
    pairs = emails.select("user_id", "sender").distinct()
    hits = matched_senders(pairs, entries)
    touched = hits.select("user_id", "sender").distinct().withColumn("_hit", F.lit(True))
    cleared = hg.salted_left_join(emails, touched, ["user_id", "sender"], "email_id").withColumn(
        "scoring_version", F.when(F.col("_hit"), "").otherwise(F.col("scoring_version"))
    ).drop("_hit")
    per_pair = emails.groupBy("user_id", "sender").agg(F.count(F.lit(1)).alias("_n"))
    counts = hits.join(per_pair, ["user_id", "sender"]).groupBy("user_id", "value").agg(
        F.sum("_n").alias("n_rescored")
    )
    return cleared, counts
