"""The verdict store: which messages of a batch are scored, and the store after the batch.

A message is identified by (user, sender, first 200 characters of the subject). A stored verdict
is reused when its version still counts and the new text is the same or shorter than the stored
one; otherwise the message is scored and replaces it.

Within a batch the text in force before a message is the longest seen so far (capped at the stored
length), so the one-by-one process is a running maximum and two look-backs. These run over hourly
slices of a key, because one key may hold a large part of a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import text as tx
from mailrisk.functions import verdicts as vd
from mailrisk.operators import hot_groups as hg
from mailrisk.session import materialise

STORE_SCHEMA = (
    "msg_key string, email_id bigint, user_id bigint, sender string, subject string, content string, "
    "scanned_at timestamp, risk_score double, is_phishing boolean, scoring_version string, "
    "content_hash string, indicators array<string>"
)


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE_SCHEMA)


def message_key(cfg: ScoringConfig = DEFAULT) -> Column:
    subject = F.substring(tx.text_or_empty(F.col("subject")), 1, cfg.subject_chars)
    return F.md5(F.concat_ws("\n", F.col("user_id").cast("string"), tx.text_or_empty(F.col("sender")), subject))


def plan_scans(
    stored: DataFrame, batch: DataFrame, model_ready: bool, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Per message of the batch: its key, and whether it has to be scored.

    ``batch`` needs msg_id, user_id, sender, subject, content, scanned_at. The result holds hashes
    and lengths only; no text travels through the look-backs.
    """
    content = tx.text_or_empty(F.col("content"))
    rows = batch.select(
        "msg_id", "scanned_at", message_key(cfg).alias("msg_key"),
        tx.fingerprint(content).alias("content_hash"),
        F.least(F.length(content), F.lit(cfg.content_chars)).alias("kept_chars"),
    )
    rows = materialise(rows, "scan-rows")
    # Only stored verdicts of the batch's keys go on: one row per key on both sides, so no key is hot here.
    before = stored.join(rows.select("msg_key").distinct(), "msg_key", "left_semi").select(
        "msg_key",
        F.col("content_hash").alias("old_hash"),
        F.length("content").alias("old_chars"),
        vd.is_reusable(F.col("scoring_version"), model_ready, cfg).alias("old_counts"),
    )
    order = ["scanned_at", "msg_id"]
    hour = F.date_trunc("hour", F.col("scanned_at"))
    peaks = hg.running_max_before(rows, ["msg_key"], hour, order, "kept_chars", "_batch_peak")
    # Rows of a hot key are spread over salted partitions; the few stored rows they meet are repeated for that.
    joined = hg.salted_left_join(peaks, before, ["msg_key"], "msg_id")
    in_force = F.greatest("_batch_peak", F.when(F.col("old_counts"), F.col("old_chars")))
    judged = materialise(
        joined.withColumn("_fuller", F.coalesce(F.col("kept_chars") >= in_force, F.lit(True))), "scan-judged"
    )
    fuller = hg.previous_value(
        judged.filter("_fuller"), ["msg_key"], hour, order, "content_hash", "_previous_hash"
    )
    known = F.coalesce(F.col("_previous_hash"), F.when(F.col("old_counts"), F.col("old_hash")))
    scored = F.coalesce(F.col("content_hash") != known, F.lit(True))
    decided = fuller.select("msg_id", "msg_key", "scanned_at", "content_hash", scored.alias("scored"))
    reused = judged.filter("NOT _fuller").select(
        "msg_id", "msg_key", "scanned_at", "content_hash", F.lit(False).alias("scored")
    )
    return materialise(decided.unionByName(reused), "scan-plan")


def apply_scans(
    stored: DataFrame, batch: DataFrame, plan: DataFrame, cfg: ScoringConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """The store after the batch, and the messages newly flagged as phishing.

    ``batch`` carries the verdict columns of every message the plan marks as scored.
    """
    due = plan.filter("scored").select("msg_id", "msg_key", "content_hash")
    # Cut before they meet their keys: no whole text is shuffled for it.
    cut = batch.select(
        "msg_id", "user_id", "sender",
        F.substring("subject", 1, cfg.subject_chars).alias("subject"),
        F.substring("content", 1, cfg.content_chars).alias("content"),
        "scanned_at", "risk_score", "is_phishing", "scoring_version", "indicators",
    )
    fresh = materialise(cut.join(due, "msg_id"), "scan-fresh")
    order = F.struct("scanned_at", "msg_id")
    folded = fresh.groupBy("msg_key").agg(
        F.max_by(F.struct(*[c for c in fresh.columns if c != "msg_key"]), order).alias("new"),
        F.min_by(F.struct("msg_id", "scanned_at"), order).alias("first"),
    )
    old = stored.select("msg_key", F.struct(*[c for c in stored.columns if c != "msg_key"]).alias("old"))
    both = old.join(folded, "msg_key", "full")

    def newest(name: str) -> Column:
        return F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    after = both.select(
        "msg_key",
        F.coalesce("old.email_id", "first.msg_id").alias("email_id"),
        *[newest(c).alias(c) for c in ("user_id", "sender", "subject", "content")],
        F.coalesce("old.scanned_at", "first.scanned_at").alias("scanned_at"),
        *[newest(c).alias(c) for c in
          ("risk_score", "is_phishing", "scoring_version", "content_hash", "indicators")],
    )
    steps = hg.previous_value(
        fresh.select("msg_key", "msg_id", "scanned_at", "is_phishing"), ["msg_key"],
        F.date_trunc("hour", F.col("scanned_at")), ["scanned_at", "msg_id"], "is_phishing", "_was",
    )
    earlier = stored.join(fresh.select("msg_key").distinct(), "msg_key", "left_semi").select(
        "msg_key", F.col("is_phishing").alias("_stored")
    )
    known = hg.salted_left_join(steps, earlier, ["msg_key"], "msg_id")
    was = F.coalesce("_was", "_stored", F.lit(False))
    flagged = known.filter(F.col("is_phishing") & ~was).select("msg_id", "msg_key")
    return after, flagged


def rules_backlog(stored: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Verdicts given without a model, to be scored again now that there is one."""
    return stored.filter(F.endswith(F.col("scoring_version"), F.lit("|rules")))


def evolve(table: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add columns a stored table predates, with their defaults."""
    for name, value in defaults.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(value))
    return table
