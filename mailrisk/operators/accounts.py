"""Accounts, rolling risk, alerts, dashboards and clean-up, computed for all users at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import domains as dm
from mailrisk.functions import text as tx
from mailrisk.operators import hot_groups as hg

HOUR = "hour"


def cents(score: Column) -> Column:
    """Score in hundredths, so that sums do not depend on the order of addition."""
    return F.round(score * 100).cast("bigint")


def day_start(as_of: Column) -> Column:
    return F.date_trunc("day", as_of)


def rolling_user_risk(emails: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Mean score of each user's ten most recent messages; each task keeps ten before the shuffle."""
    newest = W.partitionBy("user_id").orderBy(F.desc("scanned_at"), F.desc("email_id"))
    recent = (
        emails.select("user_id", "scanned_at", "email_id", "risk_score")
        .withColumn("_nth", F.row_number().over(newest))
        .filter(F.col("_nth") <= cfg.recent_window)
    )
    grouped = recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_recent"), F.sum(cents(F.col("risk_score"))).alias("_c")
    )
    mean = F.col("_c") / (F.col("n_recent") * 100)
    return grouped.select("user_id", "n_recent", tx.round_half_even_exact(mean).alias("risk_score"))


def risk_trajectory(emails: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """The rolling mean after every message."""
    rows = emails.select(
        "user_id", "scanned_at", "email_id", cents(F.col("risk_score")).alias("_c")
    )
    means = hg.trailing_mean(
        rows, ["user_id"], F.date_trunc(HOUR, F.col("scanned_at")), ["scanned_at", "email_id"], "_c",
        cfg.recent_window, "_mean",
    )
    return means.select("user_id", "email_id", tx.round_half_even_exact(F.col("_mean") / 100).alias("risk_score"))


STATES = 101  # the weighted risk is rounded to a whole number from 0 to 100 after every message


def step_tables(scores: np.ndarray) -> np.ndarray:
    """Row i: the state after message i for every state before it. A message without a score changes nothing."""
    before = np.arange(STATES)
    after = np.floor(before * 0.8 + scores[:, None] * 0.2 + 0.5)
    return np.where(np.isnan(scores)[:, None], before, after).astype("int16")


def fold_tables(group: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """One table per run of equal ``group`` numbers: its tables applied in order.

    Neighbours of a run are put together two by two, in all runs at once, until each run is one table.
    """
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.isin(left + 1, np.flatnonzero(place % 2))
        if not paired.any():
            return tables
        merged = tables[left]
        merged[paired] = np.take_along_axis(tables[left[paired] + 1], tables[left[paired]], axis=1)
        group, tables = group[left], merged


def weighted_runs(emails: DataFrame) -> DataFrame:
    """Runs of consecutive messages per user, each as a table "state before -> state after".

    The rounded state has 101 values, so any run of messages is such a table. Rows are
    range-partitioned by user and time, which cuts a heavy user into many runs; there is at most
    one run per user and partition. A batch folds all its users at once, in columns.
    """
    ordered = (
        emails.select("user_id", "scanned_at", "email_id", "risk_score")
        .repartitionByRange("user_id", "scanned_at", "email_id")
        .sortWithinPartitions("user_id", "scanned_at", "email_id")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last run, which the next batch may continue
        for batch in batches:
            if batch.empty:
                continue
            user = batch["user_id"]
            same = (user == user.shift()) | (user.isna() & user.shift().isna())
            same.iloc[0] = False
            group = (~same).cumsum().to_numpy()
            runs = batch[~same][["user_id", "scanned_at", "email_id"]].reset_index(drop=True)
            runs.columns = ["user_id", "first_at", "first_id"]
            runs["n"] = np.bincount(group)[1:]
            runs["after"] = list(fold_tables(group, step_tables(batch["risk_score"].to_numpy("float64"))).astype("int32"))
            if held is not None:
                before, after = held.iloc[0], runs.iloc[0]
                if before.user_id == after.user_id or (pd.isna(before.user_id) and pd.isna(after.user_id)):
                    held["n"] += after.n
                    held["after"] = [after.after[before.after]]
                    runs = runs.iloc[1:]
                runs = pd.concat([held, runs], ignore_index=True) if len(runs) else held
            yield runs.iloc[:-1]
            held = runs.iloc[-1:].reset_index(drop=True)
        if held is not None:
            yield held

    return ordered.mapInPandas(
        fold, "user_id bigint, first_at timestamp, first_id bigint, n bigint, after array<int>"
    )


def weighted_user_risk(emails: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Exponentially weighted risk per user, rounded after each message in arrival order.

    ``start`` (user_id, weighted_risk) continues from an earlier state; otherwise it is 0.
    """
    chained = weighted_runs(emails).groupBy("user_id").agg(
        F.sum("n").alias("n_messages"),
        F.array_sort(F.collect_list(F.struct("first_at", "first_id", "after"))).alias("_runs"),
    )
    begin = F.lit(0)
    if start is not None:
        chained = chained.join(start.select("user_id", F.col("weighted_risk").alias("_start")), "user_id", "left")
        begin = F.coalesce("_start", F.lit(0))
    final = F.aggregate("_runs", begin, lambda s, r: F.element_at(r["after"], s + 1))
    return chained.select("user_id", "n_messages", final.alias("weighted_risk"))


USER_STATE = "user_id bigint, total_scanned bigint, phishing_blocked bigint, weighted_risk int"


def advance_user_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Running totals, blocked messages and weighted risk after one more batch of verdicts."""
    counts = user_totals(batch).select(
        "user_id", F.col("total_scanned").alias("_n"), F.col("phishing_blocked").alias("_b")
    )
    risk = weighted_user_risk(batch, state).select("user_id", F.col("weighted_risk").alias("_w"))
    joined = state.join(counts.join(risk, "user_id"), "user_id", "full")
    zero = F.lit(0)
    return joined.select(
        "user_id",
        (F.coalesce("total_scanned", zero) + F.coalesce("_n", zero)).alias("total_scanned"),
        (F.coalesce("phishing_blocked", zero) + F.coalesce("_b", zero)).alias("phishing_blocked"),
        F.coalesce("_w", "weighted_risk").cast("int").alias("weighted_risk"),
    )


def first_flags(emails: DataFrame, keys: list[str]) -> DataFrame:
    """Messages on which the verdict of ``keys`` turns to phishing."""
    marked = hg.previous_value(
        emails, keys, F.date_trunc(HOUR, F.col("scanned_at")), ["scanned_at", "email_id"], "is_phishing", "_was"
    )
    return marked.filter(F.col("is_phishing") & ~F.coalesce("_was", F.lit(False))).drop("_was")


def score_text(score: Column) -> Column:
    """A score as it appears in an alert: shortest decimal, at least one digit after the point."""
    return score.cast("string")


def alert_rows(flagged: DataFrame, users: DataFrame, level: Column) -> DataFrame:
    """One alert for the user and, where there is one, one for the guardian naming the user."""
    people = users.select(F.col("user_id"), F.col("name").alias("_name"), "guardian_id")
    joined = flagged.withColumn("risk_level", level).join(people, "user_id", "left")
    own = F.struct(
        F.col("user_id").alias("user_id"), F.lit("user").alias("audience"),
        F.format_string(lx.ALERT_USER, F.col("sender")).alias("message"),
    )
    watching = F.struct(
        F.col("guardian_id").alias("user_id"), F.lit("guardian").alias("audience"),
        F.format_string(lx.ALERT_GUARDIAN, F.col("_name"), score_text(F.col("risk_score")), F.col("sender")).alias(
            "message"
        ),
    )
    both = F.when(F.col("guardian_id").isNull(), F.array(own)).otherwise(F.array(own, watching))
    return joined.select(
        "email_id", "risk_level", F.col("scanned_at").alias("created_at"), F.explode(both).alias("_a")
    ).select("_a.*", "email_id", "risk_level", "created_at")


def notifications(flagged: DataFrame, users: DataFrame, level: Column) -> DataFrame:
    """Mail to be sent to guardians: who, about whom, score, sender, subject, level."""
    person = users.select(
        "user_id", F.col("name").alias("monitored_name"), F.col("email").alias("monitored_email"), "guardian_id"
    )
    guardian = users.select(F.col("user_id").alias("guardian_id"), F.col("email").alias("guardian_email"))
    return (
        flagged.withColumn("risk_level", level)
        .join(person, "user_id")
        .join(guardian, "guardian_id")
        .select("guardian_email", "monitored_name", "monitored_email", "email_id", "risk_score", "sender",
                "subject", "risk_level")
    )


def today_counts(emails: DataFrame, as_of: Column) -> DataFrame:
    """Scans and phishing of the current day for every user with any."""
    today = F.col("scanned_at") >= day_start(as_of)
    return emails.filter(today).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scanned_today"), F.count_if("is_phishing").alias("blocked_today")
    )


def newest_alerts(alerts: DataFrame, by: str, n: int) -> DataFrame:
    """Newest ``n`` alerts per key as one array, newest first."""
    order = W.partitionBy(by).orderBy(F.desc("created_at"), F.desc("email_id"))
    kept = alerts.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n)
    listed = kept.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("_nth", "risk_level", "message", "created_at"))).alias("_list")
    )
    drop_order = F.transform("_list", lambda a: F.struct(a["risk_level"], a["message"], a["created_at"]))
    return listed.select(by, drop_order.alias("recent_alerts"))


def user_totals(emails: DataFrame) -> DataFrame:
    """Counters as aggregates: unique messages and blocked ones per user."""
    return emails.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_scanned"), F.count_if("is_phishing").alias("phishing_blocked")
    )


def user_dashboard(
    users: DataFrame, emails: DataFrame, alerts: DataFrame, as_of: Column, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Totals, rolling risk, activity of the day and the newest alerts of the day, for all users."""
    todays = alerts.filter(F.col("created_at") >= day_start(as_of))
    return (
        users.select("user_id")
        .join(user_totals(emails), "user_id", "left")
        .join(rolling_user_risk(emails, cfg).select("user_id", "risk_score"), "user_id", "left")
        .join(today_counts(emails, as_of), "user_id", "left")
        .join(newest_alerts(todays, "user_id", cfg.dashboard_alerts), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("total_scanned", F.lit(0)).alias("total_scanned"),
            F.coalesce("phishing_blocked", F.lit(0)).alias("phishing_blocked"),
            F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
            (F.coalesce("scanned_today", F.lit(0)) > 0).alias("daily_active"),
            F.coalesce(F.size("recent_alerts"), F.lit(0)).alias("n_recent_alerts"),
            "recent_alerts",
        )
    )


def setup_state(has_account: Column, total_scanned: Column) -> Column:
    return (
        F.when(~has_account, "needs_account").when(total_scanned == 0, "needs_extension").otherwise("active")
    )


def watched_accounts(users: DataFrame, emails: DataFrame, as_of: Column, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Every watched account with its setup state, risk, phishing of the day and last scan."""
    last = emails.groupBy("user_id").agg(F.max("scanned_at").alias("_last"))
    return (
        users.filter("guardian_id IS NOT NULL")
        .join(user_totals(emails), "user_id", "left")
        .join(rolling_user_risk(emails, cfg).select("user_id", "risk_score"), "user_id", "left")
        .join(today_counts(emails, as_of), "user_id", "left")
        .join(last, "user_id", "left")
        .select(
            "guardian_id", "user_id", "email", "name",
            setup_state(F.col("has_account"), F.coalesce("total_scanned", F.lit(0))).alias("state"),
            F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
            F.coalesce("total_scanned", F.lit(0)).alias("total_scanned"),
            F.coalesce("blocked_today", F.lit(0)).alias("blocked_today"),
            F.coalesce(F.date_format("_last", "dd/MM/yyyy HH:mm"), F.lit("")).alias("last_scan"),
        )
    )


def watched_list(watched: DataFrame) -> DataFrame:
    """Per guardian the addresses watched, in ascending order, with the state and risk of each; null addresses first.

    A guardian's list is in one row, as it is shown; accounts have one guardian each.
    """
    entry = F.array_sort(F.collect_list(F.struct("email", "user_id", "state", "risk_score")))
    of = lambda name: F.transform(F.col("entries"), lambda e: e[name]).alias(f"{name}s")
    return watched.groupBy("guardian_id").agg(entry.alias("entries")).select("guardian_id", of("email"), of("state"), of("risk_score"))


def guardian_dashboard(
    users: DataFrame, emails: DataFrame, alerts: DataFrame, as_of: Column, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Per account: its most active watched account and the newest alerts about watched mail.

    Accounts that watch nobody get the empty row.
    """
    children = users.filter("guardian_id IS NOT NULL").select("guardian_id", "user_id", "name", "email")
    counted = children.join(user_totals(emails).select("user_id", "total_scanned"), "user_id", "left").fillna(
        0, ["total_scanned"]
    )
    top = counted.groupBy("guardian_id").agg(
        F.max_by(F.struct("user_id", "name", "email"), F.struct("total_scanned", -F.col("user_id"))).alias("c")
    )
    child = top.select("guardian_id", F.col("c.user_id").alias("user_id"), "c.name", "c.email")
    facts = (
        child.join(rolling_user_risk(emails, cfg).select("user_id", "risk_score"), "user_id", "left")
        .join(today_counts(emails, as_of).select("user_id", "blocked_today"), "user_id", "left")
        .withColumnRenamed("user_id", "child_id")
    )
    watched_mail = emails.select("email_id", F.col("user_id").alias("_owner")).join(
        children.select(F.col("user_id").alias("_owner"), F.col("guardian_id").alias("_watcher")), "_owner"
    )
    about = alerts.join(
        watched_mail,
        (alerts["email_id"] == watched_mail["email_id"]) & (alerts["user_id"] == F.col("_watcher")),
        "left_semi",
    )
    listed = newest_alerts(about, "user_id", cfg.alert_history).withColumnRenamed("user_id", "guardian_id")
    return (
        users.select(F.col("user_id").alias("guardian_id"))
        .join(facts, "guardian_id", "left")
        .join(listed, "guardian_id", "left")
        .select(
            "guardian_id",
            tx.text_or_empty(F.col("name")).alias("child_name"),
            tx.text_or_empty(F.col("email")).alias("child_email"),
            F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
            F.coalesce("blocked_today", F.lit(0)).alias("blocked_today"),
            "recent_alerts",
        )
    )


def system_kpis(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Messages, phishing, users, active users and their percentage, in one row."""
    mail = emails.agg(
        F.count(F.lit(1)).alias("total_emails"), F.count_if("is_phishing").alias("phishing_blocked")
    )
    people = users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if("daily_active").alias("active_users"))
    share = F.col("active_users") / F.col("total_users") * 100
    # Two one-row aggregates side by side.
    return mail.join(F.broadcast(people)).select(
        "*",
        F.when(F.col("total_users") > 0, F.format_string("%.1f%%", share)).otherwise("0.0%").alias("active_share"),
    )


def orphan_accounts(users: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accounts nobody registered and that guard nobody; named addresses are kept."""
    guardians = users.filter("guardian_id IS NOT NULL").select(F.col("guardian_id").alias("user_id")).distinct()
    loose = users.filter(~F.col("has_account")).join(guardians, "user_id", "left_anti")
    if keep:
        loose = loose.filter(~F.lower("email").isin([k.strip().lower() for k in keep]))
    return loose


def named_accounts(users: DataFrame, emails: list[str]) -> DataFrame:
    return users.filter(F.lower("email").isin([e.strip().lower() for e in emails]))


def deletion_preview(targets: DataFrame, emails: DataFrame) -> DataFrame:
    """Scan records that would go with each account."""
    counts = emails.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_scans"))
    return targets.select("user_id", "email").join(counts, "user_id", "left").fillna(0, ["n_scans"])


def delete_accounts(
    targets: DataFrame, users: DataFrame, *dependants: DataFrame
) -> tuple[DataFrame, ...]:
    """The tables without the accounts and everything that belongs to them."""
    gone = targets.select("user_id")
    return tuple(t.join(gone, "user_id", "left_anti") for t in (users, *dependants))


def missing_users(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts to create for addresses seen for the first time."""
    seen = messages.select(F.col("user_email").alias("email")).distinct()
    return seen.join(users.select("email"), "email", "left_anti").select(
        "email", dm.display_name(F.col("email")).alias("name"), F.lit(False).alias("has_account")
    )


def link_guardians(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per watched address of connect requests (guardian_id, child_email, requested_at).

    Nobody may watch themselves; the last valid request wins; unknown addresses become accounts.
    """
    guardian = users.select(F.col("user_id").alias("guardian_id"), F.col("email").alias("_own"))
    valid = requests.join(guardian, "guardian_id").filter(F.col("_own") != F.col("child_email"))
    last = valid.groupBy("child_email").agg(
        F.max_by("guardian_id", F.struct("requested_at", "guardian_id")).alias("new_guardian")
    )
    child = users.select(
        F.col("email").alias("child_email"), F.col("user_id").alias("child_id"), F.col("guardian_id").alias("_old"),
    )
    linked = last.join(child, "child_email", "left")
    return linked.select(
        "child_email", "child_id", "new_guardian",
        F.coalesce(F.col("_old") == F.col("new_guardian"), F.lit(False)).alias("already_linked"),
        F.col("child_id").isNull().alias("created"),
    )


def unlink_guardians(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of unlink requests (requester_id, child_email): removed, no_link or forbidden."""
    child = users.select(
        F.col("email").alias("child_email"), F.col("user_id").alias("child_id"), "guardian_id"
    )
    joined = requests.join(child, "child_email", "left")
    allowed = (F.col("requester_id") == F.col("guardian_id")) | (F.col("requester_id") == F.col("child_id"))
    return joined.select(
        "requester_id", "child_email",
        F.when(F.col("guardian_id").isNull(), "no_link").when(allowed, "removed").otherwise("forbidden").alias("outcome"),
    )
