"""Registered queries on accounts, alerts and dashboards, each with its SQL.

The event log stands for the scan log (value as score), customers for accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import verdicts as vd
from mailrisk.functions.text import draw
from mailrisk.operators import accounts as ac
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.registry import register

AS_OF = "2024-01-30 23:59:59"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    return c.select(
        key.alias("user_id"),
        F.lower(F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.org"))).alias("email"),
        F.col("c_name").alias("name"),
        (key % 4 != 0).alias("has_account"),
        F.when((key % 3 == 1) & (key > 10), key % 11).alias("guardian_id"),
        (F.col("c_acctbal") > 0).alias("daily_active"),
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value")))
    return e.select(
        F.col("event_id").alias("email_id"), "user_id", F.col("ts").alias("scanned_at"),
        F.concat("event_type", F.lit("@mail.example.org")).alias("sender"), F.col("props").alias("subject"),
        score.alias("risk_score"), (score >= CFG.threshold).alias("is_phishing"),
    )


BASE = f"""
U AS (SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.') || '@example.org') AS email, c_name AS name,
  c_custkey % 4 <> 0 AS has_account, CASE WHEN c_custkey % 3 = 1 AND c_custkey > 10 THEN c_custkey % 11 END AS guardian_id,
  c_acctbal > 0 AS daily_active FROM customer),
E AS (SELECT event_id AS email_id, user_id, ts AS scanned_at, event_type || '@mail.example.org' AS sender, props AS subject,
  greatest(0e0, least(1e2, "value")) AS risk_score, greatest(0e0, least(1e2, "value")) >= {CFG.threshold} AS is_phishing FROM events),
RR AS (SELECT user_id, count(*) AS n_recent, {ob.py_round('(sum(round(risk_score * 100)::BIGINT)::BIGINT / (count(*) * 100)::DOUBLE)')} AS risk_score
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scanned_at DESC, email_id DESC) AS nth FROM E) WHERE nth <= 10 GROUP BY user_id),
FF AS (SELECT * FROM (SELECT *, lag(is_phishing) OVER (PARTITION BY user_id, sender ORDER BY scanned_at, email_id) AS was FROM E)
  WHERE is_phishing AND NOT coalesce(was, false)),
AL0 AS (SELECT FF.*, {ob.level('risk_score')} AS risk_level, U.name, U.guardian_id FROM FF LEFT JOIN U USING (user_id)),
AL AS (
  SELECT user_id, 'user' AS audience, replace({ob.q(lx.ALERT_USER)}, '%s', sender) AS message, email_id, risk_level, scanned_at AS created_at FROM AL0
  UNION ALL
  SELECT guardian_id, 'guardian', name || regexp_replace(regexp_replace({ob.q(lx.ALERT_GUARDIAN[2:])}, '%s%%', risk_score::VARCHAR || '%'), '%s', sender), email_id, risk_level, scanned_at
  FROM AL0 WHERE guardian_id IS NOT NULL),
TD AS (SELECT user_id, count(*) AS scanned_today, count(*) FILTER (WHERE is_phishing) AS blocked_today FROM E
  WHERE scanned_at >= date_trunc('day', TIMESTAMP '{AS_OF}') GROUP BY user_id),
TT AS (SELECT user_id, count(*) AS total_scanned, count(*) FILTER (WHERE is_phishing) AS phishing_blocked FROM E GROUP BY user_id)"""


def level():
    return vd.risk_level(F.col("risk_score"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ac.first_flags(emails(spark, sf_dir), ["user_id", "sender"])
    return ac.alert_rows(flagged, users(spark, sf_dir), level())


def alert_text(c: str):
    return F.array_join(
        F.transform(c, lambda a: F.concat_ws("/", a["risk_level"], a["message"], F.date_format(a["created_at"], "HH:mm"))),
        " | ",
    )


@register("rolling_user_risk", f"WITH {BASE} SELECT * FROM RR")
def rolling_user_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.rolling_user_risk(emails(spark, sf_dir))


@register("user_risk_trajectory", f"""WITH {BASE}
SELECT user_id, email_id, {ob.py_round('(m / 100)')} AS risk_score FROM (
  SELECT user_id, email_id, avg(round(risk_score * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY scanned_at, email_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM E)""")
def user_risk_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.risk_trajectory(emails(spark, sf_dir))


@register("ewma_user_risk", f"""WITH {BASE}
SELECT user_id, count(*) AS n_messages, list_reduce(list_prepend(0e0, list(risk_score ORDER BY scanned_at, email_id)),
  lambda a, x: floor(a * 8e-1 + x * 2e-1 + 5e-1))::INTEGER AS weighted_risk FROM E GROUP BY user_id""")
def ewma_user_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.weighted_user_risk(emails(spark, sf_dir))


@register("first_flag_alerts", f"""WITH {BASE}
SELECT user_id, audience, message, email_id, risk_level, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created FROM AL""")
def first_flag_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(spark, sf_dir)
    return found.withColumn("created", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("created_at")


@register("guardian_notifications", f"""WITH {BASE}
SELECT g.email AS guardian_email, p.name AS monitored_name, p.email AS monitored_email, FF.email_id, FF.risk_score, FF.sender, FF.subject,
  {ob.level('FF.risk_score')} AS risk_level FROM FF JOIN U p USING (user_id) JOIN U g ON g.user_id = p.guardian_id""")
def guardian_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ac.first_flags(emails(spark, sf_dir), ["user_id", "sender"])
    return ac.notifications(flagged, users(spark, sf_dir), level())


_LIST = """string_agg(risk_level || '/' || message || '/' || strftime(created_at, '%H:%M'), ' | ' ORDER BY nth)"""


@register("user_dashboard", f"""WITH {BASE},
NA AS (SELECT user_id, count(*) AS n, {_LIST} AS lines FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, email_id DESC) AS nth
  FROM AL WHERE created_at >= date_trunc('day', TIMESTAMP '{AS_OF}')) WHERE nth <= 10 GROUP BY user_id)
SELECT U.user_id, coalesce(total_scanned, 0) AS total_scanned, coalesce(phishing_blocked, 0) AS phishing_blocked, coalesce(risk_score, 0e0) AS risk_score,
  coalesce(scanned_today, 0) > 0 AS daily_active, coalesce(n, 0) AS n_recent_alerts, coalesce(lines, '') AS alerts
FROM U LEFT JOIN TT USING (user_id) LEFT JOIN RR USING (user_id) LEFT JOIN TD USING (user_id) LEFT JOIN NA USING (user_id)""")
def user_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = ac.user_dashboard(users(spark, sf_dir), emails(spark, sf_dir), alerts(spark, sf_dir), as_of())
    return board.withColumn("alerts", F.coalesce(alert_text("recent_alerts"), F.lit(""))).drop("recent_alerts")


@register("guardian_dashboard", f"""WITH {BASE},
CH AS (SELECT guardian_id, user_id, name, email, coalesce(total_scanned, 0) AS total_scanned FROM U LEFT JOIN TT USING (user_id) WHERE guardian_id IS NOT NULL),
TP AS (SELECT * FROM CH QUALIFY row_number() OVER (PARTITION BY guardian_id ORDER BY total_scanned DESC, user_id) = 1),
WM AS (SELECT AL.* FROM AL WHERE EXISTS (SELECT 1 FROM E JOIN CH ON CH.user_id = E.user_id WHERE E.email_id = AL.email_id AND CH.guardian_id = AL.user_id)),
NA AS (SELECT user_id, {_LIST} AS lines FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, email_id DESC) AS nth FROM WM) WHERE nth <= 5 GROUP BY user_id)
SELECT U.user_id AS guardian_id, coalesce(TP.name, '') AS child_name, coalesce(TP.email, '') AS child_email, coalesce(RR.risk_score, 0e0) AS risk_score,
  coalesce(blocked_today, 0) AS blocked_today, coalesce(lines, '') AS alerts
FROM U LEFT JOIN TP ON TP.guardian_id = U.user_id LEFT JOIN RR ON RR.user_id = TP.user_id LEFT JOIN TD ON TD.user_id = TP.user_id LEFT JOIN NA ON NA.user_id = U.user_id""")
def guardian_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = ac.guardian_dashboard(users(spark, sf_dir), emails(spark, sf_dir), alerts(spark, sf_dir), as_of())
    return board.withColumn("alerts", F.coalesce(alert_text("recent_alerts"), F.lit(""))).drop("recent_alerts")


@register("watched_accounts", f"""WITH {BASE}
SELECT guardian_id, user_id, email, name, CASE WHEN NOT has_account THEN 'needs_account' WHEN coalesce(total_scanned, 0) = 0 THEN 'needs_extension' ELSE 'active' END AS state,
  coalesce(risk_score, 0e0) AS risk_score, coalesce(total_scanned, 0) AS total_scanned, coalesce(blocked_today, 0) AS blocked_today,
  coalesce(strftime(last_at, '%d/%m/%Y %H:%M'), '') AS last_scan
FROM U LEFT JOIN TT USING (user_id) LEFT JOIN RR USING (user_id) LEFT JOIN TD USING (user_id)
  LEFT JOIN (SELECT user_id, max(scanned_at) AS last_at FROM E GROUP BY user_id) USING (user_id) WHERE guardian_id IS NOT NULL""")
def watched_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.watched_accounts(users(spark, sf_dir), emails(spark, sf_dir), as_of())


@register("watched_list", f"""WITH {BASE},
WA AS (SELECT guardian_id, user_id, email, CASE WHEN NOT has_account THEN 'needs_account' WHEN coalesce(total_scanned, 0) = 0 THEN 'needs_extension' ELSE 'active' END AS state,
  coalesce(risk_score, 0e0) AS risk_score FROM U LEFT JOIN TT USING (user_id) LEFT JOIN RR USING (user_id) WHERE guardian_id IS NOT NULL)
SELECT guardian_id, list(email ORDER BY email, user_id) AS emails, list(state ORDER BY email, user_id) AS states,
  list(risk_score ORDER BY email, user_id) AS risk_scores FROM WA GROUP BY guardian_id""")
def watched_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watched accounts as their guardian sees them: one list, by address."""
    return ac.watched_list(ac.watched_accounts(users(spark, sf_dir), emails(spark, sf_dir), as_of()))


@register("daily_user_counts", f"WITH {BASE} SELECT * FROM TD")
def daily_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.today_counts(emails(spark, sf_dir), as_of())


@register("user_counters", f"WITH {BASE} SELECT * FROM TT")
def user_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.user_totals(emails(spark, sf_dir))


@register("system_kpis", f"""WITH {BASE} SELECT (SELECT count(*) FROM E) AS total_emails, (SELECT count(*) FROM E WHERE is_phishing) AS phishing_blocked,
  count(*) AS total_users, count(*) FILTER (WHERE daily_active) AS active_users,
  printf('%.1f%%', count(*) FILTER (WHERE daily_active) / count(*)::DOUBLE * 100) AS active_share FROM U""")
def system_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.system_kpis(users(spark, sf_dir), emails(spark, sf_dir))


_ORPHANS = "OA AS (SELECT * FROM U WHERE NOT has_account AND user_id NOT IN (SELECT guardian_id FROM U WHERE guardian_id IS NOT NULL))"


@register("orphan_accounts", f"WITH {BASE}, {_ORPHANS} SELECT user_id, email FROM OA")
def orphan_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.orphan_accounts(users(spark, sf_dir)).select("user_id", "email")


@register("account_scan_audit", f"""WITH {BASE}, {_ORPHANS}
SELECT OA.user_id, OA.email, coalesce(total_scanned, 0) AS n_scans FROM OA LEFT JOIN TT USING (user_id)""")
def account_scan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = users(spark, sf_dir)
    return ac.deletion_preview(ac.orphan_accounts(people), emails(spark, sf_dir))


@register("cascade_delete", f"""WITH {BASE}, {_ORPHANS}
SELECT 'users' AS table_name, count(*) AS n_left FROM U WHERE user_id NOT IN (SELECT user_id FROM OA)
UNION ALL SELECT 'emails', count(*) FROM E WHERE user_id NOT IN (SELECT user_id FROM OA)
UNION ALL SELECT 'alerts', count(*) FROM AL WHERE user_id NOT IN (SELECT user_id FROM OA)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = users(spark, sf_dir)
    left = ac.delete_accounts(ac.orphan_accounts(people), people, emails(spark, sf_dir), alerts(spark, sf_dir))
    out = None
    for name, table in zip(("users", "emails", "alerts"), left):
        row = table.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = row if out is None else out.unionByName(row)
    return out


def _request_address():
    return F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("customer."), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@example.org"))).otherwise(
        F.concat(F.lit("new."), F.col("o_custkey").cast("string"), F.lit("@example.org"))
    )


_REQ_EMAIL = "CASE WHEN o_orderkey % 2 = 0 THEN 'customer.' || lpad(o_custkey::VARCHAR, 9, '0') || '@example.org' ELSE 'new.' || o_custkey || '@example.org' END"


@register("new_accounts", f"""WITH {BASE} SELECT DISTINCT e AS email, split_part(e, '@', 1) AS name, false AS has_account
FROM (SELECT {_REQ_EMAIL} AS e FROM orders) WHERE e NOT IN (SELECT email FROM U)""")
def new_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_request_address().alias("user_email"))
    return ac.missing_users(seen, users(spark, sf_dir))


@register("guardian_links", f"""WITH {BASE},
RQ AS (SELECT {ob.draw('g', 'o_orderkey')} % 40 AS guardian_id, {_REQ_EMAIL} AS child_email, o_orderdate AS asked_at FROM orders),
OKR AS (SELECT RQ.* FROM RQ JOIN U g ON g.user_id = RQ.guardian_id WHERE g.email <> RQ.child_email),
LS AS (SELECT child_email, arg_max(guardian_id, (asked_at, guardian_id)) AS new_guardian FROM OKR GROUP BY child_email)
SELECT child_email, U.user_id AS child_id, new_guardian, coalesce(U.guardian_id = new_guardian, false) AS already_linked, U.user_id IS NULL AS created
FROM LS LEFT JOIN U ON U.email = LS.child_email""")
def guardian_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (draw("g", F.col("o_orderkey")) % 40).alias("guardian_id"), _request_address().alias("child_email"),
        F.col("o_orderdate").alias("requested_at"),
    )
    return ac.link_guardians(users(spark, sf_dir), asked)


@register("guardian_unlinks", f"""WITH {BASE},
RQ AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_custkey % 11 END AS requester_id, {_REQ_EMAIL} AS child_email FROM orders)
SELECT RQ.requester_id, RQ.child_email, CASE WHEN U.guardian_id IS NULL THEN 'no_link' WHEN RQ.requester_id IN (U.guardian_id, U.user_id) THEN 'removed' ELSE 'forbidden' END AS outcome
FROM RQ LEFT JOIN U ON U.email = RQ.child_email""")
def guardian_unlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") % 11).alias("requester_id"),
        _request_address().alias("child_email"),
    )
    return ac.unlink_guardians(users(spark, sf_dir), asked)
