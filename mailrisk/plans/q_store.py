"""Registered queries on the verdict store and the lists of known senders, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import text as tx
from mailrisk.operators import ensemble as en
from mailrisk.operators import store as st
from mailrisk.operators import trust as tr
from mailrisk.operators.bucketed import BucketedStore
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import mail_view
from mailrisk.plans.registry import register
from mailrisk.session import materialise, work_dir

START, THIRD, BATCHES = 1704067200, 864000, 3


def replayed_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail and the batch it comes in; there are no model scores in the first."""
    number = F.floor((F.unix_timestamp("scanned_at") - START) / THIRD)
    return mail_view(spark, sf_dir).withColumn("batch", number).withColumn(
        "model_score", F.when(F.col("batch") > 0, F.col("model_score"))
    )


def replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three batches of ten days; the model is not ready during the first."""
    mail = replayed_mail(spark, sf_dir)
    store, flagged = st.empty_store(spark), None
    for n in range(BATCHES):
        batch = mail.filter(F.col("batch") == n)
        plan = st.plan_scans(store, batch, model_ready=n > 0)
        # Deciding comes first: only what is due is scored.
        due = batch.join(plan.filter("scored").select("msg_id"), "msg_id", "left_semi")
        after, new = st.apply_scans(store, en.score_ensemble(due), plan)
        store = materialise(after, f"store-{n}") if n < BATCHES - 1 else after  # no batch reads the last
        new = new.select("msg_id", F.lit(n).alias("batch"))
        flagged = new if flagged is None else flagged.unionByName(new)
    return store, flagged


# One message after another, as the definition has it: a recursive walk along each key.
def walk_sql(batch: str) -> str:
    return f"""{ob.MAIL}, {ob.scored()},
E1 AS (SELECT *, {ob.DAMPING} AS d, {batch} AS batch FROM S),
E2 AS (SELECT *, CASE WHEN batch = 0 THEN rule_score::DOUBLE ELSE {ob.py_round(f'({ob.combined("d")})')} END AS risk_score,
    md5(user_id || chr(10) || sender || chr(10) || substring(subject, 1, 200)) AS msg_key, substring(sha256(content), 1, 32) AS content_hash FROM E1),
E3 AS (SELECT *, risk_score >= {CFG.threshold} AS phish, row_number() OVER (PARTITION BY msg_key ORDER BY batch, at_epoch, msg_id) AS rn FROM E2),
WALK AS (
  SELECT msg_key, rn, msg_id AS email_id, at_epoch AS first_epoch, msg_id, batch, least(length(content), 500) AS kept, content_hash, risk_score, phish, batch = 0 AS rules_only,
    true AS was_scored, phish AS newly FROM E3 WHERE rn = 1
  UNION ALL
  SELECT w.msg_key, e.rn, w.email_id, w.first_epoch, e.msg_id, e.batch,
    CASE WHEN reuse THEN w.kept ELSE least(length(e.content), 500) END, CASE WHEN reuse THEN w.content_hash ELSE e.content_hash END,
    CASE WHEN reuse THEN w.risk_score ELSE e.risk_score END, CASE WHEN reuse THEN w.phish ELSE e.phish END,
    CASE WHEN reuse THEN w.rules_only ELSE e.batch = 0 END, NOT reuse, NOT reuse AND e.phish AND NOT w.phish
  FROM (SELECT w.*, e.rn AS ern, NOT (w.rules_only AND e.batch > 0) AND (e.content_hash = w.content_hash OR length(e.content) < w.kept) AS reuse
        FROM WALK w JOIN E3 e ON e.msg_key = w.msg_key AND e.rn = w.rn + 1) w JOIN E3 e ON e.msg_key = w.msg_key AND e.rn = w.ern
)"""


REPLAY = walk_sql(f"floor((at_epoch - {START}) / {THIRD}e0)::INTEGER")


@register("verdict_upsert_replay", f"""WITH RECURSIVE {REPLAY}
SELECT msg_key, email_id, first_epoch, content_hash, kept, risk_score, phish AS is_phishing,
  CASE WHEN rules_only THEN '{CFG.rules_only_version}' ELSE '{CFG.version}' END AS scoring_version
FROM WALK QUALIFY row_number() OVER (PARTITION BY msg_key ORDER BY rn DESC) = 1""")
def verdict_upsert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = replay(spark, sf_dir)
    return store.select(
        "msg_key", "email_id", F.unix_timestamp("scanned_at").alias("first_epoch"), "content_hash",
        F.length("content").alias("kept"), "risk_score", "is_phishing", "scoring_version",
    )


@register("newly_flagged_replay", f"WITH RECURSIVE {REPLAY} SELECT msg_id, batch FROM WALK WHERE newly")
def newly_flagged_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir)[1]


@register("rules_only_backlog", f"""WITH RECURSIVE {REPLAY}
SELECT msg_key, email_id FROM WALK QUALIFY row_number() OVER (PARTITION BY msg_key ORDER BY rn DESC) = 1 AND rules_only""")
def rules_only_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rules_backlog(replay(spark, sf_dir)[0]).select("msg_key", "email_id")


@register("bucketed_verdict_store", f"""WITH RECURSIVE {REPLAY},
N AS (SELECT *, ('0x' || substring(msg_key, 1, 8))::BIGINT % 256 AS bucket FROM WALK),
V AS (SELECT bucket, max(batch) FILTER (WHERE was_scored) AS bucket_version FROM N GROUP BY bucket)
SELECT msg_key, email_id, content_hash, risk_score, bucket::INTEGER AS bucket, bucket_version::BIGINT AS bucket_version FROM N JOIN V USING (bucket)
QUALIFY row_number() OVER (PARTITION BY msg_key ORDER BY rn DESC) = 1""")
def bucketed_verdict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three batches against a store in buckets, with the version that wrote each bucket last."""
    mail, kept = replayed_mail(spark, sf_dir), BucketedStore(f"{work_dir(spark)}/verdicts-{uuid.uuid4().hex}")
    for n in range(BATCHES):
        kept.advance(mail.filter(F.col("batch") == n), n, n > 0, en.score_ensemble)
    kept.drop_before(spark, BATCHES - 1)
    written = spark.createDataFrame(sorted(kept.manifest(spark, BATCHES - 1).items()), "bucket int, bucket_version bigint")
    rows = kept.read(spark, BATCHES - 1).select("msg_key", "email_id", "content_hash", "risk_score", kept.bucket().alias("bucket"))
    return rows.join(F.broadcast(written), "bucket")  # at most as many rows as there are buckets


# Known senders ---------------------------------------------------------------------------------

SHAPES = 5


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per message, in the spellings users type."""
    mail = mail_view(spark, sf_dir)
    domain = F.substring_index("sender", "@", -1)
    kind = tx.draw("tk", F.col("msg_id")) % SHAPES
    raw = (
        F.when(kind == 0, F.col("sender"))
        .when(kind == 1, F.concat(F.lit("@"), domain))
        .when(kind == 2, F.concat(F.lit("\t "), F.upper("sender"), F.lit(" \n")))
        .when(kind == 3, domain)
        .otherwise(F.concat(F.lit("not an address "), F.col("sender")))
    )
    return mail.select("user_id", raw.alias("raw"), F.unix_timestamp("scanned_at").alias("requested_at"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on the lists already: every valid request of a user with an even number."""
    rows = requests(spark, sf_dir).select("user_id", tr.normalise_entry(F.col("raw")).alias("n"))
    valid = rows.select("user_id", "n.*").filter("error IS NULL AND user_id % 2 = 0")
    return valid.select("user_id", "value", "is_domain").distinct()


def stored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_view(spark, sf_dir).select(
        F.col("msg_id").alias("email_id"), "user_id", "sender", "subject", "content", "scanned_at",
        F.lit(CFG.version).alias("scoring_version"),
    )


_DOM = "string_split(sender, '@')[-1]"
REQUESTS = f"""
RQ AS (SELECT user_id, at_epoch AS requested_at, CASE {ob.draw('tk', 'msg_id')} % {SHAPES} WHEN 0 THEN sender WHEN 1 THEN '@' || {_DOM}
    WHEN 2 THEN chr(9) || ' ' || upper(sender) || ' ' || chr(10) WHEN 3 THEN {_DOM} ELSE 'not an address ' || sender END AS raw FROM M),
N0 AS (SELECT *, ltrim(lower(regexp_replace(raw, '^[{ob.SP}]+|[{ob.SP}]+$', '', 'g')), '@') AS v FROM RQ),
NM AS (SELECT user_id, requested_at, raw, v AS "value", v <> '' AND NOT contains(v, '@') AS is_domain,
  CASE WHEN v = '' THEN 'empty' WHEN contains(v, '@') THEN CASE WHEN regexp_matches(v, '^[^@\\s]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$') THEN '' ELSE 'bad_address' END
    WHEN NOT regexp_matches(v, '^[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$') THEN 'bad_domain'
    WHEN list_contains({ob.arr(lx.FREE_MAIL)}, v) THEN 'free_provider' ELSE '' END AS error FROM N0),
LI AS (SELECT DISTINCT user_id, "value", is_domain FROM NM WHERE error = '' AND user_id % 2 = 0)"""
_MATCH = """((l.is_domain AND lower(m.sender) LIKE '%@' || l."value") OR (NOT l.is_domain AND lower(m.sender) LIKE '%' || l."value" || '%'))"""


@register("trust_normalise", f"""WITH {ob.MAIL}, {REQUESTS} SELECT user_id, requested_at, raw, "value", is_domain, error FROM NM""")
def trust_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    parsed = rows.select("*", tr.normalise_entry(F.col("raw")).alias("n"))
    return parsed.select("user_id", "requested_at", "raw", "n.value", "n.is_domain", tx.text_or_empty(F.col("n.error")).alias("error"))


@register("trust_match", f"""WITH {ob.MAIL}, {REQUESTS}
SELECT msg_id, EXISTS (SELECT 1 FROM LI l WHERE l.user_id = M.user_id AND CASE WHEN l.is_domain
  THEN {ob.sender_domain('lower(trim(M.sender))')} <> '' AND ({ob.sender_domain('lower(trim(M.sender))')} = l."value" OR ends_with({ob.sender_domain('lower(trim(M.sender))')}, '.' || l."value"))
  ELSE lower(trim(M.sender)) = l."value" END) AS user_trusted FROM M""")
def trust_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tr.with_user_trust(mail_view(spark, sf_dir), listed(spark, sf_dir))
    return joined.select("msg_id", "user_trusted")


_EVIDENCE = f"""
VA AS (SELECT user_id, "value", is_domain, min(requested_at) AS first_at FROM NM WHERE error = '' GROUP BY ALL),
EV0 AS (SELECT l.user_id, l."value", l.is_domain, m.rule_score, m.rule_reasons, row_number() OVER (PARTITION BY l.user_id, l."value" ORDER BY m.at_epoch DESC, m.msg_id DESC) AS nth
  FROM VA l JOIN S m ON m.user_id = l.user_id AND {_MATCH}),
EV AS (SELECT user_id, "value", is_domain, max(rule_score) AS evidence, count(*) AS n_examined,
  CASE WHEN max(rule_score) > 0 THEN arg_max(array_to_string(rule_reasons, ' | '), (rule_score, -nth)) ELSE '' END AS signs
  FROM EV0 WHERE nth <= 50 GROUP BY ALL)"""


@register("trust_evidence", f"""WITH {ob.MAIL}, {ob.scored()}, {REQUESTS}, {_EVIDENCE} SELECT * FROM EV""")
def trust_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("user_id", tr.normalise_entry(F.col("raw")).alias("n")).select("user_id", "n.*")
    wanted = rows.filter("error IS NULL").select("user_id", "value", "is_domain").distinct()
    found = tr.rule_evidence(stored_mail(spark, sf_dir), wanted)
    return found.withColumn("signs", F.array_join("signs", " | "))


@register("trust_requests", f"""WITH {ob.MAIL}, {ob.scored()}, {REQUESTS}, {_EVIDENCE},
JU AS (SELECT VA.*, coalesce(EV.evidence, 0) AS evidence, LI.user_id IS NOT NULL AS is_listed, (SELECT count(*) FROM LI x WHERE x.user_id = VA.user_id) AS size
  FROM VA LEFT JOIN EV ON EV.user_id = VA.user_id AND EV."value" = VA."value" LEFT JOIN LI ON LI.user_id = VA.user_id AND LI."value" = VA."value"),
PO AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_listed OR evidence >= {CFG.trust_refusal_score} ORDER BY first_at, "value") AS pos FROM JU)
SELECT user_id, "value", is_domain, evidence, CASE WHEN size >= 500 THEN 'full' WHEN evidence >= {CFG.trust_refusal_score} THEN 'evidence' WHEN is_listed THEN 'unchanged'
  WHEN size + pos <= 500 THEN 'added' ELSE 'full' END AS outcome FROM PO
UNION ALL SELECT DISTINCT user_id, "value", is_domain, 0, error FROM NM WHERE error <> ''""")
def trust_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.add_entries(requests(spark, sf_dir), listed(spark, sf_dir), stored_mail(spark, sf_dir)).drop("first_at")


@register("trust_invalidate", f"""WITH {ob.MAIL}, {REQUESTS}
SELECT l.user_id, l."value", count(*) AS n_rescored, (SELECT count(*) FROM M m WHERE EXISTS (SELECT 1 FROM LI l WHERE l.user_id = m.user_id AND {_MATCH})) AS n_cleared
FROM LI l JOIN M m ON m.user_id = l.user_id AND {_MATCH} GROUP BY l.user_id, l."value\"""")
def trust_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared, counts = tr.invalidate(stored_mail(spark, sf_dir), listed(spark, sf_dir))
    # One row: how many verdicts lost their version.
    total = cleared.agg(F.count_if(F.col("scoring_version") == "").alias("n_cleared"))
    return counts.join(F.broadcast(total))


@register("trust_remove", f"""WITH {ob.MAIL}, {REQUESTS}, AK AS (SELECT DISTINCT user_id, "value" FROM NM WHERE user_id % 3 = 0),
RM AS (SELECT LI.* FROM LI JOIN AK ON AK.user_id = LI.user_id AND AK."value" = LI."value")
SELECT AK.user_id, AK."value", CASE WHEN LI.user_id IS NULL THEN 'not_listed' ELSE 'removed' END AS outcome,
  (SELECT count(*) FROM LI WHERE user_id % 3 <> 0 OR "value" NOT IN (SELECT "value" FROM AK a WHERE a.user_id = LI.user_id)) AS n_left,
  (SELECT count(*) FROM M m WHERE EXISTS (SELECT 1 FROM RM l WHERE l.user_id = m.user_id AND {_MATCH})) AS n_cleared
FROM AK LEFT JOIN LI ON LI.user_id = AK.user_id AND LI."value" = AK."value\"""")
def trust_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose number divides by three take back all their requests; what those covered is scored again."""
    asked = requests(spark, sf_dir).filter("user_id % 3 = 0")
    left, outcome, cleared = tr.remove_and_invalidate(listed(spark, sf_dir), asked, stored_mail(spark, sf_dir))
    totals = left.agg(F.count(F.lit(1)).alias("n_left")), cleared.agg(F.count_if(F.col("scoring_version") == "").alias("n_cleared"))
    return outcome.join(F.broadcast(totals[0])).join(F.broadcast(totals[1]))  # one row each


@register("trust_lists", f"""WITH {ob.MAIL}, {REQUESTS},
LD AS (SELECT user_id, "value", min(requested_at) AS added_at FROM NM WHERE error = '' AND user_id % 2 = 0 GROUP BY ALL)
SELECT user_id, list("value" ORDER BY added_at DESC, "value") AS "values", list(added_at ORDER BY added_at DESC, "value") AS added_at
FROM LD GROUP BY user_id""")
def trust_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists as their owner sees them: newest entry first."""
    rows = requests(spark, sf_dir).select("user_id", "requested_at", tr.normalise_entry(F.col("raw")).alias("n"))
    valid = rows.select("user_id", "requested_at", "n.*").filter("error IS NULL AND user_id % 2 = 0")
    dated = valid.groupBy("user_id", "value", "is_domain").agg(F.min("requested_at").alias("added_at"))
    return tr.newest_first(dated)
