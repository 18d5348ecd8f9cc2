"""Registered streaming queries. Each runs a stream to its end and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.config import DEFAULT as CFG
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import as_mail
from mailrisk.plans.q_accounts import BASE
from mailrisk.plans.q_store import walk_sql
from mailrisk.plans.registry import register
from mailrisk.session import work_dir
from mailrisk.streaming import messages as ms
from mailrisk.operators.bucketed import BucketedStore


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(
        f"{sf_dir}/documents.parquet*"
    )
    return as_mail(stream).drop("model_score")


@register("stream_dedup_score", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT DISTINCT user_id, sender, subject, substring(sha256(content), 1, 32) AS content_hash, rule_score::DOUBLE AS risk_score,
  {ob.level('rule_score')} AS risk_level, array_to_string(rule_reasons, ' | ') AS reasons FROM S""")
def stream_dedup_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is delivered twice, as polling does; each is scored and written once."""
    stream = _documents(spark, sf_dir)
    polled = stream.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2)))).drop("poll")
    scored = ms.score_stream(ms.skip_seen(polled, "60 days")).select(
        "user_id", "sender", "subject", "content_hash", "risk_score", "risk_level",
        F.array_join("indicators", " | ").alias("reasons"),
    )
    folder = _folder(spark, "scored")
    writer = (
        scored.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    )
    ms.run_to_end(writer)
    return spark.read.schema(scored.schema).parquet(f"{folder}/out")


@register("stream_high_risk", f"""WITH {ob.MAIL}, {ob.scored()}
SELECT msg_id, user_id, sender, subject, rule_score::DOUBLE AS risk_score FROM S WHERE rule_score >= {CFG.push_score}""")
def stream_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "high-risk")
    scored = ms.score_stream(_documents(spark, sf_dir)).select("msg_id", "user_id", "sender", "subject", "risk_score")

    def step(batch: DataFrame, number: int) -> None:
        # The verdicts of the batch are written as they come; the filter reads the narrow result.
        path = f"{folder}/verdicts-{number:012d}"
        batch.write.mode("overwrite").parquet(path)
        narrow = batch.sparkSession.read.schema(batch.schema).parquet(path)
        ms.notify_step(f"{folder}/out")(ms.high_risk(narrow), number)

    ms.run_to_end(ms.per_batch(scored, step, f"{folder}/checkpoint"))
    return spark.read.schema(scored.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


@register("stream_user_state", f"""WITH {BASE}
SELECT user_id, count(*) AS total_scanned, count(*) FILTER (WHERE is_phishing) AS phishing_blocked,
  list_reduce(list_prepend(0e0, list(risk_score ORDER BY scanned_at, email_id)), lambda a, x: floor(a * 8e-1 + x * 2e-1 + 5e-1))::INTEGER AS weighted_risk
FROM E GROUP BY user_id""")
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value")))
    verdicts = events.select(
        F.col("event_id").alias("email_id"), "user_id", F.col("ts").alias("scanned_at"),
        score.alias("risk_score"), (score >= CFG.threshold).alias("is_phishing"),
    )
    folder = _folder(spark, "user-state")
    ms.run_to_end(ms.per_batch(verdicts, ms.user_state_step(f"{folder}/out"), f"{folder}/checkpoint"))
    return ms.read_user_state(spark, f"{folder}/out", ms.newest_version(spark, f"{folder}/out", "state"))


@register("stream_verdict_store", f"""WITH RECURSIVE {walk_sql('0')}
SELECT msg_key, email_id, content_hash, risk_score, phish AS is_phishing, '{CFG.rules_only_version}' AS scoring_version
FROM WALK QUALIFY row_number() OVER (PARTITION BY msg_key ORDER BY rn DESC) = 1""")
def stream_verdict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "store")
    kept = BucketedStore(f"{folder}/out")
    step = ms.store_step(kept, model_ready=False)
    ms.run_to_end(ms.per_batch(_documents(spark, sf_dir), step, f"{folder}/checkpoint"))
    store = kept.read(spark, ms.newest_version(spark, kept.folder, "manifest"))
    return store.select("msg_key", "email_id", "content_hash", "risk_score", "is_phishing", "scoring_version")


ARRIVALS = 6  # deliveries; some rows come two later than their neighbours


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of ``events`` and the delivery that brings each: a sixth of the time span, every 37th event two later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts IS NOT NULL")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi"))
    share = F.expr(f"(unix_micros(ts) - lo) * {ARRIVALS} div (hi - lo + 1)")
    late = F.when(F.col("event_id") % 37 == 0, 2).otherwise(0)
    return events.join(F.broadcast(ends)).select(  # one row
        "user_id", F.col("event_id").alias("email_id"), F.col("ts").alias("scanned_at"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))).alias("risk_score"),
        F.least(share + late, F.lit(ARRIVALS + 1)).cast("int").alias("delivery"))


DELIVERIES = f"""B AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events WHERE ts IS NOT NULL),
D AS (SELECT user_id, event_id, ts, greatest(0e0, least(1e2, value)) AS risk_score, time_bucket(INTERVAL '1 hour', ts) AS ws,
  least((epoch_us(ts) - lo) * {ARRIVALS} // (hi - lo + 1) + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END, {ARRIVALS + 1}) AS d FROM events, B WHERE ts IS NOT NULL),
M AS (SELECT x.d, max(D.ts) - INTERVAL '10 minutes' AS passed FROM (SELECT DISTINCT d FROM D) x LEFT JOIN D ON D.d < x.d GROUP BY x.d)"""


@register("stream_event_windows", f"""WITH {DELIVERIES},
K AS (SELECT D.* FROM D JOIN M USING (d) WHERE passed IS NULL OR ws + INTERVAL '1 hour' > date_trunc('milliseconds', passed))
SELECT user_id, ws AS window_start, ws + INTERVAL '1 hour' AS window_end, count(*) AS n_scans,
  count(*) FILTER (WHERE risk_score >= {CFG.threshold}) AS n_phishing
FROM K WHERE ws + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL '10 minutes') FROM D) GROUP BY user_id, ws""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of event time over deliveries, one micro-batch each; rows that come too late for their window are dropped."""
    return _deliver(spark, _deliveries(spark, sf_dir), "windows", ms.windowed_counts)


def _deliver(spark: SparkSession, rows: DataFrame, name: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` writes when the deliveries arrive one by one and the stream is started again for each."""
    folder = _folder(spark, name)
    for number in range(ARRIVALS + 2):
        rows.filter(F.col("delivery") == number).drop("delivery").write.parquet(f"{folder}/in/{number:06d}")
        stream = spark.readStream.schema(rows.drop("delivery").schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        result = operator(stream)
        ms.run_to_end(
            result.writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True))
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


@register("stream_user_slices", f"""WITH {DELIVERIES},
K AS (SELECT D.* FROM D JOIN M USING (d) WHERE user_id IS NOT NULL AND (passed IS NULL OR ts > date_trunc('milliseconds', passed)))
SELECT user_id, count(*) AS total_scanned, count(*) FILTER (WHERE risk_score >= {CFG.threshold}) AS phishing_blocked,
  list_reduce(list_prepend(0e0, list(risk_score ORDER BY ws, d, ts, event_id)), lambda a, x: floor(a * 8e-1 + x * 2e-1 + 5e-1))::INTEGER AS weighted_risk
FROM K WHERE ws + INTERVAL '1 hour' < (SELECT date_trunc('milliseconds', max(ts) - INTERVAL '10 minutes') FROM D) GROUP BY user_id""")
def stream_user_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User state from the state store after all deliveries: every hour that the watermark has passed."""
    return ms.state_from_slices(_deliver(spark, _deliveries(spark, sf_dir), "slices", ms.user_slices))
