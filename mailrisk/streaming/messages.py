"""Structured Streaming over arriving messages: intake, scoring, deduplication, stored state.

Scoring is the same column code as in batch. State that depends on order (the verdict store, the
running user state) advances once per micro-batch in ``foreachBatch``: version n is computed from
version n-1 and written to its own folder, so a repeated micro-batch rewrites the same result and a
user or message key with most of the rows is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import text as tx
from mailrisk.operators import accounts as ac
from mailrisk.operators import ensemble as en
from mailrisk.operators.bucketed import BucketedStore

MESSAGE_SCHEMA = (
    "msg_id bigint, user_id bigint, sender string, subject string, content string, scanned_at timestamp"
)


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str = MESSAGE_SCHEMA, file_format: str = "json",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Messages arriving as files (one JSON object per message, or parquet)."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_batch(spark: SparkSession, path: str, schema: StructType | str = MESSAGE_SCHEMA) -> DataFrame:
    """The same message files read at once, for a back-fill of what a stream would have seen."""
    return spark.read.schema(schema).json(path)


def skip_seen(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop messages already seen: a mailbox is polled again and again."""
    keyed = stream.withColumn("content_hash", tx.fingerprint(F.col("content")))
    return keyed.withWatermark("scanned_at", delay).dropDuplicatesWithinWatermark(
        ["user_id", "sender", "subject", "content_hash"]
    )


def score_stream(stream: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Verdict of each arriving message; without ``model_score`` the rules stand alone."""
    if "model_score" not in stream.columns:
        stream = stream.withColumn("model_score", F.lit(None).cast("double"))
    return en.score_ensemble(stream, cfg)


def windowed_counts(
    verdicts: DataFrame, width: str = "1 hour", delay: str = "10 minutes", cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Scans and phishing per user and tumbling window of event time, each window written once, when the watermark passes it.

    The watermark trails the latest event by ``delay``. A row that comes after its window was written is late and dropped. Rows without a time belong to no window; state holds the open windows only.
    """
    timed = verdicts.filter("scanned_at IS NOT NULL").withWatermark("scanned_at", delay)
    counted = timed.groupBy("user_id", F.window("scanned_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_scans"), F.count_if(F.col("risk_score") >= cfg.threshold).alias("n_phishing")
    )
    return counted.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_scans", "n_phishing")


SLICE_STATE = "users binary, n_scans binary, n_blocked binary, after binary"  # per user: two counts, a byte for each of the 101 states before
SLICE = "user_id bigint, slice bigint, closed_ms bigint, n_scans bigint, n_blocked bigint, after array<int>"
SLICE_BUCKETS = 16  # keys of one slice: each call folds all its users in columns
FOLD_ROWS = 1 << 14  # tables made at once, 202 bytes each


def _fold_users(users: np.ndarray, scores: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Users, their messages, those at the threshold, and the table of their run; rows come by user and in order."""
    first = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
    owners, tables = [], []
    for at in range(0, len(users), FOLD_ROWS):
        part = users[at : at + FOLD_ROWS]
        owners.append(part[np.r_[True, part[1:] != part[:-1]]])
        tables.append(ac.fold_tables(part, ac.step_tables(scores[at : at + FOLD_ROWS])))
    after = ac.fold_tables(np.concatenate(owners), np.concatenate(tables)).astype("uint8")
    blocked = np.add.reduceat((scores >= threshold).astype("int64"), first)
    return users[first], np.diff(np.r_[first, len(users)]), blocked, after


def user_slices(
    verdicts: DataFrame, seconds: int = 3600, delay: str = "10 minutes", cfg: ScoringConfig = DEFAULT,
    buckets: int = SLICE_BUCKETS,
) -> DataFrame:
    """Running user state in the state store, kept per bucket of users and slice of event time: a heavy user is many keys, and
    many users with a message or two share one.

    Takes user_id, email_id, scanned_at, risk_score. An open slice holds, for each of its users, the counts and the table
    "risk before -> risk after" of the messages: in a micro-batch by time and id, across micro-batches as they arrive. A
    timer at the end of the slice writes it once the watermark, ``delay`` behind the latest message, has passed, and frees
    the state; so an idle user costs none. Rows not later than the watermark are late and dropped, rows without user or
    time belong to no slice, a message without a score counts and changes no risk. One call holds what a micro-batch
    brings for one bucket and slice, 32 bytes a message, and 125 bytes for each user seen there; ``files_per_batch`` of the
    source and ``buckets`` bound that. A running stream keeps the number of buckets it began with.
    """
    timed = verdicts.filter("user_id IS NOT NULL AND scanned_at IS NOT NULL").withWatermark("scanned_at", delay)
    sliced = timed.select(
        "user_id", "email_id", "scanned_at", F.col("risk_score").cast("double").alias("risk_score"),
        (F.floor(F.unix_seconds("scanned_at") / seconds) * seconds).alias("slice"),
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"),
    )
    threshold = cfg.threshold

    def held(state: GroupState) -> list[np.ndarray]:
        users, n, blocked, after = state.get
        return [*(np.frombuffer(part, "int64") for part in (users, n, blocked)), np.frombuffer(after, "uint8").reshape(-1, ac.STATES)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = int(key[1])
        if state.hasTimedOut:
            users, n, blocked, after = held(state)
            closed = state.getCurrentWatermarkMs()
            state.remove()
            for at in range(0, len(users), FOLD_ROWS):
                part = slice(at, at + FOLD_ROWS)
                yield pd.DataFrame({
                    "user_id": users[part], "slice": start, "closed_ms": closed, "n_scans": n[part], "n_blocked": blocked[part],
                    "after": list(after[part].astype("int32")),
                })
            return
        rows = pd.concat([b[["user_id", "scanned_at", "email_id", "risk_score"]] for b in batches])
        rows = rows.sort_values(["user_id", "scanned_at", "email_id"], kind="stable")
        found = _fold_users(rows["user_id"].to_numpy("int64"), rows["risk_score"].to_numpy("float64"), threshold)
        if state.exists:  # what is held comes first
            users, n, blocked, after = map(np.concatenate, zip(held(state), found))
            order = np.argsort(users, kind="stable")
            users = users[order]
            first = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
            found = users[first], np.add.reduceat(n[order], first), np.add.reduceat(blocked[order], first), ac.fold_tables(users, after[order])
        state.update((*(part.astype("int64").tobytes() for part in found[:3]), found[3].tobytes()))
        state.setTimeoutTimestamp(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    closed = sliced.groupBy("bucket", "slice").applyInPandasWithState(
        step, SLICE, SLICE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return closed.select(
        "user_id", F.timestamp_seconds("slice").alias("slice_start"), F.timestamp_millis("closed_ms").alias("closed_at"),
        "n_scans", "n_blocked", "after",
    )


def state_from_slices(slices: DataFrame) -> DataFrame:
    """Totals, blocked messages and weighted risk per user after its closed slices, in order of time."""
    chained = slices.groupBy("user_id").agg(
        F.sum("n_scans").alias("total_scanned"), F.sum("n_blocked").alias("phishing_blocked"),
        F.array_sort(F.collect_list(F.struct("slice_start", "closed_at", "after"))).alias("_runs"),
    )
    risk = F.aggregate("_runs", F.lit(0), lambda s, r: F.element_at(r["after"], s + 1))
    return chained.select("user_id", "total_scanned", "phishing_blocked", risk.alias("weighted_risk"))


def high_risk(scored: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Verdicts worth a push notification."""
    return scored.filter(F.col("risk_score") >= cfg.push_score).select(
        "msg_id", "user_id", "sender", "subject", "risk_score"
    )


def per_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """Run ``step(batch, number)`` for every micro-batch of what is available."""
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def notify_step(folder: str) -> Callable[[DataFrame, int], None]:
    """Append high-risk rows; each micro-batch owns one folder."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number:012d}")

    return step


def store_step(
    store: BucketedStore, model_ready: bool, cfg: ScoringConfig = DEFAULT
) -> Callable[[DataFrame, int], None]:
    """Advance the verdict store by one micro-batch of messages; only the buckets of its messages are rewritten."""

    def step(batch: DataFrame, number: int) -> None:
        store.advance(batch, number, model_ready, lambda due: score_stream(due, cfg), cfg)

    return step


def user_state_step(folder: str) -> Callable[[DataFrame, int], None]:
    """Advance totals, blocked counts and weighted risk by one micro-batch of verdicts."""

    def step(batch: DataFrame, number: int) -> None:
        after = ac.advance_user_state(read_user_state(batch.sparkSession, folder, number - 1), batch)
        after.write.mode("overwrite").parquet(f"{folder}/state-{number:012d}")

    return step


def read_user_state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], ac.USER_STATE)
    return spark.read.schema(ac.USER_STATE).parquet(f"{folder}/state-{number:012d}")


def run_to_end(writer: DataStreamWriter) -> None:
    """Process everything available."""
    writer.start().awaitTermination()


def newest_version(spark: SparkSession, folder: str, prefix: str) -> int:
    """Highest number among the complete folders ``prefix-<number>``, -1 if there is none.

    Read from the folder itself, wherever it lies: a restarted stream that finds nothing new reports no batch.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{prefix}-")]
    done = [p.getName() for p in names if fs.exists(p.suffix("/_SUCCESS"))]
    return max((int(n.rpartition("-")[2]) for n in done), default=-1)
