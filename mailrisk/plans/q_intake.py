"""Registered queries that load, write and read back: corpora, splits, message files, stores and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.operators import accounts as ac
from mailrisk.operators import backfill as bf
from mailrisk.operators import corpus as cp
from mailrisk.operators import store as st
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import corpus_view, mail_view, raw_view
from mailrisk.plans.q_accounts import BASE, users
from mailrisk.plans.q_corpus import FILL_SQL, SPLIT_SQL, filled
from mailrisk.plans.registry import ORACLES, QUERIES, register
from mailrisk.session import work_dir
from mailrisk.sources import labelled as lb
from mailrisk.sources import sinks
from mailrisk.streaming import messages as ms


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Half of the rows of every document are copies here: an exact count must not depend on that.
_TWICE = "T2 AS (SELECT label, text FROM C UNION ALL SELECT label, text FROM C)"


@register("negative_corpus", f"""WITH {ob.CORPUS}, {_TWICE}, N AS (SELECT count(*) AS n FROM T2)
SELECT 'all' AS kind, n AS n_rows, 0 AS n_positive FROM N
UNION ALL SELECT 'sample', least(n, 333), 0 FROM N UNION ALL SELECT 'one', least(n, 1), 0 FROM N""")
def negative_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of one class, whole and as exact samples, although every text occurs twice."""
    once = corpus_view(spark, sf_dir).select("lang", "text")
    twice = once.unionByName(once)
    frames = {"all": lb.negative_corpus(twice), "sample": lb.negative_corpus(twice, 333), "one": lb.negative_corpus(twice, 1)}
    out = None
    for kind, rows in frames.items():
        counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).cast("int").alias("n_positive"))
        part = counted.select(F.lit(kind).alias("kind"), "n_rows", "n_positive")
        out = part if out is None else out.unionByName(part)
    return out


@register("training_frames", f"""WITH {ob.CORPUS}, {_TWICE}, Z AS (SELECT label, count(*) AS n FROM T2 GROUP BY label),
K AS (SELECT label, n, (n - ceil(n * 3e-1))::BIGINT AS tr, floor((n - (n - ceil(n * 3e-1))) / 2e0)::BIGINT AS va FROM Z),
U AS (SELECT label, unnest([{{'s': 'train', 'k': tr}}, {{'s': 'val', 'k': va}}, {{'s': 'test', 'k': n - tr - va}}]) AS x FROM K)
SELECT label, x.s AS split, x.k AS n_rows FROM U WHERE x.k > 0""")
def training_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames stacked and split 70/15/15 within each label, repeated rows and all."""
    frame = corpus_view(spark, sf_dir).select("text", "label", "source")
    loaded = lb.load_training(spark, None, [frame, frame, spark.read.parquet(f"{sf_dir}/pages.parquet")])
    return loaded.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("training_frames_prepared", f"""WITH {ob.CORPUS}, {SPLIT_SQL.format(src='C')}
SELECT split, label, count(*) AS n_rows FROM SP WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY split, label""")
def training_frames_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared splits are taken as they are, whatever raw frames there are besides."""
    path = _written_splits(spark, sf_dir)
    loaded = lb.load_training(spark, path, [corpus_view(spark, sf_dir).select("text", "label", "source")])
    return loaded.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def _written_splits(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "splits")
    sinks.write_splits(cp.stratified_split(corpus_view(spark, sf_dir)).drop("lang", "source_rank"), path)
    return path


@register("prepared_splits", f"""WITH {ob.CORPUS}, {SPLIT_SQL.format(src='C')}
SELECT split, count(*) AS n_rows, sum(label)::BIGINT AS n_positive, sum(length(text))::BIGINT AS n_chars,
  count(*) AS n_no_sender FROM SP GROUP BY split""")
def prepared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written one folder each, and read back with content taken from the text column."""
    path = _written_splits(spark, sf_dir)
    out = None
    for name in cp.SPLITS:
        rows = lb.load_split(spark, path, name)
        part = rows.groupBy("split").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"),
            F.sum(F.char_length("content")).alias("n_chars"), F.count_if(F.col("sender") == "").alias("n_no_sender"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@register("diagnostic_rows", f"""WITH {ob.CORPUS}, {SPLIT_SQL.format(src='C')}, N AS (SELECT count(*) AS n FROM SP WHERE split = 'train' AND text IS NOT NULL)
SELECT 'all' AS kind, n AS n_rows FROM N UNION ALL SELECT 'bounded', least(n, 120) FROM N""")
def diagnostic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written_splits(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n_rows")
    whole = lb.load_diagnostic(spark, path, 0).agg(count).select(F.lit("all").alias("kind"), "n_rows")
    return whole.unionByName(lb.load_diagnostic(spark, path, 120).agg(count).select(F.lit("bounded").alias("kind"), "n_rows"))


@register("rich_sources", f"""WITH {ob.RAW}
SELECT 'mailbox' AS source, label, count(*) AS n_rows, count(*) FILTER (WHERE sender <> '') AS n_sender, 0::BIGINT AS n_subject FROM R GROUP BY label
UNION ALL SELECT 'plain', CASE WHEN label = 1 THEN 1 ELSE 0 END, count(*), 0, 0 FROM R GROUP BY 2""")
def rich_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora with and without sender and subject; True and False as labels of one."""
    raw = raw_view(spark, sf_dir)
    rich = lb.rich_corpus(raw.drop("source"), "mailbox")
    spelled = F.when(F.col("label") == 1, "True").otherwise("False")
    plain = lb.rich_corpus(raw.select("text", spelled.alias("label")), "plain")
    return cp.union_sources([rich, plain]).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("sender") != "").alias("n_sender"),
        F.count_if(F.col("subject") != "").alias("n_subject"),
    )


@register("json_intake", f"""WITH {ob.MAIL}
SELECT user_id, count(*) AS n_messages, sum(length(content))::BIGINT AS n_chars, count(DISTINCT md5(content)) AS n_texts,
  min(at_epoch)::BIGINT AS first_at, max(at_epoch)::BIGINT AS last_at, count(DISTINCT sender) AS n_senders FROM M GROUP BY user_id""")
def json_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as one JSON object each and taken in again."""
    path = _folder(spark, "json")
    mail_view(spark, sf_dir).select("msg_id", "user_id", "sender", "subject", "content", "scanned_at").write.json(path)
    return ms.read_batch(spark, path).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.char_length("content")).alias("n_chars"),
        F.count_distinct(F.md5("content")).alias("n_texts"), F.min(F.unix_timestamp("scanned_at")).alias("first_at"),
        F.max(F.unix_timestamp("scanned_at")).alias("last_at"), F.count_distinct("sender").alias("n_senders"),
    )


@register("filled_store", f"""SELECT label, sender_pool, count(*) AS n_rows, count(DISTINCT sender_filled) AS n_senders
FROM ({ORACLES['sender_backfill']}) GROUP BY label, sender_pool""")
def filled_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus stored with its filled senders, without helper columns, and read back."""
    path = _folder(spark, "filled")
    bf.write_filled(raw_view(spark, sf_dir), filled(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("label", "sender_pool").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sender").alias("n_senders")
    )


@register("error_files", f"""SELECT kind, source, count(*) AS n_rows, count(DISTINCT msg_id) AS n_messages FROM ({ORACLES['error_mining']}) GROUP BY kind, source""")
def error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "errors")
    sinks.write_errors(QUERIES["error_mining"](spark, sf_dir), path)
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return found.groupBy("kind", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("msg_id").alias("n_messages")
    )


@register("curve_file", f"SELECT count(*) AS n_points, sum(tp)::BIGINT AS tp_sum, sum(fp)::BIGINT AS fp_sum FROM ({ORACLES['threshold_curve']})")
def curve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "curve")
    sinks.write_report(QUERIES["threshold_curve"](spark, sf_dir), path)
    points = spark.read.option("header", True).csv(path)
    total = lambda c: F.sum(F.col(c).cast("bigint")).alias(f"{c}_sum")
    return points.agg(F.count(F.lit(1)).alias("n_points"), total("tp"), total("fp"))


@register("evolved_store", f"""WITH {ob.MAIL} SELECT user_id, '' AS scoring_version, 'unknown' AS channel, count(*) AS n_rows FROM M GROUP BY user_id""")
def evolved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table that predates two columns is read with their defaults."""
    path = _folder(spark, "old")
    mail_view(spark, sf_dir).select("msg_id", "user_id", "sender").write.parquet(path)
    now = st.evolve(spark.read.parquet(path), {"scoring_version": "", "channel": "unknown", "sender": "x"})
    return now.groupBy("user_id", "scoring_version", "channel").agg(F.count(F.lit(1)).alias("n_rows"))


_NAMED = [" CUSTOMER.000000004@example.org", "customer.000000008@example.org ", "nobody@example.org"]
_NAMED_SQL = ", ".join(f"'{n.strip().lower()}'" for n in _NAMED)


@register("named_clean_up", f"""WITH {BASE},
OA AS (SELECT * FROM U WHERE NOT has_account AND user_id NOT IN (SELECT guardian_id FROM U WHERE guardian_id IS NOT NULL))
SELECT 'kept' AS list, user_id, email FROM OA WHERE email NOT IN ({_NAMED_SQL})
UNION ALL SELECT 'named', user_id, email FROM U WHERE email IN ({_NAMED_SQL})""")
def named_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts to remove but for a keep-list, and accounts named outright; spelling of case and space is free."""
    people = users(spark, sf_dir)
    loose = ac.orphan_accounts(people, keep=_NAMED).select(F.lit("kept").alias("list"), "user_id", "email")
    named = ac.named_accounts(people, _NAMED).select(F.lit("named").alias("list"), "user_id", "email")
    return loose.unionByName(named)


@register("sender_coverage_by_split", f"""WITH {FILL_SQL}, {SPLIT_SQL.format(src='R')}
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE contains(FL.sender, '@')) AS n_had,
  count(*) FILTER (WHERE sender_extracted <> '') AS n_extracted, count(*) FILTER (WHERE sender_filled <> '') AS n_filled
FROM FL JOIN SP USING (row_id) GROUP BY split""")
def sender_coverage_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = cp.stratified_split(raw_view(spark, sf_dir).select("row_id", "text", "label")).select("row_id", "split")
    return bf.coverage(filled(spark, sf_dir).join(split, "row_id"), ["split"]).drop("n_genuine")


@register("shuffled_corpus", f"""WITH {ob.CORPUS} SELECT row_id, row_number() OVER (ORDER BY md5('shuffle|' || row_id), row_id) AS position FROM C""")
def shuffled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible random order of all rows, as a position."""
    return cp.shuffled(corpus_view(spark, sf_dir).select("row_id")).select("row_id", "position")
