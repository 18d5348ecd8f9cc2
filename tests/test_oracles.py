"""A cross-section of the registered queries against their SQL; ``tests/check.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "mail_rule_score", "url_rule_score", "ensemble_score", "source_balance", "stratified_split", "sender_backfill",
    "threshold_curve", "calibration_best", "error_shares", "first_flag_alerts", "guardian_dashboard", "ewma_user_risk",
    "verdict_upsert_replay", "trust_requests", "labelled_sources", "stream_user_state", "training_frames",
    "negative_corpus", "prepared_splits", "json_intake", "trust_lists", "formula_drift", "exact_auc", "filled_store",
]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = tables.sql(entry.oracle_sql()[name])
    assert got == rows_of(rel.columns, rel.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
