"""Small scenarios of accounts, alerts and stored tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import verdicts as vd
from mailrisk.operators import accounts as ac
from mailrisk.operators import store as st
from mailrisk.sources import labelled as lb
from mailrisk.sources import sinks as sk
from mailrisk.streaming import messages as ms

AT = datetime(2024, 1, 2, 10)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "parent@x.org", "parent", True, None, True), (2, "kid@x.org", "kid", False, 1, False), (3, "stray@x.org", "stray", False, None, True)],
        "user_id long, email string, name string, has_account boolean, guardian_id long, daily_active boolean",
    )


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(
        [(10, 2, "bad@z.tk", "s", AT, 91.5, True), (11, 2, "ok@z.com", "s", AT, 4.0, False), (12, 1, "bad@z.tk", "s", AT, 75.0, True)],
        "email_id long, user_id long, sender string, subject string, scanned_at timestamp, risk_score double, is_phishing boolean",
    )


def test_alerts_name_the_watched_user(spark, people, mails):
    flagged = ac.first_flags(mails, ["user_id", "sender"])
    alerts = ac.alert_rows(flagged, people, vd.risk_level(F.col("risk_score"))).collect()
    assert sorted((a.user_id, a.audience, a.email_id) for a in alerts) == [(1, "guardian", 10), (1, "user", 12), (2, "user", 10)]
    told = [a for a in alerts if a.audience == "guardian"][0].message
    assert told.startswith("kid ") and "91.5%" in told and told.endswith("bad@z.tk")
    board = {r.guardian_id: r for r in ac.guardian_dashboard(people, mails, spark.createDataFrame(alerts), F.lit(AT)).collect()}
    # The guardian's own caught mail stays off the page about the watched account.
    assert len(board[1].recent_alerts) == 1 and board[1].child_name == "kid" and board[1].blocked_today == 1
    assert board[3].recent_alerts is None and board[3].child_email == ""


def test_clean_up_keeps_registered_guarding_and_named_accounts(people, mails):
    assert [r.user_id for r in ac.orphan_accounts(people).orderBy("user_id").collect()] == [2, 3]
    assert [r.user_id for r in ac.orphan_accounts(people, [" Stray@x.org"]).collect()] == [2]
    assert [r.user_id for r in ac.named_accounts(people, ["PARENT@x.org"]).collect()] == [1]
    users, left = ac.delete_accounts(people.filter("user_id = 2"), people, mails)
    assert users.count() == 2 and [r.email_id for r in left.collect()] == [12]


def test_links_follow_the_last_valid_request(spark, people):
    asked = spark.createDataFrame(
        [(1, "parent@x.org", 1), (1, "stray@x.org", 2), (3, "stray@x.org", 3), (1, "new@x.org", 4), (1, "kid@x.org", 5)],
        "guardian_id long, child_email string, requested_at long",
    )
    got = {r.child_email: (r.new_guardian, r.already_linked, r.created) for r in ac.link_guardians(people, asked).collect()}
    assert got == {"stray@x.org": (1, False, False), "new@x.org": (1, False, True), "kid@x.org": (1, True, False)}


def test_old_tables_gain_missing_columns(spark, mails):
    new = st.evolve(mails, {"scoring_version": "", "subject": "unused"})
    assert new.first().scoring_version == "" and new.first().subject == "s"


def test_bands_and_message_intake(spark, tmp_path):
    assert [r.min_score for r in sk.band_table(spark).collect()] == [84, 70, 42, 0]
    (tmp_path / "m.json").write_text('{"msg_id": 1, "user_id": 2, "sender": "a@b.com", "subject": "hi", "content": "x"}\n')
    row = ms.read_batch(spark, str(tmp_path)).first()
    assert (row.msg_id, row.sender, row.scanned_at) == (1, "a@b.com", None)


def test_training_rows_from_raw_frames(spark):
    raw = spark.createDataFrame([(f"text {i}", i % 2) for i in range(100)], "text string, label int")
    other = spark.createDataFrame([("x",)], "body string")
    counts = {r.split: r["count"] for r in lb.load_training(spark, None, [raw, other]).groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 14, "test": 16}
    with pytest.raises(ValueError):
        lb.load_training(spark, None, [other])
