"""The verdict store and known-sender lists against a one-by-one replay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import text as tx
from mailrisk.operators import accounts as ac
from mailrisk.operators import ensemble as en
from mailrisk.operators import store as st
from mailrisk.operators import trust as tr
from mailrisk.operators.bucketed import BucketedStore
from mailrisk.session import materialise
from mailrisk.streaming import messages as ms

SCHEMA = "msg_id long, user_id long, sender string, subject string, content string, scanned_at timestamp"
PIECES = [
    "hello", "verify your account", "click here http://bit.ly/x", "לחץ כאן", "meeting notes " * 8,
    "your account has been suspended http://192.0.2.5/a http://b.org http://c.org", "x" * 520, "y" * 520,
]


def random_messages(seed, n=240):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.5
        rows.append((
            i, 1 if hot else rng.randrange(4), "security@paypa1-verify.com" if hot else rng.choice(["a@b.com", "c@d.org"]),
            "subject", " ".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 4))),
            start + timedelta(minutes=7 * i + rng.randrange(3)),
        ))
    return rows


def one_by_one(rows, verdict, batch_of):
    """Plain replay: (store, newly flagged). ``verdict`` maps msg_id to (score, rules_only)."""
    store, flagged = {}, []
    for r in sorted(rows, key=lambda r: (batch_of(r), r[5], r[0])):
        msg, user, sender, subject, content, _ = r
        key, batch = (user, sender, subject[:200]), batch_of(r)
        old = store.get(key)
        score = verdict[batch == 0][msg]
        if old is not None:
            current = old["rules_only"] is False or batch == 0
            if current and (old["text"] == content or len(content) < len(old["text"][:500])):
                continue
        if score >= 70 and not (old and old["score"] >= 70):
            flagged.append(msg)
        store[key] = {"id": old["id"] if old else msg, "text": content, "score": score, "rules_only": batch == 0}
    return store, flagged


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_by_one(spark, seed):
    rows = random_messages(seed)
    batch_of = lambda r: r[0] * 3 // len(rows)
    df = spark.createDataFrame([(*r, batch_of(r)) for r in rows], SCHEMA + ", batch int")
    model = F.when(F.col("batch") > 0, (tx.draw("m", tx.fingerprint(F.col("content"))) % 10001) / 100.0)
    verdicts = materialise(en.score_ensemble(df.withColumn("model_score", model)), "test-verdicts")
    score = {r.msg_id: r.risk_score for r in verdicts.collect()}
    store, flagged = st.empty_store(spark), []
    for n in range(3):
        batch = verdicts.filter(F.col("batch") == n)
        plan = st.plan_scans(store, batch, model_ready=n > 0)
        after, new = st.apply_scans(store, batch, plan)
        flagged += [r.msg_id for r in new.collect()]
        store = materialise(after, "test-store")
    want, want_flagged = one_by_one(rows, {True: score, False: score}, batch_of)
    got = {(r.user_id, r.sender, r.subject): r for r in store.collect()}
    assert set(got) == set(want) and sorted(flagged) == sorted(want_flagged)
    for key, w in want.items():
        g = got[key]
        assert (g.email_id, g.risk_score, g.content) == (w["id"], w["score"], w["text"][:500])
        assert g.scoring_version == (CFG.rules_only_version if w["rules_only"] else CFG.version)
    assert st.rules_backlog(store).count() == sum(w["rules_only"] for w in want.values())


def test_stream_equals_batch(spark, tmp_path):
    rows = random_messages(3, 60)
    for part in range(3):
        spark.createDataFrame(rows[part * 20:(part + 1) * 20], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    kept = BucketedStore(str(tmp_path / "out"), 16)
    stream = ms.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    run = ms.per_batch(stream, ms.store_step(kept, False), str(tmp_path / "cp"))
    ms.run_to_end(run)
    last = ms.newest_version(spark, kept.folder, "manifest")
    assert last == 2 and ms.newest_version(spark, str(tmp_path / "none"), "manifest") == -1
    ms.run_to_end(run)  # a restart that finds nothing new
    assert ms.newest_version(spark, kept.folder, "manifest") == 2
    got = {(r.user_id, r.sender): r.risk_score for r in kept.read(spark, last).collect()}
    df = spark.createDataFrame(rows, SCHEMA)
    score = {r.msg_id: r.risk_score for r in ms.score_stream(df).collect()}
    versions = [kept.read(spark, n).count() for n in range(3)]
    assert versions == sorted(versions) and len(got) == versions[-1]
    want, _ = one_by_one(rows, {True: score, False: score}, lambda r: 0)
    assert set(got) == {(k[0], k[1]) for k in want}


def test_a_small_batch_writes_its_own_buckets_only(spark, tmp_path):
    at = datetime(2024, 1, 1)
    first = [(i, i, f"a{i}@b.com", "s", "hello there", at) for i in range(400)]
    small = [(1000 + i, 40 * i, f"a{40 * i}@b.com", "s", "hello there, and more", at) for i in range(8)]
    small += [(1100, 7, "a7@b.com", "s", "hello there", at), (1101, 9000, "new@b.com", "s", "x", at)]
    kept = BucketedStore(str(tmp_path / "s"), 64)
    step = ms.store_step(kept, False)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (first, small)]
    step(frames[0], 0)
    (tmp_path / "s" / "data-000000000001" / "bucket=3").mkdir(parents=True)  # what a batch that stopped half way leaves
    assert ms.newest_version(spark, kept.folder, "manifest") == 0
    step(frames[1], 1)
    step(frames[1], 1)  # the batch again, as after a restart
    written = {p.name for p in (tmp_path / "s" / "data-000000000001").glob("bucket=*")}
    held = kept.manifest(spark, 1)
    assert {f"bucket={b}" for b, v in held.items() if v == 1} == written and len(written) <= 9
    assert set(held) == set(kept.manifest(spark, 0)) | {int(b[7:]) for b in written} and set(held.values()) == {0, 1}
    plan = st.plan_scans(kept.read(spark, 0), frames[1], False)
    whole, _ = st.apply_scans(kept.read(spark, 0), ms.score_stream(frames[1]), plan)
    assert sorted(kept.read(spark, 1).collect()) == sorted(whole.collect())
    assert {r.user_id: r.email_id for r in kept.read(spark, 1).collect()}[9000] == 1101
    before = sorted(kept.read(spark, 1).collect())
    replaced = [b for b in written if (tmp_path / "s" / "data-000000000000" / b).exists()]
    assert kept.drop_before(spark, 1) == len(replaced)
    assert sorted(kept.read(spark, 1).collect()) == before and ms.newest_version(spark, kept.folder, "manifest") == 1
    step(frames[0].limit(0), 2)
    assert kept.manifest(spark, 2) == held and sorted(kept.read(spark, 2).collect()) == before
    step(frames[1], 3)
    assert kept.manifest(spark, 3) == held


def test_user_state_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    events = [(i, 0 if i % 3 else rng.randrange(5), datetime(2024, 1, 1) + timedelta(minutes=i), round(rng.random() * 100, 2)) for i in range(300)]
    df = spark.createDataFrame(events, "email_id long, user_id long, scanned_at timestamp, risk_score double").withColumn("is_phishing", F.col("risk_score") >= 70)
    state = spark.createDataFrame([], ac.USER_STATE)
    for low in (0, 100, 200):
        state = materialise(ac.advance_user_state(state, df.filter(F.col("email_id").between(low, low + 99))), "test-state")
    whole = ac.advance_user_state(spark.createDataFrame([], ac.USER_STATE), df)
    assert sorted(state.collect()) == sorted(whole.collect())


def _risk_after(scores, state=0):
    for x in scores:
        state = state if x is None else int((state * 0.8 + x * 0.2 + 0.5) // 1)
    return state


def test_runs_of_messages_fold_like_single_steps(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(400)), i,
             rng.choice([None, 0.0, 100.0, round(rng.random() * 100, 2)])) for i in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs go on across batches
    try:
        df = spark.createDataFrame(rows, "user_id long, scanned_at timestamp, email_id long, risk_score double")
        got = {r.user_id: (r.n_messages, r.weighted_risk) for r in ac.weighted_user_risk(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for user in (None, 1, 2, 3):
        own = [r[3] for r in sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3])]
        want[user] = (len(own), _risk_after(own))
    assert got == want
    assert ac.weighted_user_risk(df.limit(0)).count() == 0


def test_keyed_state_survives_restarts_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(i, 0 if i % 3 else rng.randrange(1, 5), start + timedelta(minutes=7 * i), rng.choice([None, round(rng.random() * 100, 2)]) if i % 5 == 0
             else round(rng.random() * 100, 2)) for i in range(200)]
    schema = "email_id long, user_id long, scanned_at timestamp, risk_score double"
    odd = [(900, None, start, 5.0), (901, 1, None, 5.0)]  # no user, no time: in no slice
    late = [(902, 1, start, 99.0)]  # comes days after its hour was written
    ahead = [(999, -1, start + timedelta(days=30), 1.0)]  # its time passes all other slices

    def deliver(files):
        for number, part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{number:03d}"))
        stream = ms.read_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
        ms.run_to_end(
            ms.user_slices(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
        return spark.read.parquet(str(tmp_path / "out"))

    first = deliver([(n, rows[40 * n:40 * n + 40]) for n in range(3)])
    # Hours that the watermark has not passed yet are held back.
    assert 0 < first.agg(F.sum("n_scans")).first()[0] < 120
    deliver([(3, rows[120:160] + odd), (4, rows[160:])])
    slices = deliver([(5, late), (6, ahead)])
    got = {r.user_id: tuple(r)[1:] for r in ms.state_from_slices(slices).collect()}
    want = {}
    for user in range(5):
        own = [r[3] for r in rows if r[1] == user]
        want[user] = (len(own), sum(x is not None and x >= CFG.threshold for x in own), _risk_after(own))
    assert got == want
    assert slices.groupBy("user_id", "slice_start").count().filter("count > 1").isEmpty()


def test_users_of_an_hour_share_the_keys_of_the_state_store(spark, tmp_path):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    rows = [(i, i % 150, start + timedelta(seconds=rng.randrange(7200)), float(rng.randrange(101))) for i in range(900)]
    schema = "email_id long, user_id long, scanned_at timestamp, risk_score double"
    parts = [rows[:450], rows[450:], [(999, -1, start + timedelta(days=1), 1.0)]]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{number:03d}"))
    query = ms.user_slices(ms.read_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1), delay="3 hours").writeStream
    query = query.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(keys) <= 2 * ms.SLICE_BUCKETS + 1  # not one for every user and hour
    got = {r.user_id: (r.total_scanned, r.phishing_blocked, r.weighted_risk) for r in ms.state_from_slices(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {}
    for user in range(150):
        own = sorted((r[2].replace(minute=0, second=0), part, r[2], r[0], r[3]) for part in (0, 1) for r in parts[part] if r[1] == user)
        want[user] = (len(own), sum(r[4] >= CFG.threshold for r in own), _risk_after([r[4] for r in own]))
    assert got == want


def test_normalise_entries(spark):
    raws = {
        "  Ann@B.com ": ("ann@b.com", False, None), "\tfoo@bar.com\n": ("foo@bar.com", False, None), "@Studio.org": ("studio.org", True, None), "": ("", False, "empty"),
        "a@b": ("a@b", False, "bad_address"), "nodots": ("nodots", True, "bad_domain"),
        "gmail.com": ("gmail.com", True, "free_provider"), "my.friend@gmail.com": ("my.friend@gmail.com", False, None),
    }
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", tr.normalise_entry(F.col("raw")).alias("n"))
    assert {r.raw: tuple(r.n) for r in df.collect()} == raws


def test_trust_requests_are_refused_on_evidence_and_idempotent(spark):
    at = datetime(2024, 1, 1)
    emails = spark.createDataFrame(
        [
            (1, 7, "service@bank-leumi-secure.com", "בנק לאומי: חשבונך ייחסם", "זוהתה פעילות חריגה בחשבונך. http://bank-leumi-secure.com/verify", at, "v"),
            (2, 7, "office@dance-studio.com", "לוח שיעורים", "שלום", at, "v"),
            (3, 8, "office@dance-studio.com", "לוח שיעורים", "שלום", at, "v"),
            (4, 7, "a_b@wild.org", "hi", "hi", at, "v"), (5, 7, "aXb@wild.org", "hi", "hi", at, "v"),
        ],
        "email_id long, user_id long, sender string, subject string, content string, scanned_at timestamp, scoring_version string",
    )
    entries = spark.createDataFrame([(7, "dance-studio.com", True)], "user_id long, value string, is_domain boolean")
    asked = spark.createDataFrame(
        [(7, "service@bank-leumi-secure.com", 1), (7, "dance-studio.com", 2), (7, "teacher@x.org", 3), (7, "TEACHER@x.org", 4), (7, "gmail.com", 5)],
        "user_id long, raw string, requested_at long",
    )
    got = {r.value: r.outcome for r in tr.add_entries(asked, entries, emails).collect()}
    assert got == {
        "service@bank-leumi-secure.com": "evidence", "dance-studio.com": "unchanged", "teacher@x.org": "added", "gmail.com": "free_provider",
    }
    wild = spark.createDataFrame([(7, "a_b@wild.org", False)], entries.schema)
    cleared, counts = tr.invalidate(emails, entries.unionByName(wild))
    assert {r.email_id for r in cleared.collect() if r.scoring_version == ""} == {2, 4, 5}
    assert {r.value: r.n_rescored for r in counts.collect()} == {"dance-studio.com": 1, "a_b@wild.org": 2}
    left, outcome, cleared = tr.remove_and_invalidate(entries, asked, emails)
    assert left.count() == 0 and {r.value: r.outcome for r in outcome.collect()}["dance-studio.com"] == "removed"
    assert {r.email_id for r in cleared.collect() if r.scoring_version == ""} == {2}


def test_a_very_long_sender_is_matched(spark):
    sender = "x" * 5000 + "@a.org" + "y" * 5000 + "@end.com"
    pairs = spark.createDataFrame([(1, sender), (1, "q@b.org")], "user_id long, sender string")
    entries = spark.createDataFrame(
        [(1, "x@a.org", False), (1, "end.com", True), (1, "q@c.org", False)], "user_id long, value string, is_domain boolean"
    )
    assert {(r.value, r.sender[:1]) for r in tr.matched_senders(pairs, entries).collect()} == {("x@a.org", "x"), ("end.com", "x")}


def test_trust_covers_subdomains_of_its_own_user_only(spark):
    entries = spark.createDataFrame([(1, "studio.com", True), (2, "ann@b.com", False)], "user_id long, value string, is_domain boolean")
    mail = spark.createDataFrame(
        [(1, 1, "t@mail.studio.com"), (2, 1, "t@notstudio.com"), (3, 2, " Ann@B.com"), (4, 1, "ann@b.com"), (5, 2, None)],
        "msg_id long, user_id long, sender string",
    )
    got = {r.msg_id for r in tr.with_user_trust(mail, entries).collect() if r.user_trusted}
    assert got == {1, 3}


def test_texts_are_cut_before_they_meet_their_keys(spark, monkeypatch):
    rows = spark.createDataFrame(random_messages(3)[:20], SCHEMA).withColumn("model_score", F.lit(90.0))
    plan = st.plan_scans(st.empty_store(spark), rows, True)
    seen = {}
    monkeypatch.setattr(st, "materialise", lambda df, name: seen.setdefault(name, df))
    st.apply_scans(st.empty_store(spark), en.score_ensemble(rows), plan)
    tree = seen["scan-fresh"]._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(content" not in tree[: tree.index("Join")]
