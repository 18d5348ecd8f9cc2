"""Golden messages and links: exact scores, bands and reasons."""

from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, bands_for
from mailrisk.functions import domains as dm
from mailrisk.functions import text as tx
from mailrisk.functions import verdicts as vd
from mailrisk.operators import ensemble as en
from mailrisk.operators import mail_rules as mr
from mailrisk.operators import url_rules as ur
from mailrisk.plans.mail_view import mail_view

# Points follow from the rule weights: strong 15 each to 40, weak 4 each to 16, urgency 15, lookalike sender 25, odd
# suffix 20, more than two links 20, brand in subject 45 or body 30, IP link 25, shortener 15, official words on
# free mail 30.
MAIL = [
    (0, "ella@garden-club.org", "Spring walk", "We meet at the north gate and bring tea."),
    (15, "desk@printshop.com", "Paper", "The sale ends today at six."),
    (15, "desk@printshop.com", "Catalogue", "To see it click here please."),
    (55, "desk@printshop.com", "Notes", "Act now and click here for the tax refund."),
    (16, "desk@printshop.com", "Words", "account, bank, password, invoice, login"),
    (25, "hello@vvater.org", "Hi", "See you."),
    (20, "me@odd.zzz", "Hi", "See you."),
    (20, "desk@printshop.com", "Links", "https://a.org/1 https://b.org/2 https://c.org/3"),
    (25, "desk@printshop.com", "Router", "It answers at http://10.0.0.9/a"),
    (15, "desk@printshop.com", "Map", "Here: cutt.ly/abc"),
    (30, "x.y@yahoo.com", "Hi", "A message of the ministry."),
    (45, "ann@plain.net", "Netflix", "hi"),
    (30, "ann@plain.net", "hi", "Your Dropbox folder: https://plain.net/x"),
    (100, "it@vvork.zzz", "Netflix", "Act now, click here."),
    (15, "ella@garden-club.org", "שלום", "מחר תיערך הגרלה."),
    (0, "info@mail.dropbox.com", "Dropbox", "Your folder is ready."),
    (0, "ann@plain.net", "hi", "The Dropbox help: https://www.dropbox.com/help"),
    (0, "ship@ksp.co.il", "Your order", "It is on its way."),
    (0, "team@github.com", "Weekly digest", "Three new issues."),
    (8, "desk@printshop.com", "Your invoice", "Viewing it is free of charge."),
    (0, "ann@plain.net", "The next step", "A partner joins us at https://plain.net/x"),
]
SHIPPED, KNOWN, BILLED, BRANDED, PUSHY = 17, 18, 19, 11, 3


def mail_frame(spark):
    rows = [(i, *row) for i, row in enumerate(MAIL)]
    return spark.createDataFrame(rows, "msg_id int, want int, sender string, subject string, content string")


def test_golden_messages(spark):
    got = {r.msg_id: r for r in mr.score_mail(mail_frame(spark)).collect()}
    for i, row in enumerate(MAIL):
        assert got[i].rule_score == row[0], (row, got[i])
        assert got[i].is_phishing == (row[0] >= 70)
    assert got[0].rule_indicators == [lx.NOTHING_FOUND] and got[0].recommendation == lx.ADVICE_SAFE
    assert got[1].recommendation == lx.ADVICE_WEAK_SIGNS


def test_null_fields_count_as_empty(spark):
    row = spark.createDataFrame([(None, None, None)], "sender string, subject string, content string")
    assert mr.score_mail(row).first().rule_score == 0


def test_hits_equal_a_plain_search(spark):
    mail = mail_view(spark, "/root/testdata/sf0.001").select("msg_id", "sender", "subject", "content")
    both = mail.unionByName(mail_frame(spark).selectExpr("-1 - msg_id AS msg_id", "sender", "subject", "content"))
    rows = mr.prepare(both).select("_sender", "_subject", "_content", "_hits").collect()
    assert len(rows) > 200
    for r in rows:
        full, spoken = f"{r._sender} {r._subject} {r._content}", f"{r._subject} {r._content}"
        hits, brands = r._hits, list(lx.BRANDS)
        assert hits.n_strong == sum(t in full for t in set(lx.STRONG_TERMS))
        assert hits.n_weak == sum(t in full for t in set(lx.WEAK_TERMS))
        assert hits.urgent == any(t in full for t in lx.URGENCY_TERMS)
        assert hits.attack == any(t in spoken for t in lx.ATTACK_TERMS)
        assert hits.promo == any(t in spoken for t in lx.PROMO_TERMS)
        assert hits.order_words == any(t in spoken for t in lx.TRANSACTION_TERMS)
        assert hits.official == any(t in r._subject or t in r._content for t in lx.OFFICIAL_TERMS)
        assert hits.shortener == any(t in r._content for t in lx.MAIL_SHORTENERS)
        assert hits.brands_subject == [i for i, b in enumerate(brands) if b in r._subject]
        assert hits.brands_content == [i for i, b in enumerate(brands) if b in r._content]


def test_term_crossing_subject_and_content_counts_once_as_spoken(spark):
    row = spark.createDataFrame([("a@b.com", "please verify", "your account soon")], "sender string, subject string, content string")
    got = mr.with_legitimacy(mr.score_prepared(mr.prepare(row))).first()
    assert got.asks_credentials and got.n_strong == 1


def test_golden_links(spark):
    want = {
        "http://192.168.0.1/login": 75, "https://google.com/": 0, "https://accounts.google.com": 30,
        "paypa1.com": 55, "https://bit.ly/x": 20, "abc": 0, "": 0, "http://[::1": 50,
        "https://www.paypal.com": 0, "https://a.b.c.example.org/" + "x" * 90: 25,
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r.url: r for r in ur.score_urls(df).collect()}
    assert {u: r.url_score for u, r in got.items()} == want
    assert got["http://192.168.0.1/login"].is_dangerous
    assert got["abc"].url_level == lx.URL_INVALID_LEVEL and got["http://[::1"].url_level == lx.URL_BROKEN_LEVEL


def test_ensemble_cases(spark):
    rows = [
        # model, sender, subject, content, trusted by user, wanted final score
        (100.0, "x@plain-firm.com", "hello", "nothing", False, 83.0),
        (100.0, "me@odd.zzz", "hi", "hi", False, 100.0),
        (0.0, *MAIL[PUSHY][1:], False, 55.0),
        (99.99, *MAIL[KNOWN][1:], False, 24.9975),
        (99.99, *MAIL[SHIPPED][1:], False, 9.999),
        (100.0, *MAIL[BRANDED][1:], True, 47.5),
        (None, *MAIL[BILLED][1:], False, 8.0),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "msg_id int, model_score double, sender string, subject string, content string, user_trusted boolean, want double",
    )
    got = en.score_ensemble(df).orderBy("msg_id").collect()
    assert [round(r.final_score, 6) for r in got] == [r[-1] for r in rows]
    assert got[0].indicators[-1] == lx.NO_TECHNICAL_SIGNS and lx.NOTHING_FOUND not in got[0].indicators
    assert got[6].scoring_version.endswith("|rules") and not got[5].scoring_version.endswith("|rules")


def test_user_trust_never_silences_the_rules(spark):
    df = mail_frame(spark).withColumn("model_score", F.lit(99.0)).withColumn("user_trusted", F.lit(True))
    for r in en.score_ensemble(df).collect():
        assert 0 <= r.rule_score <= r.risk_score <= 100


def test_bands_and_rounding(spark):
    assert bands_for(70) == (42, 70, 84) and DEFAULT.ceiling == 83
    assert DEFAULT.version == "v6|b0.5|t0.25|x0.1|th70"
    t = spark.range(0, 101).select(F.col("id").cast("int").alias("t")).select("t", vd.bands_column(F.col("t")).alias("b"))
    for r in t.collect():
        assert (r.b.low, r.b.medium, r.b.high) == bands_for(r.t)
    values = [2.675, 42.125, 0.125, 0.375, 28.9975, 12.345, 99.995, 1.005, 0.0, 100.0] + [i / 1000 for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", tx.round_half_even_exact(F.col("x"), 2).alias("y"), tx.round_half_even_exact(F.col("x"), 1).alias("z")).collect():
        assert r.y == round(r.x, 2) and r.z == round(r.x, 1), r


def test_domain_functions(spark):
    df = spark.createDataFrame(
        [("Ann <a.b+x@Mail.GOOGLE.com.>", "https://user@A.b.co.il:8080/x?y#z")], "s string, u string"
    )
    r = df.select(
        dm.sender_domain(F.col("s")).alias("d"), dm.url_host(F.col("u")).alias("h"),
        dm.canonical_mailbox(F.lit(" L.y.nn+m@GoogleMail.com")).alias("m"),
        dm.same_organisation(F.lit("mail.foo.com"), F.lit("mail.bar.com")).alias("loose"),
        dm.same_organisation(F.lit("mail.foo.com"), F.lit("mail.bar.com"), strict=True).alias("strict"),
        dm.same_organisation(F.lit("a.shop.co.il"), F.lit("shop.co.il"), strict=True).alias("strict_il"),
        tx.head_and_tail(F.lit("x" * 7000)).alias("cut"), tx.snippet(F.lit("a  b\nc"), 3).alias("sn"),
    ).first()
    assert (r.d, r.h, r.m) == ("mail.google.com", "a.b.co.il", "lynn@gmail.com")
    assert r.loose and not r.strict and r.strict_il
    assert len(r.cut) == 5505 and r.sn == "a b..."
