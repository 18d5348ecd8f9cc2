"""Messages derived from the ``documents`` table: one mail per document, over its whole text.

Sender, subject and an appended passage are drawn per row by hash, so the view grows with the
table and reads the same in Spark and in SQL (see ``oracle_base``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions.text import draw, pick
from mailrisk.session import spread

SENDERS = [
    "gardenclub@rosehill-society.org", "deliveries@ksp.co.il", "Marta.Quinn+shop@GMail.com", "dispatch@parcelbird.net",
    "security@accounts.google.com", "no-reply@ebay.com", "helpdesk@paypal-unlock.xyz", "desk@hapoalim-login.top",
    "cal-desk@card-review.info", "admin@microsoft-renewal.club", "cashier@partner-debt.net", "rota@northwind-clinic.org",
    "tomer.bar@gmail.com", "x9@qzt.zzz123", "jobs@mail.linkedin.com", "noreply@stmt.leumi.co.il", "", "", "frontdesk@",
    "updates@mailer.net",
]
SUBJECTS = [
    "Rota for week twelve", "Statement ready", "כאל — פירוט עסקאות", "Parcel on the van today", "Renewal of your plan",
    "Sign-in code asked for", "URGENT - confirm who you are", "הגישה לחשבון הוגבלה", "כאל: עסקה לא מוכרת", "Action required before noon",
    "partner - חוב פתוח", "בנק הפועלים - עדכון פרטים", "Seed swap with a partner club", "Re: order 5518", "Google storage notice", "Choir rehearsal",
]
PASSAGES = [
    "",
    "The seed catalogue is in the hall cupboard; bring your own pots on Sunday.",
    "Parcel 5518 left the depot. Where it is: https://www.ebay.com/where?n=5518",
    "Somebody asked for a sign-in code. https://accounts.google.com/codes You need not do anything.",
    "We suspended your wallet. To keep it, click here: http://paypal-unlock.xyz/keep",
    "נמצאה כניסה ממכשיר זר. יש לאמת את הפרטים: http://hapoalim-login.top/enter",
    "Your Microsoft licence ends; verify your password within the day. http://microsoft-renewal.club/now",
    "להסדרת החוב: https://partner-debt.info/y",
    "Forms at http://198.51.100.7/form and http://tinyurl.com/abc",
    "Maps: http://north.example.org http://south.example.org:8081/p http://me@west.example.org/?k=2 tonight",
    "Half price until Friday, free shipping on all bulbs. Unsubscribe below.",
    "PayPal and Amazon draw: you are a winner, claim your reward at https://lucky.top/go",
    "Receipt 77 and tracking: https://e.ksp.co.il/r/77 https://www.dhl.com/t",
    "see https://www.paypal.com/about on how PayPal keeps records",
    "הנחה לחברי המועדון ומשלוח חינם עד הבית. להסרה לחצו",
]
HEADERS = [
    "From: Ann Lee <{a}>\nTo: you@example.org\nSubject: hello there\nDate: Mon, 1 Jan 2024\n\n",
    "From {a} Mon Jan  1 00:00:00 2024\nReceived: by mx.example.org\nX-Mailer: none\nMessage-ID: 7\n\n",
    "Return-Path: <{a}>\nReceived: by mx.example.org\nTo: you@example.org\nSubject: hi\n\n",
    "From: Ann <{a}> To: you@example.org Subject: flat ",
    "To: {a}\nSubject: hi\nDate: today\n\n",
    "From: owner-list@lists.example.org\nSender: {a}\nTo: you@example.org\nDate: today\n\n",
    "",
    "Please write to {a}, thanks.\n",
    "Dear reader,\nFrom: late@example.org is quoted\n{a} asked\n",
]
MODEL_RANGE = 10001


def h(salt: str) -> Column:
    return draw(salt, F.col("doc_id"))


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic", "quality")
    return spread(documents.select("doc_id", "text", "lang", "source")).join(labels, "doc_id", "left")


def as_mail(documents: DataFrame) -> DataFrame:
    """Messages of a document frame, batch or stream."""
    return documents.select(
        F.col("doc_id").alias("msg_id"),
        (h("u") % 50).alias("user_id"),
        pick(SENDERS, h("s")).alias("sender"),
        pick(SUBJECTS, h("j")).alias("subject"),
        F.concat_ws(" ", F.coalesce("text", F.lit("")), pick(PASSAGES, h("c"))).alias("content"),
        F.timestamp_seconds(1704067200 + h("t") % 2592000).alias("scanned_at"),
        "source",
        "lang",
        ((h("m") % MODEL_RANGE) / F.lit(100.0)).alias("model_score"),
    )


def mail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, user_id, sender, subject, content, scanned_at, source, lang, model_score."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return as_mail(spread(documents.select("doc_id", "text", "lang", "source")))


def with_label(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``label`` to messages. Call it on the narrow result of scoring: the join may shuffle."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("msg_id"), "toxic")
    drawn = F.when(draw("y", F.col("msg_id")) % 100 < 48, 1).otherwise(0)
    joined = df.join(labels, "msg_id", "left")
    return joined.withColumn("label", F.coalesce("toxic", drawn).cast("int")).drop("toxic")


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as raw text with the header shapes found in public corpora, and a sender at times."""
    address = pick([s for s in SENDERS if "." in s.rpartition("@")[2]], h("s"))
    body = F.concat(F.replace(pick(HEADERS, h("r")), F.lit("{a}"), address), F.coalesce("text", F.lit("")))
    label = F.coalesce(F.col("toxic"), F.when(h("y") % 100 < 48, 1).otherwise(0)).cast("int")
    return _labelled_documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"),
        F.when(h("o") % 10 == 0, address).otherwise("").alias("sender"),
        F.lit("").alias("subject"),
        F.concat_ws(" ", body, pick(PASSAGES, h("c"))).alias("text"),
        label.alias("label"),
        "source",
    )


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a labelled corpus; a few sources hold one class only, as public ones do."""
    number = F.substring("source", 4, 10).cast("int")
    mixed = F.coalesce(F.col("toxic"), F.when(h("y") % 100 < 48, 1).otherwise(0))
    label = F.when(number % 5 == 0, 0).when(number % 5 == 1, 1).otherwise(mixed).cast("int")
    return _labelled_documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), "text", label.alias("label"), "source", "lang",
        number.alias("source_rank"),
    )
