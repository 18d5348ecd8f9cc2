"""Loading labelled mail corpora whose column names and label spellings differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.operators import hot_groups as hg
from mailrisk.operators.corpus import exact_sample

# Names that mark a text or label column, and label spellings. Spam is not phishing.
TEXT_MARKS = ["text", "body", "email", "message"]
LABEL_MARKS = ["label", "spam", "class"]
URL_MARKS = ["url", "text"]
SPELLED_LABELS = {"spam": 0, "phishing": 1, "ham": 0, "legitimate": 0}
NARROW_TEXT = 80


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, multi-line CSV with a header; every column is a string, nothing is inferred."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )


def first_column(columns: Sequence[str], marks: Sequence[str], fallback: int) -> str:
    """First column whose name contains a mark, else the one at ``fallback``."""
    for name in columns:
        if any(mark in name.lower() for mark in marks):
            return name
    return columns[fallback]


def spelled_number(label: Column) -> Column:
    """Number of a label, with True and False as 1 and 0; null for any other word."""
    truth = F.when(label.isin("True", "TRUE", "true"), 1.0).when(label.isin("False", "FALSE", "false"), 0.0)
    return F.coalesce(truth, label.try_cast("double"))


def numeric_label(label: Column) -> Column:
    """Label as 0 or 1; anything that is not a number counts as 0. Clipped first: no value is too large to cast."""
    value = F.coalesce(spelled_number(label), F.lit(0.0))
    return F.least(F.greatest(F.when(F.isnan(value), 0.0).otherwise(value), F.lit(0.0)), F.lit(1.0)).cast("int")


def mixed_corpus(df: DataFrame, spam_label: int | None = 0) -> DataFrame:
    """text, label from a mixed corpus. Spelled labels are mapped only if all of them are known.

    ``spam_label=None`` drops rows spelled "spam".
    """
    text = first_column(df.columns, TEXT_MARKS, 0)
    label = first_column(df.columns, LABEL_MARKS, -1)
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("raw")).dropna()
    # One row of two flags decides how the whole column is read.
    kinds = rows.agg(
        F.bool_and(F.coalesce(spelled_number(F.col("raw")).isin(0.0, 1.0), F.lit(False))).alias("binary"),
        F.bool_and(F.col("raw").isin(list(SPELLED_LABELS))).alias("spelled"),
    ).first()
    if not kinds["binary"] and kinds["spelled"]:
        spelled = dict(SPELLED_LABELS, spam=spam_label)
        mapping = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair if pair[1] is not None])
        mapped = rows.select("text", mapping[F.col("raw")].cast("int").alias("label"))
        return mapped.dropna(subset=["label"]) if spam_label is None else mapped
    return rows.select("text", numeric_label(F.col("raw")).alias("label"))


def column_widths(df: DataFrame) -> DataFrame:
    """Mean text width of every column, in one pass. Nulls count with the width of their print."""
    widths = [F.avg(F.length(F.coalesce(F.col(c).cast("string"), F.lit("nan")))).alias(c) for c in df.columns]
    return df.agg(*widths)


def pick_text_column(df: DataFrame) -> tuple[str, float]:
    """The message column by content: the widest of the well-known names, else the widest text."""
    named = [c for c in df.columns if c.strip().lower() in lx.CONTENT_COLUMNS]
    strings = [name for name, kind in df.dtypes if kind == "string"] or df.columns
    candidates = named or strings
    widths = column_widths(df.select(*candidates)).first().asDict()
    best = max(candidates, key=lambda c: widths[c] or 0.0)
    return best, widths[best] or 0.0


def negative_corpus(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A corpus of legitimate mail only; with a ``limit``, an exact, reproducible sample when it is larger."""
    column, _ = pick_text_column(df)
    rows = df.select(F.col(column).cast("string").alias("text")).dropna().withColumn("label", F.lit(0))
    if limit is None:
        return rows
    keyed = rows.withColumn("row_id", F.xxhash64("text"))
    return exact_sample(keyed, limit, seed="42").drop("row_id")


def positive_corpus(df: DataFrame) -> DataFrame:
    """A corpus of phishing links or texts only."""
    column = first_column(df.columns, URL_MARKS, 0)
    return df.select(F.col(column).cast("string").alias("text")).dropna().withColumn("label", F.lit(1))


def spam_corpus(df: DataFrame, spam_label: int | None = 0) -> DataFrame:
    """A ham/spam corpus: spam becomes ``spam_label`` or is dropped."""
    rows = plain_corpus(df)
    if spam_label is None:
        return rows.filter("label = 0")
    return rows.withColumn("label", F.when(F.col("label") == 1, spam_label).otherwise(F.col("label")))


def plain_corpus(df: DataFrame) -> DataFrame:
    """A small labelled corpus with a text and a numeric label column."""
    text = first_column(df.columns, ["text"], 0)
    label = first_column(df.columns, ["label"], -1)
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("raw")).dropna()
    return rows.select("text", numeric_label(F.col("raw")).alias("label"))


def rich_corpus(df: DataFrame, source: str) -> DataFrame:
    """A corpus that may carry sender and subject; only the columns it has are kept."""
    rows = df.dropna(subset=["text", "label"]).withColumn("label", numeric_label(F.col("label").cast("string")))
    tagged = rows.withColumn("source", F.lit(source))
    wanted = ("sender", "subject", "text", "label", "source")
    return tagged.select(*[c for c in wanted if c in tagged.columns])


def tagged(df: DataFrame, source: str, rank: int) -> DataFrame:
    """Name a loaded corpus and give its rows an order within the whole."""
    key = hg.hash_key("row", F.lit(source), F.col("text"), F.col("label"))
    return df.withColumn("source", F.lit(source)).withColumn("source_rank", F.lit(rank)).withColumn("row_id", key)


def load_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One prepared split with sender, subject, content as text and a whole label; never empty."""
    table = spark.read.parquet(path).where(F.col("split") == name)
    if "label" not in table.columns:
        raise ValueError(f"no label column in {path}; present: {table.columns}")
    if table.isEmpty():
        raise ValueError(f"split {name} of {path} is empty")
    if "content" not in table.columns:
        source = next((c for c in ("body", "text") if c in table.columns), None)
        if source:
            table = table.withColumn("content", F.col(source))
    for column in ("sender", "subject", "content"):
        value = F.col(column).cast("string") if column in table.columns else F.lit(None).cast("string")
        table = table.withColumn(column, F.coalesce(value, F.lit("")))
    return table.withColumn("label", F.col("label").cast("int"))


def load_diagnostic(spark: SparkSession, path: str, limit: int = 40_000) -> DataFrame:
    """Train split for diagnostics: rows with text, label and source.

    ``limit`` bounds the labelled rows that a fit is given (0: all); it is a sample, exact and reproducible.
    """
    table = spark.read.parquet(path).where("split = 'train'").dropna(subset=["text", "label"])
    if "source" not in table.columns:
        raise ValueError(f"no source column in {path}; prepare the corpus again")
    return exact_sample(table, limit, seed="42") if limit else table


def load_training(spark: SparkSession, prepared: str | None, raw: Sequence[DataFrame]) -> DataFrame:
    """Prepared splits when there are any, else the raw frames stacked and split 70/15/15."""
    from mailrisk.operators.corpus import stratified_split, union_sources

    if prepared is not None:
        return spark.read.parquet(prepared).dropna(subset=["text", "label"])
    usable = [r.dropna(subset=["text", "label"]) for r in raw if {"text", "label"} <= set(r.columns)]
    if not usable:
        raise ValueError("no usable corpus: each needs text and label")
    stacked = union_sources(usable)
    if "row_id" not in stacked.columns:
        stacked = stacked.withColumn("row_id", hg.hash_key("row", F.col("text"), F.col("label")))
    return stratified_split(stacked.withColumn("label", F.col("label").cast("int")))
