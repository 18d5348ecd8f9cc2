"""Which source files carry a sender, and whether it survives into the prepared corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions.text import strip_space, text_or_empty


def looks_like(name: str, hints: Sequence[str]) -> bool:
    low = name.strip().lower().replace(" ", "_")
    return any(hint in low for hint in hints)


def surviving_senders(prepared: DataFrame) -> DataFrame:
    """Rows and rows with a sender per source of the prepared corpus."""
    has = strip_space(F.col("sender")) != "" if "sender" in prepared.columns else F.lit(False)
    return prepared.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(has).alias("n_kept")
    )


def schema_profile(spark: SparkSession, headers: Mapping[str, Sequence[str]], prepared: DataFrame) -> DataFrame:
    """Per file stem: sender- and subject-like columns and kept / dropped / absent.

    ``headers`` holds the column names of each file (tens of files). A file belongs to the first
    source, by name, that equals its stem, starts it, or starts with its first word.
    """
    files = spark.createDataFrame(
        [
            (
                stem,
                ",".join(c for c in columns if looks_like(c, lx.SENDER_HINTS)),
                ",".join(c for c in columns if looks_like(c, lx.SUBJECT_HINTS)),
            )
            for stem, columns in headers.items()
        ],
        "stem string, sender_columns string, subject_columns string",
    )
    sources = surviving_senders(prepared)
    tag, stem = F.col("source"), F.col("stem")
    word = F.substring_index(stem, "_", 1)
    belongs = (tag == stem) | F.startswith(stem, tag) | F.startswith(tag, word)
    matched = sources.join(F.broadcast(files), belongs).groupBy("stem").agg(
        F.min_by(F.struct("source", "n_rows", "n_kept"), "source").alias("m")
    )
    joined = files.join(matched, "stem", "left")
    kept = F.coalesce(F.col("m.n_kept"), F.lit(0))
    return joined.select(
        "stem", "sender_columns", "subject_columns", text_or_empty(F.col("m.source")).alias("source"),
        F.coalesce(F.col("m.n_rows"), F.lit(0)).alias("n_rows"), kept.alias("n_kept"),
        F.when(F.col("sender_columns") == "", "absent").when(kept > 0, "kept").otherwise("dropped").alias("status"),
    )
