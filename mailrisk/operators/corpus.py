"""Corpus preparation: union, sender recovery, cleaning, dedup, balancing, splits, leak check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk.functions import text as tx
from mailrisk.functions.senders import extract_sender
from mailrisk.operators import hot_groups as hg
from mailrisk.session import materialise

MIN_TEXT_CHARS = 10
SPLITS = ["train", "val", "test"]


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack sources with different columns; absent sender/subject are '', source 'unknown'."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for name in ("sender", "subject", "source"):
        if name not in stacked.columns:
            stacked = stacked.withColumn(name, F.lit(None).cast("string"))
    return stacked.fillna({"sender": "", "subject": "", "source": "unknown"})


def recover_senders(df: DataFrame) -> DataFrame:
    """Fill empty senders from the raw text. Must run before cleaning, which deletes ``<a@b>``."""
    found = extract_sender(df, "text")
    return found.withColumn(
        "sender",
        F.when(tx.strip_space(F.col("sender")) == "", F.col("extracted")).otherwise(F.col("sender")),
    ).drop("extracted", "extract_method")


def clean_texts(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    return df.withColumn("text", tx.clean_text(F.col("text"), max_chars))


def dedup_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``. Copies are folded before the shuffle.

    An aggregation, not a window: however many copies a text has, each task passes on one.
    """
    row = F.struct(*df.columns)
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def dedup_text(df: DataFrame, order: Sequence[str] = ("source_rank", "row_id")) -> DataFrame:
    """First row per cleaned text, texts of ten characters or fewer dropped.

    The length is tested on the folded row: tested before, the filter would be pushed below the
    cleaning and every text would be cleaned twice.
    """
    return dedup_first(df, F.sha2("text", 256), order).filter(F.length("text") > MIN_TEXT_CHARS)


def source_stats(df: DataFrame) -> DataFrame:
    """Rows, positives, share and the one-class flag (>= 97 % or <= 3 %) per source."""
    stats = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives")
    )
    share = F.col("positives") / F.col("n")
    return stats.select("*", share.alias("share"), ((share >= 0.97) | (share <= 0.03)).alias("single_class"))


def source_quotas(df: DataFrame, max_single_frac: float = 0.15, floor: int = 100) -> DataFrame:
    """Rows each source may keep. One-class sources share a budget tied to the mixed ones."""
    stats = source_stats(df)
    # One row per source: the window runs over the list of sources, not over the data.
    everywhere = W.partitionBy(F.lit(0))
    mixed = F.sum(F.when(~F.col("single_class"), F.col("n")).otherwise(0)).over(everywhere)
    n_single = F.count_if("single_class").over(everywhere)
    totals = stats.select("*", mixed.alias("_mixed"), n_single.alias("_singles"))
    if max_single_frac >= 1.0:
        quota = F.col("n")
    else:
        budget = F.floor(F.col("_mixed") * F.lit(max_single_frac) / F.lit(1 - max_single_frac))
        each = F.greatest(F.floor(budget / F.col("_singles")), F.lit(floor))
        capped = F.col("single_class") & (F.col("_mixed") > 0)
        quota = F.when(capped, F.least("n", each)).otherwise(F.col("n"))
    return totals.select("source", "n", "positives", "single_class", quota.cast("bigint").alias("quota"))


def balance_sources(df: DataFrame, max_single_frac: float = 0.15, floor: int = 100) -> DataFrame:
    """Cap one-class sources at their quota, keeping the rows lowest in hash order.

    Only capped sources are ranked, and of those only the bucket their quota falls into.
    """
    quotas = materialise(source_quotas(df, max_single_frac, floor).select("source", "quota", "n"), "quotas")
    keyed = df.withColumn("_key", hg.hash_key("balance", F.col("text"))).join(quotas, "source")
    ranked = hg.slot_by_rank(
        keyed.filter("quota < n"), ["source", "quota"], "_key", "row_id", lambda n: [F.col("quota")], 1
    )
    return keyed.filter("quota >= n").select(*df.columns).unionByName(ranked.filter("slot = 0").select(*df.columns))


def stratified_split(df: DataFrame) -> DataFrame:
    """Add ``split``: 70/15/15 within each label, exact counts, by the hash of the text."""

    def targets(n: Column) -> list[Column]:
        train = n - F.ceil(n * 0.3)
        return [train, train + F.floor((n - train) / 2)]

    keyed = df.withColumn("_key", hg.hash_key("split", F.col("text")))
    placed = hg.slot_by_rank(keyed, ["label"], "_key", "row_id", targets, 2)
    name = F.element_at(tx.literal_array(SPLITS), F.col("slot") + 1)
    return placed.withColumn("split", name).drop("_key", "slot")


def oversample(df: DataFrame, minority: Column, factor: int = 5) -> DataFrame:
    """Repeat minority rows of the training split; ``copy`` numbers the repeats from 1."""
    copies = F.when(minority & (F.col("split") == "train"), factor).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def split_leakage(df: DataFrame) -> DataFrame:
    """Distinct texts that occur in train and also in val or test. One partial aggregation."""
    per_text = df.groupBy(F.sha2("text", 256).alias("_t")).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    )
    return per_text.agg(
        F.count(F.lit(1)).alias("distinct_texts"),
        F.count_if((F.col("train") == 1) & (F.col("val") == 1)).alias("train_and_val"),
        F.count_if((F.col("train") == 1) & (F.col("test") == 1)).alias("train_and_test"),
    )


def class_balance(df: DataFrame, by: str) -> DataFrame:
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("n_phishing")
    )
    return counted.withColumn("share", F.col("n_phishing") / F.col("n_rows"))


def class_weights(df: DataFrame) -> DataFrame:
    """Weights 1/count, scaled to sum to the number of classes. Two rows."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everywhere = W.partitionBy(F.lit(0))
    inverse = 1.0 / F.col("n")
    scaled = inverse / F.sum(inverse).over(everywhere) * F.count(F.lit(1)).over(everywhere)
    return counts.select("label", "n", scaled.alias("weight"))


def exact_sample(df: DataFrame, n: int, key: str = "text", seed: str = "sample") -> DataFrame:
    """Exactly ``n`` rows (or all), lowest in hash order. No global sort, no driver traffic."""
    keyed = df.withColumn("_key", hg.hash_key(seed, F.col(key), F.col("row_id"))).withColumn("_all", F.lit(0))
    placed = hg.slot_by_rank(keyed, ["_all"], "_key", "row_id", lambda total: [F.least(total, F.lit(n))], 1)
    return placed.filter("slot = 0").select(*df.columns)


def stratified_sample(df: DataFrame, n: int, seed: str = "stratified") -> DataFrame:
    """``n`` rows with the class ratio kept: each label gets its rounded share."""
    keyed = df.withColumn("_key", hg.hash_key(seed, F.col("text"), F.col("row_id")))

    def targets(size: Column) -> list[Column]:
        return [F.least(size, F.round(size * F.lit(float(n)) / F.greatest(F.col("_everything"), F.lit(1)).cast("double")))]

    return hg.slot_by_rank(keyed, ["label"], "_key", "row_id", targets, 1).filter("slot = 0").select(*df.columns)


def balanced_sample(df: DataFrame, n: int, seed: str = "balanced") -> DataFrame:
    """``n // 2`` rows of each label, as far as available."""
    per_class = max(n // 2, 1)
    keyed = df.withColumn("_key", hg.hash_key(seed, F.col("text"), F.col("row_id")))
    placed = hg.slot_by_rank(
        keyed, ["label"], "_key", "row_id", lambda size: [F.least(size, F.lit(per_class))], 1
    )
    return placed.filter("slot = 0").select(*df.columns)


def shuffled(df: DataFrame, seed: str = "shuffle") -> DataFrame:
    """Add ``position`` from 1: a random order fixed by the seed and ``row_id``. Ordered within hash buckets only."""
    keyed = df.withColumn("_key", hg.hash_key(seed, F.col("row_id")))
    placed = hg.sliced_row_number(keyed.withColumn("_all", F.lit(0)), ["_all"], F.substring("_key", 1, 3), ["_key", "row_id"], "position")
    return placed.select(*df.columns, "position")


def translatable(df: DataFrame, low: int = 40, high: int = 4500) -> DataFrame:
    """Messages without Hebrew whose length suits one translation request."""
    return df.filter(~tx.has_hebrew(F.col("text")) & F.length("text").between(low, high))


def sender_share(df: DataFrame) -> DataFrame:
    """How many rows carry a sender or Hebrew; ``partial_engine`` warns below one half."""
    with_sender = tx.strip_space(F.col("sender")) != ""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(with_sender).alias("n_sender"),
        F.count_if(tx.has_hebrew(F.col("text"))).alias("n_hebrew"),
    )
    share = F.col("n_sender") / F.col("n_rows")
    return counted.select("*", share.alias("sender_share"), (share < 0.5).alias("partial_engine"))


def prepare_corpus(
    frames: Sequence[DataFrame],
    max_single_frac: float = 0.15,
    minority: Column | None = None,
    factor: int = 5,
    max_chars: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw labelled sources to ``(corpus with split and copy, leak report)``.

    Frames need row_id, text, label, source, source_rank. The cleaned, deduplicated table is written
    once to the shared folder, because balancing, splitting and the leak check all read it.
    """
    joined = recover_senders(union_sources(frames))
    unique = dedup_text(clean_texts(joined, max_chars))
    table = materialise(unique, "corpus-unique")
    balanced = materialise(balance_sources(table, max_single_frac), "corpus-balanced")
    split = stratified_split(balanced)
    minority = tx.has_hebrew(F.col("text")) if minority is None else minority
    return oversample(split, minority, factor), split_leakage(split)
