"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage keeps the columns of ``documents`` but the last, which returns packed pieces. A stage takes its
predecessor's whole output. Rows to drop are found by id; a bit map of fixed size keeps the texts of all
other rows out of the shuffle. Null ids are never dropped, and texts that are null or empty pass the stages as
their operators define it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import decontamination, packing, quality, simhash, substring
from mailrisk.llm.bitmap import maybe_member
from mailrisk.session import materialise, prepare_workers, work_dir

QUALITY_CUT = 0.3
TOKENIZER = "byte_bpe_50k.json"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is not listed."""
    dropped = materialise(dropped.select("doc_id").distinct(), "dropped")
    maybe = maybe_member(dropped, "doc_id")(F.col("doc_id"))
    columns = docs.columns
    kept = docs.filter(maybe).join(dropped, "doc_id", "left_anti").select(*columns)
    return docs.filter(F.col("doc_id").isNull() | ~maybe).unionByName(kept)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts, learned from the labels left for learning."""
    prepare_workers(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality.fit(docs, "doc_id", "text", learned, "quality")
    return docs.filter(quality.score(model, F.col("text"), QUALITY_CUT) >= QUALITY_CUT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity 0.8): the one with the least id.

    Rows repeated with id and text are one document.
    """
    prepare_workers(spark)
    groups = simhash.similar_documents(docs, "doc_id", "text")
    kept = _without(docs, groups.filter("doc_id <> component_id"))
    repeated = materialise(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    maybe = maybe_member(repeated, "doc_id")(F.col("doc_id"))
    once = kept.filter(maybe).dropDuplicates(["doc_id", "text"])
    return kept.filter(F.col("doc_id").isNull() | ~maybe).unionByName(once)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that a document with a smaller id holds; other texts unchanged."""
    prepare_workers(spark)
    rows = substring.remove_repeats(docs, "doc_id", "text", carry=docs.columns)
    cut = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carried.text"))
    return rows.select(
        *[F.col(f"carried.{c}") for c in docs.columns if c not in ("text", "n_chars")], cut.alias("text")
    ).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare_workers(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = decontamination.contained_items(docs, "doc_id", "text", items, "item_id", "text")
    return _without(docs, pairs.filter("k IS NOT NULL").select(F.col("k").alias("doc_id")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids and the checksum of these."""
    prepare_workers(spark)
    pieces = packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL: str | None = None  # SQL has neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last stage's rows are read back from its files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
