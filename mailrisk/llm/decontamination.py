"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short and documents long, so a MinHash of a whole document says nothing about an
item inside it. The signature is taken on the item's side: items are partitioned by the size of their
shingle set, and an item keeps the ``k`` smallest shingle hashes, with ``k`` set by its partition so that a
document missing at most the allowed share of the shingles must hold one of them. No item is lost, and
the share of a signature found estimates the containment.

One pass over the documents looks their shingles up in two fixed-size bit maps, of signatures and of
all item shingles, and keeps the shingles of documents that hit a signature. What follows joins
those few rows: signatures give candidate pairs, and only for these all shingles are compared as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.bitmap import collect_bits, has_bits
from mailrisk.llm.words import hash_words, plain_words, rolling
from mailrisk.session import materialise

CELLS = 1 << 26


def signature_size(shingles: int, threshold: float) -> int:
    """Smallest hashes kept by the items of a size partition (sizes up to the next power of two)."""
    largest = (1 << shingles.bit_length()) - 1
    return min(shingles, largest - ceil(threshold * largest - 1e-9) + 1)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(38)).astype(np.int64)  # 26 leading bits


def _item_rows(
    batches: Iterator[pa.RecordBatch], width: int, threshold: float
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = plain_words(text)
            if not words:
                continue
            w = min(width, len(words))
            h = rolling(hash_words(words), w)
            h, at = np.unique(h, return_index=True)
            keep = signature_size(len(h), threshold)
            for rank, (value, i) in enumerate(zip(h, at)):
                rows.append((item, len(h), w, int(value.view(np.int64)), b" ".join(words[i : i + w]).decode(),
                             rank < keep, int(_cell(value))))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("item", "n", "w", "h", "s", "signature", "cell"), r)) for r in rows],
            schema=pa.schema([("item", pa.int64()), ("n", pa.int32()), ("w", pa.int32()), ("h", pa.int64()),
                              ("s", pa.string()), ("signature", pa.bool_()), ("cell", pa.int64())]),
        )


def _document_rows(batches: Iterator[pa.RecordBatch], widths: list[int], maps) -> Iterator[pa.RecordBatch]:
    signatures, shingles = maps.value
    for batch in batches:
        ids, hashes, texts = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = plain_words(text.as_py())
            if not words:
                continue
            h = hash_words(words)
            by_width = [(w, rolling(h, w)) for w in widths]
            if not any(has_bits(signatures, _cell(r)).any() for _, r in by_width):
                continue
            for w, r in by_width:
                at = np.flatnonzero(has_bits(shingles, _cell(r)))
                value, first = np.unique(r[at], return_index=True)
                ids += [key] * len(value)
                hashes += value.view(np.int64).tolist()
                texts += [b" ".join(words[i : i + w]).decode() for i in at[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], ["k", "h", "s"]
        )


def contained_items(
    documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    width: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """Pairs ``k``, ``item`` with ``estimate`` and exact ``containment`` of at least ``threshold``.

    Words are lower-case with ASCII punctuation as white space. An item is its set of ``width``-word
    shingles, or all its words as one shingle when it has fewer; an item without words matches
    nothing. Rows with one key (or a null key) are read as one document, rows with one item id and text
    as one item. Ids are cast to bigint.
    """
    spark = documents.sparkSession
    items = materialise(
        items.select(F.col(item).cast("bigint"), F.col(item_text)).mapInArrow(
            lambda it: _item_rows(it, width, threshold),
            "item bigint, n int, w int, h bigint, s string, signature boolean, cell bigint",
        ).distinct(),
        "items",
    )
    widths = sorted(r["w"] for r in items.select("w").distinct().collect())  # at most `width` values
    cells = items.select(F.lit(1).alias("depth"), "cell").unionByName(
        items.filter("signature").select(F.lit(0).alias("depth"), "cell")
    )
    maps = spark.sparkContext.broadcast(collect_bits(cells, 2, CELLS))
    found = documents.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(
        lambda it: _document_rows(it, widths, maps), "k bigint, h bigint, s string"
    )
    found = materialise(found.distinct(), "item-shingles")

    hits = found.join(items.filter("signature"), ["h", "s"]).groupBy("k", "item", "n").agg(F.count("s").alias("hits"))
    sizes = items.groupBy("item", "n").agg(F.sum(F.col("signature").cast("int")).alias("kept"))
    candidates = hits.join(sizes, ["item", "n"]).select("k", "item", "n", (F.col("hits") / F.col("kept")).alias("estimate"))
    wanted = candidates.join(items.select("item", "n", "h", "s"), ["item", "n"]).alias("a")
    held = found.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.s") == F.col("b.s")) & F.col("a.k").eqNullSafe(F.col("b.k"))
    return (
        wanted.join(held, same)
        .groupBy("a.k", "a.item", "a.n", "a.estimate")
        .agg((F.count(F.lit(1)) / F.col("a.n")).alias("containment"))
        .filter(F.col("containment") >= threshold)
        .groupBy("k", "item")
        .agg(F.max("estimate").alias("estimate"), F.max("containment").alias("containment"))
    )


def contamination(
    documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    width: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """One row per document row: ``key``, ``contaminated``, ``n_items``, ``max_containment``, ``item_ids``.

    Null and empty texts hold nothing (false, 0, 0.0, empty list); with no items every document is clean. An
    empty table gives an empty result. Items are listed in ascending order. Other columns are not read.
    """
    pairs = contained_items(documents, key, text, items, item, item_text, width, threshold)
    by_document = pairs.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("containment").alias("max_containment"),
        F.sort_array(F.collect_set("item")).alias("item_ids"),
    )
    ids = documents.select(F.col(key).cast("bigint").alias(key))
    return ids.join(by_document, ids[key].eqNullSafe(by_document["k"]), "left").select(
        key,
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("max_containment", F.lit(0.0)).alias("max_containment"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )
