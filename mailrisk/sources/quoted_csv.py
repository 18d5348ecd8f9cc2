"""Quoted CSV with line breaks inside fields, read in parallel however large one file is.

Spark cuts a file of lines into chunks, but a line may begin inside a quoted field. Whether it does follows from the
number of quotes before it: a doubled quote counts two, so only the parity matters. One pass counts the quotes of each
chunk, a running sum over the chunks tells each whether it begins inside quotes, and a second pass cuts records at their
true ends. A record that crosses chunks leaves a piece in each; only those pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk.session import materialise
from mailrisk.sources.labelled import read_csv

CHUNK_CONF = "spark.sql.files.maxPartitionBytes"
PIECES = "file bigint, chunk bigint, first boolean, head boolean, closed boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their chunk, their place in it and the number of their quotes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.col("_metadata.file_block_length").alias("size"), F.monotonically_increasing_id().alias("place"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), "value",
    )


def chunk_starts(lines: DataFrame) -> DataFrame:
    """One row per chunk: ``inside``, 1 if it begins inside quotes. A file with an odd number of quotes is an error."""
    counted = lines.groupBy("file", "chunk", "size").agg((F.sum("quotes") % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = F.sum("odd").over(W.partitionBy("file")) % 2
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    checked = F.when(whole == 0, inside).otherwise(F.raise_error(F.lit("a quoted field is never closed")))
    return counted.select("file", "chunk", "size", checked.cast("int").alias("inside"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records, and the pieces of those that cross chunks, of lines in order."""
    chunk, parity, held = None, 0, None  # the chunk read last, quotes open at its end, the piece not ended yet

    def table(pieces: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(pieces, columns=["file", "chunk", "first", "head", "closed", "record"])

    for batch in batches:
        if batch.empty:
            continue
        file, at, quotes = (batch[c].to_numpy() for c in ("file", "chunk", "quotes"))
        values = batch["value"].tolist()
        new = np.r_[(file[0], at[0]) != chunk, (file[1:] != file[:-1]) | (at[1:] != at[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        opened = np.where(np.cumsum(new) == 0, parity, batch["inside"].to_numpy())
        running = np.cumsum(quotes) - quotes
        before = (running - running[start] + opened) % 2
        after = (before + quotes) % 2
        begins = np.flatnonzero(new | (before == 0))
        stop = begins[0] if len(begins) else len(new)
        if stop:  # the held piece goes on
            held[-1].extend(values[:stop])
            held[-2] = bool(after[stop - 1] == 0)
        done = []
        for low, high in zip(begins, np.r_[begins[1:], len(new)]):
            if held is not None:
                done.append((*held[:-1], "\n".join(held[-1])))
            head = bool(new[low] and before[low])
            held = [file[low], at[low], bool(new[low] and at[low] == 0), head, bool(after[high - 1] == 0), values[low:high]]
        chunk, parity = (file[-1], at[-1]), int(after[-1])
        if done:
            yield table(done)
    if held is not None:
        yield table([(*held[:-1], "\n".join(held[-1]))])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of quoted CSV files as text: record, and ``first``, whether it is its file's first."""
    lines = _lines(spark, path)
    starts = materialise(chunk_starts(lines), "csv-chunks")
    # A row per chunk: Spark broadcasts it as far as its measured size allows, else lines meet it by chunk.
    known = lines.join(starts, ["file", "chunk", "size"], "left")
    lost = F.raise_error(F.lit("the chunks of the file changed between two reads")).cast("int")
    ordered = known.withColumn("inside", F.coalesce("inside", lost)).sortWithinPartitions("file", "chunk", "place")
    cut = ordered.select("file", "chunk", "inside", "quotes", "value").mapInPandas(_cut, PIECES)
    pieces = materialise(cut, "csv-pieces")
    whole = pieces.filter("closed AND NOT head").select("first", "record")
    torn = pieces.filter("head OR NOT closed")
    # At most two pieces to a chunk; a record begins at a piece that is no head.
    order = W.partitionBy("file").orderBy("chunk", F.col("head").desc())
    numbered = torn.withColumn("n", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "record")))
    glued = numbered.groupBy("file", "n").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")
    )
    return whole.unionByName(glued.select("first", "record"))


def read_quoted_csv(spark: SparkSession, path: str, chunk_bytes: int | None = None) -> DataFrame:
    """The rows of ``labelled.read_csv``, from files read in chunks of ``chunk_bytes`` (the session's size if None).

    One thing differs: line ends inside fields stay as they are, where that reader turns ``\\r\\n`` into ``\\n``.

    Every file has a header; all columns are strings. Lines end in ``\\n`` or ``\\r\\n``; empty ones are skipped. Quotes
    stand only around fields and doubled inside them, as writers put them; a file with an odd number of them is an
    error. For files with stray quotes or other line ends there is ``read_csv``. Rows come in no order. The records are
    written once to the shared folder, so one read of them serves all later steps.
    """
    columns = read_csv(spark, path).columns
    before = spark.conf.get(CHUNK_CONF)
    try:
        if chunk_bytes is not None:
            spark.conf.set(CHUNK_CONF, str(chunk_bytes))
        records = csv_records(spark, path)
    finally:
        spark.conf.set(CHUNK_CONF, before)
    rows = records.filter("NOT first").select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")
    fields = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = rows.select(F.from_csv("record", fields, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select("r.*").toDF(*columns)
