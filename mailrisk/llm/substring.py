"""Removal of word windows that another document already holds: count-min prefilter, exact second pass.

The first pass sketches the corpus. A window is represented by its anchor, the least hash among the
``ANCHOR``-word runs inside it: equal windows have equal anchors, and neighbouring windows mostly share
one, so a document has some eighteen times fewer anchors than windows. Every task counts the anchors of
its documents in the cells of a count-min sketch; the sparse partial sketches are added up. A
count is never too low, so a window whose anchor is counted once in some row of the sketch has no twin.

The second pass sends only the windows whose anchor is estimated repeated, with 96-bit hashes of their
words, and groups them exactly: a window goes if the least key holding it is smaller than its own.
Collisions in the sketch cost rows there and nothing else.

The sketch is sized from the corpus (``cells_for``) up to a fixed bound, so what reaches the driver and
the tasks is at most two bit maps of ``MAX_CELLS``. Beyond that bound more windows take the second
pass; the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.llm.bitmap import BLOCK, cell_of, collect_bits, has_bits, keep_listed, listed, member_bits
from mailrisk.llm.words import hash_words, mix, rolling, sliding_min, split_words
from mailrisk.session import materialise

ANCHOR = 16
DEPTH = 2
MAX_CELLS = 1 << 29
FLUSH_ROWS = 1 << 18
BYTES_PER_ANCHOR = 100


def cells_for(text_bytes: int) -> int:
    """Cells of a sketch row: eight or more for each anchor, a power of two within fixed bounds."""
    return min(MAX_CELLS, max(BLOCK, 1 << (8 * text_bytes // BYTES_PER_ANCHOR).bit_length()))


def _anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    h = hash_words(words)
    width = min(ANCHOR, window)
    return h, sliding_min(rolling(h, width), window - width + 1)


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors, 101 + row) & np.uint64(cells - 1)).astype(np.int64)


def _searched(batch: pa.RecordBatch, copied) -> np.ndarray:
    """Rows to search: those known to be no copies, and of the others those that cannot be one."""
    sure = batch.column("sure").to_numpy(zero_copy_only=False)
    named = batch.column("k").is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(named & (sure | ~listed(copied.value, batch.column("cell"))))


def _sketch(batches: Iterator[pa.RecordBatch], window: int, cells: int, copied) -> Iterator[pa.RecordBatch]:
    found: list[np.ndarray] = []
    for batch in batches:
        for i in _searched(batch, copied):
            words = split_words(batch.column("x")[i].as_py())
            if len(words) >= window:
                found.append(np.unique(_anchors(words, window)[1]))
    if found:
        anchors, n = np.unique(np.concatenate(found), return_counts=True)
        for row in range(DEPTH):
            cell, at = np.unique(_cells(anchors, row, cells), return_inverse=True)
            count = np.minimum(np.bincount(at, weights=n), 2).astype(np.int8)
            for i in range(0, len(cell), FLUSH_ROWS):
                part = slice(i, i + FLUSH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cell[part]), row, dtype=np.int8)), pa.array(cell[part]), pa.array(count[part])],
                    ["depth", "cell", "n"],
                )


def _repeated_cells(searched: DataFrame, window: int, cells: int, copied) -> np.ndarray:
    """Bit maps (one per sketch row) of the cells counted at least twice in the merged sketch."""
    parts = searched.mapInArrow(lambda it: _sketch(it, window, cells, copied), "depth byte, cell bigint, n byte")
    twice = parts.groupBy("depth", "cell").agg(F.sum("n").alias("n")).filter("n > 1")
    return collect_bits(twice, DEPTH, cells)


def _windows(
    batches: Iterator[pa.RecordBatch], window: int, cells: int, sketch, copied
) -> Iterator[pa.RecordBatch]:
    maps = sketch.value
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        sizes = [len(r[2]) for r in rows]
        columns = [np.repeat(np.array([r[i] for r in rows], dtype=np.int64), sizes) for i in (0, 1)]
        columns += [np.concatenate([r[i] for r in rows]) for i in (2, 3, 4)]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "t", "pos", "h", "g"])

    for batch in batches:
        for i in _searched(batch, copied):
            words = split_words(batch.column("x")[i].as_py())
            if len(words) < window:
                continue
            h, anchors = _anchors(words, window)
            likely = np.ones(len(anchors), dtype=bool)
            for row in range(DEPTH):
                cell = _cells(anchors, row, cells)
                likely &= has_bits(maps[row], cell)
            at = np.flatnonzero(likely)
            if len(at):
                full = rolling(h, window)[at].view(np.int64)
                check = rolling(mix(h, 7), window)[at].astype(np.uint32).view(np.int32)
                rows.append((batch.column("k")[i].as_py(), batch.column("t")[i].as_py(), at.astype(np.int32), full, check))
                held += len(at)
                if held >= FLUSH_ROWS:
                    held = 0
                    yield flush()
    if rows:
        yield flush()


def _without(text: str | None, starts, copy: bool, window: int) -> tuple[int, int, str]:
    """Words, words removed and the text kept, given where the windows that go start."""
    words = split_words(text)
    keep = np.ones(len(words), dtype=bool)
    if copy and len(words) >= window:
        keep[:] = False
    elif starts is not None and len(starts):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, np.asarray(starts) + window, -1)
        keep = np.cumsum(change[:-1]) == 0
    kept = b" ".join(words) if keep.all() else b" ".join(w for w, k in zip(words, keep) if k)
    return len(words), len(words) - int(keep.sum()), kept.decode("utf-8", "surrogatepass")


def _results(schema: T.StructType, window: int, touched) -> Callable:
    """Task that turns rows into results; with a map, only the rows it does not list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if touched is not None:
                batch = batch.filter(pa.array(~listed(touched.value, batch.column("cell"))))
            names = batch.schema.names
            starts = batch.column("starts") if "starts" in names else [None] * batch.num_rows
            copies = batch.column("copy") if "copy" in names else [None] * batch.num_rows
            done = [
                _without(
                    x.as_py(), s.values.to_numpy() if s is not None and s.is_valid else None,
                    c is not None and c.as_py() is True, window,
                )
                for x, s, c in zip(batch.column("x"), starts, copies)
            ]
            n, gone, kept = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 batch.column("c")], [f.name for f in schema])

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """``k``, ``t`` of the rows whose whole text also stands under a smaller key."""
    narrow = rows.select("k", "t", F.md5(F.col("x").cast("binary")).alias("d")).filter("k IS NOT NULL")
    repeated = narrow.groupBy("t", "d").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last")
    repeated = materialise(repeated, "repeated-texts")  # a table of its own lets Spark split the join of a hot text
    return materialise(narrow.join(repeated, ["t", "d"]).filter("k > first").select("k", "t").distinct(), "copies")


def remove_repeats(
    df: DataFrame, key: str, text: str, window: int = 50, cells: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: ``key`` (bigint), ``n_words``, ``n_removed``, ``kept``, and ``carried``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if it lies in ``window`` consecutive words whose
    sequence also starts in a document with a smaller key; all windows are judged on the input. ``kept``
    is the remaining words joined by one space. Null and empty texts and texts shorter than a window
    lose nothing. Rows with one key are one document: they do not repeat each other. A null key is
    neither smaller nor larger than another, so such rows lose nothing and cost others nothing.
    An empty table gives an empty result. ``carried`` is a struct of the columns named in ``carry`` (null if
    there are none); other columns are not read.

    Exact copies are settled by checksums of 192 bits: all but the first lose every window, and only the first
    takes part in the search. Texts are shuffled only where something may go.
    """
    rows = df.select(
        F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("x"),
        (F.struct(*carry) if carry else F.lit(None).cast("string")).alias("c"),
    )
    spark = df.sparkSession
    if cells is None:
        size = rows.agg(F.sum(F.octet_length("x").cast("bigint"))).first()[0]
        cells = cells_for(size or 0)
    rows = rows.withColumn("cell", cell_of(F.col("k")))
    copies = _copies(rows)
    copied = member_bits(copies, "k")
    plain = rows.select("k", "t", "x", "cell")
    # Written, as three passes read it: chained to their Python step, it would double the workers of every executor for good.
    settled = materialise(keep_listed(plain, copied).join(copies, ["k", "t"], "left_anti").select(*plain.columns), "settled")
    searched = plain.withColumn("sure", F.lit(False)).unionByName(settled.withColumn("sure", F.lit(True)))
    sketch = spark.sparkContext.broadcast(_repeated_cells(searched, window, cells, copied))
    likely = searched.mapInArrow(
        lambda it: _windows(it, window, cells, sketch, copied), "k bigint, t bigint, pos int, h bigint, g int"
    )
    # Partial counts fold the repeats of a task first. The result is written, so that Spark can split the join back
    # where a window is hot; read straight from the aggregation it could not.
    first = likely.groupBy("h", "g").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last")
    first = materialise(first, "repeated-windows")
    repeated = likely.join(first, ["h", "g"]).filter("k > first")
    starts = repeated.groupBy("k", "t").agg(F.collect_set("pos").alias("starts")).withColumn("copy", F.lit(False))
    gone = materialise(
        starts.unionByName(copies.select("k", "t", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))),
        "repeats",
    )
    touched = member_bits(gone, "k")
    schema = T.StructType([
        T.StructField("k", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), T.StructField("carried", rows.schema["c"].dataType),
    ])
    whole = rows.select("k", "x", "c", "cell").mapInArrow(_results(schema, window, touched), schema)
    cut = keep_listed(rows, touched).join(gone, ["k", "t"], "left").select("k", "x", "c", "starts", "copy")
    return whole.unionByName(cut.mapInArrow(_results(schema, window, None), schema)).withColumnRenamed("k", key)
