"""MinHash near-duplicates by SuperMinHash signatures, banding, verification and union-find.

Every shingle draws a random permutation of the registers, step by step, and a random fraction for each step. In step ``j``
it offers ``j`` + fraction to the register its permutation names, and a register keeps the least offer. The ranks of one shingle
are thus correlated: each register gets exactly one rank from it, which lowers the variance of the share of equal registers
below that of independent hashes. Offers of step ``j`` are at least ``j``, so a set stops as soon as all its registers hold less than
the next step: long texts after one or two steps, short ones after more.

The steps run over many texts at once; permutations are drawn lazily and only for sets that need a second step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.set_links import PAIR_BUCKET, fold_sets, least_keys, link_sets, odd_sketch, set_digest, shingle_set
from mailrisk.llm.words import free_kept, mix
from mailrisk.session import materialise

BANDS = 32
BAND_ROWS = 5
REGISTERS = BANDS * BAND_ROWS
CHUNK = 1 << 15  # shingles worked on at a time
_EMPTY = np.uint64(2**64 - 1)
_FRACTION = np.uint64(48)
_SEED = 4000


def _offers(h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Offer of each shingle in this step, and the place among those its permutation has left."""
    x = mix(h, _SEED + step)
    left = np.uint64(REGISTERS - step)
    place = step + (((x & np.uint64(0xFFFF)) * left) >> np.uint64(16)).astype(np.int64)
    return (x >> np.uint64(16)) | (np.uint64(step) << _FRACTION), place


def _update(registers: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Offer shingles ``h`` to the rows of ``registers`` that ``owner`` names."""
    offer, place = _offers(h, 0)
    np.minimum.at(registers.reshape(-1), owner * REGISTERS + place, offer)
    order = None
    for step in range(1, REGISTERS):
        late = (registers >= (np.uint64(step) << _FRACTION)).any(axis=1)
        keep = late[owner]
        if not keep.any():
            return
        h, owner, place = h[keep], owner[keep], place[keep]
        rows = np.arange(len(h))
        if order is None:
            order = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(h), 1))
        else:
            order = order[keep]
        order[rows, place] = order[:, step - 1]  # the place used takes the value of the one that drops out
        offer, place = _offers(h, step)
        np.minimum.at(registers.reshape(-1), owner * REGISTERS + order[rows, place], offer)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of every set, one row each; all ones for an empty set."""
    registers = np.full((len(sets), REGISTERS), _EMPTY, dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        owner = np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]])
        for part in range(0, len(h), CHUNK):  # more than one for a single long set
            _update(registers[at:end], h[part : part + CHUNK], owner[part : part + CHUNK])
        at = end
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of each row: the hash of its registers and its number."""
    rows = registers.reshape(len(registers), BANDS, BAND_ROWS)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 6), rows.shape[:2])
    for i in range(BAND_ROWS):
        keys = mix(keys ^ rows[:, :, i], 7)
    return keys.view(np.int64)


def _sketch_rows(batches: Iterator[pa.RecordBatch], width: int, of_text: Callable | None) -> Iterator[pa.RecordBatch]:
    free_kept()
    for batch in batches:
        sets = [shingle_set(text.as_py(), width) for text in batch.column(2)]
        more = [pa.array([of_text(text.as_py()) for text in batch.column(2)], pa.int64())] if of_text else []
        keys = band_keys(signatures(sets)) if sets else np.empty((0, BANDS), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(set_digest, sets), pa.binary()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array(map(odd_sketch, sets), pa.list_(pa.int64())),
             pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))), *more],
            ["row", "k", "digest", "n", "odd", "keys", *["of_text"] * len(more)],
        )


def sketch(rows: DataFrame, width: int, of_text: Callable[[str | None], int] | None = None) -> DataFrame:
    """``row``, ``k``, ``digest``, ``n``, ``odd``, ``keys`` of every row (``k``, ``x``), written; with ``of_text`` a number of the text too."""
    kind = rows.schema["k"].dataType.simpleString()
    return materialise(
        rows.select(F.monotonically_increasing_id().alias("row"), "k", "x").mapInArrow(
            lambda it: _sketch_rows(it, width, of_text),
            f"row bigint, k {kind}, digest binary, n bigint, odd array<bigint>, keys array<bigint>" + ", of_text bigint" * bool(of_text),
        ),
        "sketches",
    )


def near_duplicates(
    df: DataFrame, key: str, text: str, width: int = 4, percent: int = 80, pair_bucket: int = PAIR_BUCKET
) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Rows belong together if a chain of sets joins them in which neighbours have ``100 * intersection >= percent * union``.
    ``component_id`` is the least key of the component (null if all its keys are null), and ``kept`` tells whether it is the row's own.
    A set holds the distinct ``width``-word shingles; fewer words are one shingle. A text that is null, empty or white
    space has an empty set, is linked with nothing and kept (a null key never is). Candidates share one of ``BANDS`` keys of
    ``BAND_ROWS`` registers each: at 0.8 all but three pairs in a million do. Links are confirmed on the whole sets. A
    repeated key keeps its rows. An empty table gives an empty result, and other columns of the input are not read.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    sketched = sketch(rows, width)
    one = materialise(fold_sets(sketched), "sets")
    classes = least_keys(sketched, one, link_sets(one, rows, width, percent, pair_bucket))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k"))
    return sketched.join(classes, "digest").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"),
    )
