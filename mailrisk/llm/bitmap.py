"""Fixed-size bit maps built by Spark and read inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16
PARTS = 8
MEMBERS = 1 << 26


@F.pandas_udf(T.BinaryType())
def _pack(offsets: pd.Series) -> pd.Series:
    def bits(x) -> bytes:
        block = np.zeros(BLOCK, dtype=bool)
        block[np.asarray(x)] = True
        return np.packbits(block, bitorder="little").tobytes()

    return offsets.map(bits)


def collect_bits(cells: DataFrame, rows: int, size: int) -> np.ndarray:
    """Bit maps of ``size`` cells (a multiple of 65,536), one per row, from columns ``depth`` and ``cell``.

    The driver receives set blocks of 8 KB in ``PARTS`` portions: at most ``rows * size / 8`` bytes, whatever
    the number of input rows.
    """
    blocks = cells.groupBy("depth", F.expr(f"cell div {BLOCK}").alias("block")).agg(
        F.collect_set((F.col("cell") % BLOCK).cast("int")).alias("offsets")
    )
    maps = np.zeros((rows, size // 8), dtype=np.uint8)
    packed = blocks.select("depth", "block", _pack("offsets").alias("bits")).repartition(PARTS)
    for row in packed.toLocalIterator(prefetchPartitions=True):
        at = row["block"] * BLOCK // 8
        maps[row["depth"], at : at + BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return maps


def has_bits(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def cell_of(key: Column) -> Column:
    """Place of a key in a member map; null for null."""
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key.cast("string")), F.lit(MEMBERS)))


def member_bits(keys: DataFrame, key: str):
    """Broadcast map of ``MEMBERS`` bits, whatever the number of keys: set at the cell of every ``keys[key]``.

    Rows whose cell is not set need not be shuffled to a join with ``keys``. Beyond some ten million keys the
    map passes most rows, and the join does the rest.
    """
    cells = keys.filter(F.col(key).isNotNull()).select(F.lit(0).alias("depth"), cell_of(F.col(key)).alias("cell"))
    return keys.sparkSession.sparkContext.broadcast(collect_bits(cells, 1, MEMBERS)[0])


def listed(bits: np.ndarray, cells: pa.Array) -> np.ndarray:
    """Which rows of a batch may be members; never one with a null cell."""
    return has_bits(bits, cells.fill_null(0).to_numpy()) & cells.is_valid().to_numpy(zero_copy_only=False)


def maybe_member(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """Test for a key column: true for every value of ``keys[key]``, seldom for others, false for null."""
    bits = member_bits(keys, key)

    @F.pandas_udf("boolean")
    def test(cells: pd.Series) -> pd.Series:
        return pd.Series(has_bits(bits.value, cells.to_numpy()))

    return lambda c: c.isNotNull() & test(cell_of(F.coalesce(c.cast("string"), F.lit(""))))


def keep_listed(df: DataFrame, bits, cell: str = "cell") -> DataFrame:
    """Rows that may be members."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(listed(bits.value, batch.column(cell))))

    return df.mapInArrow(keep, df.schema)
