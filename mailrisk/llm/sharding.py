"""Shard assignment by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends level by level: every child draws
``-ln(u) / weight`` with ``u`` hashed from the child's name and the row's key, and the smallest draw
wins, so a child receives rows in proportion to its weight. The draws of a child depend on nothing
but its own name and weight: when a weight changes, rows move only into or out of that subtree.
``grow`` adds a shard as a region of its own, so the only rows that move are those it takes.

Only built-in column functions are used. Placement is a projection without a shuffle; the slot
numbers come from counts per hash bucket and a window inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """One shard of the tree with the names of its region and rack."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards 0..n-1 in regions of ``racks`` racks with ``per_rack`` shards each."""
    per_region = per_rack * racks
    return [
        Leaf(f"region{i // per_region}", f"rack{i % per_region // per_rack}", i) for i in range(shards)
    ]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, opened as a region of its own."""
    new = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"grown{new}", "rack0", new, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _level(key: Column, leaves: Sequence[Leaf], path: str, levels: Sequence[str]) -> Column:
    """Shard chosen below ``path``; only the branch that wins is evaluated."""
    groups: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault(str(getattr(leaf, levels[0])), []).append(leaf)
    below = {
        name: F.lit(own[0].shard) if len(levels) == 1 else _level(key, own, f"{path}/{name}", levels[1:])
        for name, own in groups.items()
    }
    if len(groups) == 1:
        return next(iter(below.values()))
    winner = F.array_min(F.array(*[
        F.struct(_draw(key, f"{path}/{name}", sum(x.weight for x in own)).alias("d"), F.lit(i).alias("i"))
        for i, (name, own) in enumerate(groups.items())
    ]))["i"]
    *head, (_, last) = enumerate(below.values())
    out = last
    for i, shard in reversed(head):
        out = F.when(winner == i, shard).otherwise(out)
    return out


def place(key: Column, tree: Sequence[Leaf]) -> Column:
    """Shard of a key. Equal keys share a shard; null is a key like any other."""
    return _level(key.cast("string"), tree, "", ["region", "rack", "shard"]).cast("int")


def shard_rows(
    df: DataFrame, key: str, text: str, tree: Sequence[Leaf], buckets: int = 1024
) -> DataFrame:
    """One row per input row: ``key``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus one (null text: one, and its checksum is that of the
    empty text). ``slot`` numbers the rows of a shard from 0 without gaps: by hash bucket, then by key,
    checksum and size, so repeated rows get neighbouring slots and a null key has its place. An empty
    table gives an empty result. Columns of the input other than ``key`` and ``text`` are not read.

    A bucket holds 1/``buckets`` of a shard, and no larger group meets in one task; rows with one key
    and different texts are spread by checksum.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        place(F.col(key), tree).alias("shard"),
        place(F.col(key), grow(tree)).alias("grown_shard"),
    )
    rows = rows.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col(key).cast("string"), "text_crc32"), F.lit(buckets)).cast("int")
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most shards * buckets rows, whatever the input.
    offsets = F.broadcast(
        counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = W.partitionBy("shard", "_bucket").orderBy(F.col(key), "text_crc32", "size")
    return (
        rows.withColumn("_rn", F.row_number().over(within))
        .join(offsets, ["shard", "_bucket"])
        .select(
            key, "size", "text_crc32", "shard",
            (F.col("_before") + F.col("_rn") - 1).cast("bigint").alias("slot"), "grown_shard",
        )
    )
