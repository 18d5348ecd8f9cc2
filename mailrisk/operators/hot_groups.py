"""Ranking, sampling and ordered scans that stay spread out when one group holds most rows.

A plain ``row_number() over (partition by g)`` puts a whole group into one task. The helpers here
cut every group into slices first, count the slices (partial aggregation, a few bytes per slice),
and only then order rows inside a slice. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk.session import materialise

def hash_key(salt: str, *parts: Column) -> Column:
    """Reproducible sort key: 32 hex digits, evenly spread."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]))


def rank_cuts(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    tie: str,
    targets: Callable[[Column], Sequence[Column]],
    bucket_hex: int = 4,
) -> DataFrame:
    """``groups`` and ``_cuts``: per wanted rank the (key, tie) pair standing there, written to the shared folder.

    Each entry of the map ``_cuts`` has the ``pair`` (null: before all rows), how many of its rows are wanted
    (``take``) and how many there are (``of``). ``targets`` maps the group's row count to ranks, and may name
    ``_everything``, the count of all groups. Rows are counted by the first hex digits of the key; only the bucket that
    holds a wanted rank is ordered, and there copies of a pair are one row.
    """
    groups = list(groups)
    bucket = F.substring(key, 1, bucket_hex)
    counts = df.groupBy(*groups, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*groups).orderBy("_bucket")
    placed = counts.select(
        "*",
        F.sum("_n").over(upto).alias("_end"),
        F.sum("_n").over(W.partitionBy(*groups)).alias("_total"),
        F.sum("_n").over(W.partitionBy()).alias("_everything"),
    )
    wanted = F.array(*[t.cast("bigint") for t in targets(F.col("_total"))])
    edges = placed.select(
        *groups, "_bucket", (F.col("_end") - F.col("_n")).alias("_before"), "_end",
        F.posexplode(wanted).alias("_slot", "_rank"),
    )
    inside = (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_end"))
    edges = edges.filter(inside | ((F.col("_before") == 0) & (F.col("_rank") <= 0)))
    edges = materialise(
        edges.select(*groups, "_bucket", "_slot", "_rank", (F.col("_rank") - F.col("_before")).alias("_need")), "edges"
    )
    hits = edges.filter("_rank > 0").select(*groups, "_bucket").distinct()
    pairs = (
        df.select(*groups, key, tie, bucket.alias("_bucket"))
        .join(hits, [*groups, "_bucket"], "left_semi")
        .groupBy(*groups, "_bucket", key, tie)
        .agg(F.count(F.lit(1)).alias("_of"))
    )
    within = W.partitionBy(*groups, "_bucket").orderBy(key, tie)
    ranked = pairs.withColumn("_last", F.sum("_of").over(within)).withColumnRenamed("_bucket", "_b")
    same = [edges[g] == ranked[g] for g in groups]
    reached = (F.col("_need") > F.col("_last") - F.col("_of")) & (F.col("_need") <= F.col("_last"))
    found = edges.join(ranked, [*same, F.col("_bucket") == F.col("_b"), reached], "left")
    cut = F.struct(
        F.when(F.col("_of").isNotNull(), F.struct(F.col(key), F.col(tie))).alias("pair"),
        (F.col("_need") - F.col("_last") + F.col("_of")).alias("take"),
        F.col("_of").alias("of"),
    )
    cuts = found.groupBy(*[edges[g] for g in groups]).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", cut.alias("_cut")))).alias("_cuts")
    )
    return materialise(cuts, "cuts")


def slot_by_rank(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    tie: str,
    targets: Callable[[Column], Sequence[Column]],
    n_targets: int,
    bucket_hex: int = 4,
) -> DataFrame:
    """Add ``slot``: how many of the wanted ranks lie before the row (0 = within the first).

    Counts are exact whatever repeats: rows that share the (key, tie) pair at a cut are written with a number
    of their own, counted in salted slices, and the wanted number of them is taken. All other rows are only
    compared with one pair per group and rank; they are neither sorted nor shuffled.
    """
    groups = list(groups)
    cuts = rank_cuts(df, groups, key, tie, targets, bucket_hex)
    row = F.struct(F.col(key), F.col(tie))

    def slotted(rows: DataFrame, copy: Column) -> DataFrame:
        total = F.lit(0)
        for j in range(n_targets):
            cut = F.col("_cuts")[F.lit(j)]
            after = (row > cut["pair"]) | ((row == cut["pair"]) & (copy > cut["take"]))
            total = total + F.when(cut["pair"].isNull() | after, 1).otherwise(0)
        return rows.withColumn("slot", total).drop("_cuts")

    judged = df.join(cuts, groups, "left")
    if cuts.filter(F.exists(F.map_values("_cuts"), lambda c: c["take"] < c["of"])).isEmpty():
        return slotted(judged, F.lit(0))
    tied = F.coalesce(F.exists(F.map_values("_cuts"), lambda c: (c["pair"] == row) & (c["take"] < c["of"])), F.lit(False))
    held = materialise(judged.filter(tied).drop("_cuts").withColumn("_id", F.monotonically_increasing_id()), "ties")
    numbered = salted_row_number(held, [*groups, key, tie], "_id", "_copy").drop("_id")
    return slotted(judged.filter(~tied), F.lit(0)).unionByName(
        slotted(numbered.join(cuts, groups), F.col("_copy")).drop("_copy").select(*df.columns, "slot")
    )


def salted_row_number(
    df: DataFrame, keys: Sequence[str], row_id: str, name: str, salt_hex: int = 2
) -> DataFrame:
    """Number the rows of each group 1..n, in an order fixed by the hash of ``row_id``.

    For groups whose rows are interchangeable (copies of one text), however many there are.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.substring(F.md5(F.col(row_id).cast("string")), 1, salt_hex))
    return _numbered(salted, keys, "_salt", [F.col(row_id)], name).drop("_salt")


def sliced_row_number(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], name: str
) -> DataFrame:
    """``row_number`` per group in ``order``; ``slice_by`` must not decrease along that order."""
    sliced = df.withColumn("_slice", slice_by)
    return _numbered(sliced, list(keys), "_slice", [F.col(c) for c in order], name).drop("_slice")


def _numbered(df: DataFrame, keys: list[str], part: str, order: list[Column], name: str) -> DataFrame:
    counts = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, part).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(within))
    return (
        numbered.join(offsets, [*keys, part])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_before", "_rn")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``lag(value)`` per group in ``order`` without collecting a group in one task."""
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_slice", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    )
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.select(
        "*", F.lag(value).over(within).alias("_lag"), F.row_number().over(within).alias("_rn")
    )
    joined = local.join(carried, [*keys, "_slice"])
    return joined.withColumn(
        name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    ).drop("_slice", "_lag", "_rn", "_carry")


def running_max_before(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the group, null for the first row."""
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    peaks = sliced.groupBy(*keys, "_slice").agg(F.max(value).alias("_peak"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = peaks.select(*keys, "_slice", F.max("_peak").over(before).alias("_carry"))
    earlier = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.max(value).over(earlier))
    joined = local.join(carried, [*keys, "_slice"])
    return joined.withColumn(name, F.greatest("_carry", "_local")).drop("_slice", "_local", "_carry")


def trailing_mean(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    value: str,
    width: int,
    name: str,
    block: int = 10_000,
) -> DataFrame:
    """Mean of ``value`` over the row and the ``width - 1`` rows before it in its group.

    Rows are numbered, cut into blocks, and the last ``width - 1`` rows of a block are also sent to
    the next one, so no window sees more than ``block + width`` rows.
    """
    keys = list(keys)
    numbered = sliced_row_number(df, keys, slice_by, order, "_pos")
    own = F.floor((F.col("_pos") - 1) / block)
    near_end = (F.col("_pos") - 1) % block >= block - (width - 1)
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(homes))
    window = W.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(width - 1), 0)
    return (
        spread.withColumn(name, F.avg(value).over(window))
        .filter(F.col("_block") == F.col("_own"))
        .drop("_pos", "_own", "_block")
    )


def salted_left_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], row_id: str, salts: int = 16
) -> DataFrame:
    """Left join in which the rows of a hot key are spread over ``salts`` tasks.

    ``small`` holds at most one row per key and is repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
