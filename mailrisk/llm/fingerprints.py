"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Whether a hash is kept depends on
nothing but itself, so the sketch of a union is the union of the sketches, and the share of a
sketch found in another estimates how much of one document the other contains, however unequal their
sizes. A text with shingles of which none lies below the threshold keeps its smallest hash, so that only
texts without words have empty sketches.

Only built-in functions are used. Sketches are projections; ``edited_neighbours`` orders the ids
by range partitions of narrow rows and moves each text through one exchange, and the part of it
that the row before needs through another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk.session import materialise

WIDTH = 5
FRACTION = 1 / 8


def with_sketch(
    df: DataFrame, text: Column, name: str, width: int = WIDTH, fraction: float = FRACTION
) -> DataFrame:
    """Add ``name``: the ascending distinct hashes kept from the ``width``-word shingles of a text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words is one shingle; a null or empty one has none.
    """
    below = -(1 << 63) + int(fraction * (1 << 64))
    words, hashes = f"_{name}_words", f"_{name}_hashes"
    n = F.size(words)
    shingle = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(width)]),
    )
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(below))))
    return (
        df.withColumn(words, F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        .withColumn(
            hashes,
            F.when(n >= width, shingle)
            .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words))))
            .otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn(name, kept)
        .withColumn(
            name, F.when((F.size(name) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.col(name))
        )
        .drop(words, hashes)
    )


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents taken together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 for an empty sketch."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger; an empty one is like another empty one only."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(
        (F.size(a) == F.size(b)).cast("double")
    )


def as_string(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def _next_keys(keys: DataFrame) -> DataFrame:
    """``k`` and ``next`` for every distinct key that is not null; the first follows the last.

    Keys are dealt out by ranges and written, which fixes the ranges. Windows see one range each, and
    one row per range links a range to the next.
    """
    ranged = materialise(
        keys.filter("k IS NOT NULL").distinct().repartitionByRange("k").select("k", F.spark_partition_id().alias("p")), "keys"
    )
    firsts = ranged.groupBy("p").agg(F.min("k").alias("first"))
    following = firsts.select(
        "p",
        F.coalesce(F.lead("first").over(W.orderBy("p")), F.min("first").over(W.partitionBy())).alias("after"),
    )
    within = W.partitionBy("p").orderBy("k")
    return ranged.withColumn("n", F.lead("k").over(within)).join(F.broadcast(following), "p").select(
        "k", F.coalesce("n", "after").alias("next")
    )


def edited_neighbours(
    df: DataFrame, key: str, text: str, width: int = WIDTH, fraction: float = FRACTION
) -> DataFrame:
    """One row per input row: ``key``, ``n_chars``, ``edited``, ``sketch``, ``edited_sketch``, ``next_sketch``.

    ``edited`` is the text with its last floor(n_chars/2) code points replaced by the first as many (or all)
    of the document with the next larger key; the first key follows the last, and a single document follows
    itself. Null texts are empty. Of several rows with the next key, the text with the smallest hash
    is taken. A null key has no place in the order: such a row is edited with the first document. Repeated rows
    are kept; an empty table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), body.alias("x"))
    # Joins go by name: null has one too, and no column beside it, so that both joins share one exchange of the texts.
    name = F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit(""))
    needs = materialise(rows.groupBy("k").agg(F.max(F.floor(F.char_length("x") / 2)).cast("int").alias("need")), "needs")
    ring = _next_keys(needs.select("k"))
    lone = needs.filter("k IS NULL").crossJoin(needs.agg(F.min("k").alias("next")).filter("next IS NOT NULL"))  # 1 x 1
    wanted = needs.join(ring, "k").unionByName(lone).select(
        name.alias("to"), "need", F.concat(F.lit("="), F.col("next").cast("string")).alias("name")
    )
    wanted = materialise(wanted, "wanted")
    texts = with_sketch(rows.select(name.alias("name"), "x"), F.col("x"), "sketch", width, fraction)
    sent = texts.join(wanted, "name").select(
        "to", F.expr("substring(x, 1, need)").alias("prefix"), F.col("sketch").alias("next_sketch"), F.xxhash64("x").alias("t")
    )
    one = sent.withColumn("rn", F.row_number().over(W.partitionBy("to").orderBy("t"))).filter("rn = 1").drop("rn", "t")
    half = "cast(floor(char_length(x) / 2) AS int)"
    joined = texts.join(one.withColumnRenamed("to", "name"), "name", "left").select(
        F.when(F.col("name") != "", F.expr("substring(name, 2)")).cast(df.schema[key].dataType).alias(key),
        F.char_length("x").cast("bigint").alias("n_chars"),
        F.expr(
            f"concat(substring(x, 1, char_length(x) - {half}), coalesce(substring(prefix, 1, {half}), ''))"
        ).alias("edited"),
        "sketch",
        F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"),
    )
    return with_sketch(joined, F.col("edited"), "edited_sketch", width, fraction)
