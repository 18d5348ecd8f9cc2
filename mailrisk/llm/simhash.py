"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance.

Fingerprints are folded first, so exact copies cost one row. The 64 bits are split into ``blocks``
blocks. Two fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` whole blocks, so they meet under the key of some choice of that many blocks.
Within a bucket of at most ``pair_bucket`` fingerprints the pairs are compared, each pair under the
first choice of blocks it shares only. Larger buckets would be quadratic: their fingerprints are
linked through shared points instead. Two fingerprints differ in at most 2r bits exactly if some
point differs from each in at most r bits, so every fingerprint is sent to its points and
linked to the least fingerprint of each. That is linear and yields the same components.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.components import components
from mailrisk.llm.set_links import PAIR_BUCKET, fold_sets, least_keys, link_sets
from mailrisk.llm.superminhash import sketch
from mailrisk.llm.words import mix
from mailrisk.session import materialise

BITS = 64
CHUNK = 1 << 16


def simhash(text: str | None, width: int = 4) -> int:
    """Signed 64-bit fingerprint of the ``width``-word shingles, repeats included; zero without words."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if n > 1 else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return of(text)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks(blocks: int) -> list[int]:
    """Bit masks of nearly equal blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks whose keys hold less than one random fingerprint in four on average.

    The choice moves work between key rows and comparisons; the links found are the same.
    """
    blocks = distance + 2
    while blocks < 16 and n > 2 ** (BITS * (blocks - distance) / blocks) / 4:
        blocks += 1
    return blocks


def links(
    fingerprints: DataFrame, column: str, distance: int = 4, blocks: int | None = None, pair_bucket: int = 128
) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that give the components of all close pairs.

    ``fingerprints`` holds each value once. Pairs in large buckets may be linked through their least
    neighbour instead of directly. Even ``distance`` only.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    blocks = blocks or blocks_for(fingerprints.count(), distance)
    masks = block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - distance))
    fp = F.col(column)
    # Spark takes exploded rows for as few as they came from, and would collect them at the driver to broadcast them.
    keys = fingerprints.select(
        fp.alias("fp"),
        F.posexplode(F.array(*[
            fp.bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))) for c in choices
        ])).alias("choice", "key"),
    ).hint("merge")
    # Written, so that Spark can split the join back where a bucket is hot.
    shared = materialise(keys.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    members = materialise(keys.join(shared, ["choice", "key"]), "buckets")

    small = members.filter(F.col("n") <= pair_bucket)
    a, b = small.alias("a"), small.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    agree = reduce(
        Column.bitwiseOR,
        [F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)],
    )
    # The pair counts under its first choice: no block before the last of the choice agrees but those chosen.
    upto = F.array(*[F.lit((2 << c[-1]) - 1) for c in choices])[F.col("a.choice")]
    chosen = F.array(*[F.lit(sum(1 << i for i in c)) for c in choices])[F.col("a.choice")]
    pairs = a.hint("merge").join(
        b,
        (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= distance)
        & (agree.bitwiseAND(upto) == chosen),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    hot = members.filter(F.col("n") > pair_bucket).select("fp").distinct()
    flips = [0, *(
        _signed(sum(1 << i for i in c)) for r in range(1, distance // 2 + 1) for c in combinations(range(BITS), r)
    )]
    points = hot.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("d")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("d")).alias("point")
    )
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
    through = points.hint("merge").join(least, "point").filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through.distinct())


def near_duplicates(
    df: DataFrame, key: str, text: str, width: int = 4, distance: int = 4, blocks: int | None = None
) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (bigint), ``component_id``.

    Rows belong together if a chain of fingerprints joins them in which neighbours differ in at most
    ``distance`` bits; ``component_id`` is the least key of the component (null if all its keys are
    null). Null and empty texts have fingerprint zero and are linked like any other; equal texts always
    belong together. A repeated key keeps its rows. An empty table gives an empty result, and other
    columns of the input are not read.
    """
    rows = materialise(df.select(F.col(key).alias("k"), fingerprint(F.col(text), width).alias("fp")), "simhash")
    folded = materialise(rows.groupBy("fp").agg(F.min("k").alias("first")), "fingerprints")
    labels = components(links(folded, "fp", distance, blocks), "a", "b")
    labelled = folded.hint("merge").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labelled.hint("merge").join(least, "label").select("fp", "component_id")
    return rows.hint("merge").join(classes, "fp").select(
        F.col("k").alias(key), F.col("fp").alias("fingerprint"), "component_id"
    )


# Similar texts: 4 bits of 64 only hold pairs together that are nearly equal (a pair of five-word Jaccard similarity
# 0.8 differs in some ten), so banded signatures, sifted by wide fingerprints, propose more, and an exact rule over all shingles the rest.
WIDE = 512
SIFT = 4.0  # standard deviations of the differing bits that a candidate may have


def wide_votes(h: np.ndarray, bits: int = WIDE) -> np.ndarray:
    """Fingerprint of a set of shingle hashes: a bit is set if it is set in over half of them."""
    votes = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(h), CHUNK // 8):
        part = h[at : at + CHUNK // 8]
        wide = np.stack([mix(part, 300 + i) for i in range(bits // BITS)], axis=1)
        votes += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * votes > len(h)


def wide_print(h: np.ndarray) -> np.ndarray:
    return np.packbits(wide_votes(h), bitorder="little").view("<i8")


def most_bits(similarity: float, deviations: float = 1.0) -> int:
    """Differing bits of wide fingerprints of two sets with this Jaccard similarity: the mean and some standard deviations."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(WIDE * share + deviations * sqrt(WIDE * share * (1 - share)))


def similar_documents(
    df: DataFrame, key: str, text: str, width: int = 5, percent: int = 80, pair_bucket: int = PAIR_BUCKET
) -> DataFrame:
    """``key``, ``component_id`` for every distinct key: documents joined by a chain of similar ones.

    Two documents are similar if the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent``
    of 100. First come the texts that the fingerprints of ``near_duplicates`` link and those that share a band of their
    signatures, sifted by ``WIDE``-bit fingerprints; what these miss is found by the exact rule of ``set_links`` over all
    documents. All pairs are decided on the sets, so that no pair is lost and none is below.

    Words are lower-cased (A-Z), texts of equal words are one document, and texts without words are equal. Rows with one
    key count as one document; a null key takes no part. The key keeps its type, and ``component_id`` is the least key. An
    empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x")).filter("k IS NOT NULL")
    sketched = sketch(rows, width, simhash)
    one = materialise(fold_sets(sketched), "sets")
    # Texts that ``links`` joins are proposed through the least set of each fingerprint.
    prints = materialise(
        sketched.select("digest", F.col("of_text").alias("fp")).distinct().hint("merge").join(one.select("digest", "node"), "digest").select("fp", "node"),
        "prints",
    )
    folded = materialise(prints.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    close = links(folded.select("fp"), "fp").withColumnsRenamed({"a": "fp", "b": "other"})
    close = close.hint("merge").join(folded, "fp").join(folded.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other")
    equal = prints.hint("merge").join(folded, "fp").filter("node > a").select("a", F.col("node").alias("b"))
    proposed = equal.unionByName(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b"))
    found = link_sets(one, rows, width, percent, pair_bucket, wide_print, most_bits(percent / 100, SIFT), proposed, whole=True)
    # Rows of one key with several texts: all their sets belong together.
    several = sketched.groupBy("k").agg(F.min("digest").alias("l"), F.max("digest").alias("m")).filter("l < m").select("k")
    own = sketched.join(several, "k", "left_semi").select("k", "digest").distinct().join(one.select("digest", "node"), "digest")
    least = own.groupBy("k").agg(F.min("node").alias("a"))
    found = found.unionByName(own.join(least, "k").filter("node > a").select("a", F.col("node").alias("b")))
    classes = least_keys(sketched, one, found)
    return sketched.select("k", "digest").join(classes, "digest").groupBy(F.col("k").alias(key)).agg(
        F.min("component_id").alias("component_id")
    )
