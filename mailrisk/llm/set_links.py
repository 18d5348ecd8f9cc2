"""Links between sets of shingles of high Jaccard similarity, from banded sketches to verified components.

Sketches only propose. Equal sets are folded to one node first. Every bucket of a band key links its members to one
pivot, which costs a row each, and the proposals are decided on the whole sets; that joins most groups of copies. What
then remains are buckets whose members lie in several components:

* buckets of up to ``pair_bucket`` nodes are compared in pairs, but those within one component;
* larger ones are split by an exact rule instead of being paired. Sets of similarity ``t`` share at least a share ``t`` of
  either set, so whatever the order of all shingles, they share one of the first ``n - ceil(t n) + 1`` of each. The places of
  the first one that they share also bound from above how many they share. With rare shingles first, documents that share
  a long passage and differ otherwise meet nowhere or are ruled out where they meet, and no similar pair is missed.

The order comes from a count sketch of fixed size; any fixed order gives the same links.

Wherever two sets meet, their odd sketches are compared first: ``ODD_BITS`` bits, each the parity of the shingles that fall on it. Bits that
differ never outnumber the shingles that only one of the sets holds, so a pair with too many of them is not similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.bitmap import cell_of, listed, maybe_member, member_bits
from mailrisk.llm.components import components
from mailrisk.llm.words import hash_words, rolling
from mailrisk.session import materialise

Prints = Callable[[np.ndarray], np.ndarray]
CELLS = 1 << 20
ODD_BITS = 512
PAIR_BUCKET = 16


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; fewer words are one shingle, none give an empty set."""
    words = hash_words(lower_words(text))
    return np.unique(rolling(words, min(width, len(words)))) if len(words) else words


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by the leading bits of their hashes, as 64-bit words."""
    at = (shingles >> np.uint64(64 - ODD_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=ODD_BITS).astype(np.uint8) & 1, bitorder="little").view("<i8")


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any set of at least this similarity."""
    return -(-percent * n // 100)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int, prints: Prints | None, bits) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose cell is listed or null."""
    for batch in batches:
        cells = batch.column(0)
        wanted = listed(bits.value, cells) | cells.is_null().to_numpy(zero_copy_only=False)
        sets = [shingle_set(text.as_py(), width) for text in batch.column(1).filter(pa.array(wanted))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(set_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
             pa.array([prints(s) for s in sets] if prints else [None] * len(sets), pa.list_(pa.int64()))],
            ["digest", "shingles", "print"],
        )


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        np.add.at(counts, batch.column(0).flatten().to_numpy() & (CELLS - 1), 1)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])


def _common_cells(batches: Iterator[pa.RecordBatch], width: int, bits) -> Iterator[pa.RecordBatch]:
    """Counts of ``_cell_counts`` over the sets of the texts whose cell is listed or null."""
    return _cell_counts(rows.select(["shingles"]) for rows in _set_rows(batches, width, None, bits))


def _first_shingles(batches: Iterator[pa.RecordBatch], width: int, commonness, percent: int, bits) -> Iterator[pa.RecordBatch]:
    """``digest`` and the shingles by which a set must meet every similar one, in order, of the texts whose cell is listed or null."""
    for rows in _set_rows(batches, width, None, bits):
        keys = [_prefix(shingles.values.to_numpy(), commonness.value, percent) for shingles in rows.column("shingles")]
        yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["digest", "keys"])


def _prefix(own: np.ndarray, commonness: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((own, commonness[own & (CELLS - 1)]))
    return own[order[: len(own) - least_overlap(len(own), percent) + 1]]


def _prefixes(batches: Iterator[pa.RecordBatch], commonness, percent: int) -> Iterator[pa.RecordBatch]:
    """The shingles by which a set must meet every similar one, with their places in the order."""
    for batch in batches:
        nodes, tokens = [], []
        for node, shingles in zip(batch.column(0).to_numpy(), batch.column(1)):
            tokens.append(_prefix(shingles.values.to_numpy(), commonness.value, percent))
            nodes.append(np.full(len(tokens[-1]), node))
        if nodes:
            places = np.concatenate([np.arange(len(t)) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate(nodes), np.concatenate(tokens), places)], ["node", "key", "place"])


def fold_sets(sketched: DataFrame) -> DataFrame:
    """One row per distinct set: ``node`` (its least row id), ``k`` of that row, ``digest``, ``n``, ``odd``, ``keys``."""
    least = F.min_by(F.struct("row", "k", "n", "odd", "keys"), "row").alias("one")
    folded = sketched.groupBy("digest").agg(least)
    return folded.select(F.col("one.row").alias("node"), "one.k", "digest", "one.n", "one.odd", "one.keys")


def link_sets(
    one: DataFrame, texts: DataFrame, width: int, percent: int, pair_bucket: int = PAIR_BUCKET,
    prints: Prints | None = None, most_bits: int = 0, more: DataFrame | None = None, whole: bool = False,
) -> DataFrame:
    """Links ``a``, ``b`` between nodes that give the components of all similar sets sharing a key, or with ``whole`` of all similar sets.

    ``one``: rows of ``fold_sets``; ``texts``: ``k``, ``x`` of the documents behind them. Two sets are similar if ``100 *
    intersection >= percent * union``. With ``prints``, fingerprints of 64-bit words, only proposals that differ in at most ``most_bits``
    bits of them are decided on the sets. ``more`` has further proposals. With ``whole``, keys and fingerprints only come first: what they
    miss is then found by the exact rule of crowded buckets, over all sets.
    """
    nodes = one.select("node", "k", "digest", "n", "odd")

    def enough(m: str, n: str) -> Column:
        """Common shingles of similar sets of these sizes: 100 c >= percent (m + n - c)."""
        return F.ceil(percent * (F.col(m) + F.col(n)) / (100 + percent))

    def may_be(m: str, n: str, odd_a: str, odd_b: str) -> Column:
        """False only for pairs that are not similar."""
        differ = reduce(Column.__add__, [
            F.bit_count(F.col(odd_a)[i].bitwiseXOR(F.col(odd_b)[i])) for i in range(ODD_BITS // 64)])
        return (F.least(m, n) >= enough(m, n)) & (differ <= F.col(m) + F.col(n) - 2 * enough(m, n))

    keys = one.select("node", F.explode("keys").alias("key"))
    shared = materialise(
        keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("z"), F.count(F.lit(1)).alias("members"))
        .filter("pivot < z").select("key", "pivot", "members"),
        "shared",
    )
    members = materialise(keys.join(shared, "key"), "buckets")

    def sets_of(wanted: DataFrame, prints: Prints | None = None) -> DataFrame:
        """``node``, ``shingles``, ``print`` of the nodes listed."""
        needed = materialise(wanted.join(nodes.select("node", "k", "digest"), "node"), "needed")
        bits = member_bits(needed, "k")
        rows = texts.select(cell_of(F.col("k")), "x").mapInArrow(
            lambda it: _set_rows(it, width, prints, bits), "digest binary, shingles array<bigint>, print array<bigint>")
        sets = materialise(rows.join(needed.select("node", "digest"), "digest").dropDuplicates(["node"]).drop("digest"), "sets")
        bits.destroy()
        return sets

    def similar(proposed: DataFrame, prints: Prints | None) -> DataFrame:
        """The pairs that are similar, decided on their whole sets."""
        facts = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab"]
        both = proposed.distinct().join(facts[0], "a").join(facts[1], "b").filter(may_be("n_a", "n_b", "odd_a", "odd_b"))
        both = materialise(both.select("a", "b", "n_a", "n_b"), "proposed")
        wanted = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
        sets = sets_of(wanted, prints)
        if prints:
            sides = [sets.select(F.col("node").alias(x), F.col("print").alias(f"print_{x}")) for x in "ab"]
            differ = F.zip_with("print_a", "print_b", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int"))
            near = F.aggregate(differ, F.lit(0), lambda x, y: x + y) <= most_bits
            both = materialise(both.join(sides[0], "a").join(sides[1], "b").filter(near).select("a", "b", "n_a", "n_b"), "near")
        sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
        common = F.size(F.array_intersect("set_a", "set_b"))
        met = both.join(sides[0], "a").join(sides[1], "b")
        return materialise(met.filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "similar")

    def apart(buckets: DataFrame, met: Column) -> DataFrame:
        """Pairs of one bucket in different components; those inside a bucket's largest component are not even met."""
        sizes = buckets.groupBy("key", "label").count()
        largest = sizes.groupBy("key").agg(
            F.max_by("label", F.struct("count", "label")).alias("largest"), F.min("label").alias("l"), F.max("label").alias("m")
        ).filter("l < m").select("key", "largest")
        mixed = materialise(buckets.join(largest, "key").join(nodes.select("node", "n", "odd"), "node"), "mixed")
        a, b = mixed.filter("label <> largest").alias("a"), mixed.alias("b")
        apart_here = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label"))
        return a.join(b, apart_here & met & may_be("a.n", "b.n", "a.odd", "b.odd")).select(
            F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
        ).distinct()

    def order_of(counts: DataFrame):
        """Broadcast counts of all cells."""
        commonness = np.zeros(CELLS, dtype=np.int64)
        for row in counts.groupBy("cell").agg(F.sum("n").alias("n")).repartition(8).toLocalIterator(prefetchPartitions=True):
            commonness[row["cell"]] = row["n"]
        return one.sparkSession.sparkContext.broadcast(commonness)

    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    proposed = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    found = similar(proposed if more is None else proposed.unionByName(more), prints)
    labels = components(found, "a", "b")

    if whole:
        # Straight from the texts: the sets of all of them together are larger than the texts.
        every = nodes.filter("n > 0").select("node", "k", "digest").join(labels, "node", "left").select(
            "node", "k", "digest", F.coalesce("label", "node").alias("label"))
        every = materialise(every, "every")
        bits = member_bits(every, "k")
        cells = texts.select(cell_of(F.col("k")), "x")
        held = order_of(cells.mapInArrow(lambda it: _common_cells(it, width, bits), "cell bigint, n bigint"))
        firsts = cells.mapInArrow(lambda it: _first_shingles(it, width, held, percent, bits), "digest binary, keys array<bigint>")
        firsts = firsts.join(every.select("node", "digest", "label"), "digest").dropDuplicates(["node"])
        firsts = materialise(firsts.select("node", "label", "keys"), "firsts")
        held.destroy()
        bits.destroy()
        flat = firsts.select("node", "label", F.posexplode("keys").alias("place", "key"))
        ends = flat.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("key")
        ends = materialise(ends, "ends")
        # Most shingles stand in one component only; merged, as Spark sees only the size before the explosion.
        flat = flat.filter(maybe_member(ends, "key")(F.col("key"))).hint("merge")
        prefixes = materialise(flat.join(ends, "key").select("node", "key", "place", "label"), "prefixes")
        return found.unionByName(similar(apart(prefixes, left >= enough("a.n", "b.n")), None))

    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("key")
    mixed = materialise(labelled.join(ends, "key", "left_semi"), "several")
    rest = apart(mixed.filter(F.col("members") <= pair_bucket).select("key", "node", "label"), F.lit(True))

    crowd = materialise(mixed.filter(F.col("members") > pair_bucket).select("node", "label").distinct(), "crowd")
    if not crowd.isEmpty():
        sets = sets_of(crowd.select("node"))
        held = order_of(sets.select("shingles").mapInArrow(_cell_counts, "cell bigint, n bigint"))
        prefixes = sets.select("node", "shingles").mapInArrow(
            lambda it: _prefixes(it, held, percent), "node bigint, key bigint, place bigint"
        )
        prefixes = materialise(prefixes.join(crowd, "node"), "prefixes")
        held.destroy()
        rest = rest.unionByName(apart(prefixes, left >= enough("a.n", "b.n")))
    return found.unionByName(similar(rest, prints))


def least_keys(sketched: DataFrame, one: DataFrame, links: DataFrame) -> DataFrame:
    """``digest`` of every set and ``component_id``, the least key of its component (null if all its keys are null)."""
    first = sketched.groupBy("digest").agg(F.min("k").alias("first"))
    labels = components(links, "a", "b")
    labelled = one.select("node", "digest").join(first, "digest").join(labels, "node", "left").select(
        "digest", "first", F.coalesce("label", "node").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return materialise(labelled.join(least, "label").select("digest", "component_id"), "classes")
