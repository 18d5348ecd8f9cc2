"""Prefix trie of conversations by truncation peeling.

Peeling descends from the greatest depth. At each depth the conversations that end there join the nodes that survive from below;
equal prefixes become one node with its counts, its last turn is stripped, and the shortened prefixes are grouped again one
level up. Nodes are discovered and aggregated in that one pass; every level only holds distinct prefixes.

On Spark the distinct conversations, as chains of turn hashes, are range-partitioned by their chain, so prefixes are neighbours and
a prefix that very many share is spread over as many partitions. Each task peels chunks of its sorted chains. A node between
a chunk's first and last chain is complete. The nodes on these two may go on in other chunks: they leave the task as two chains
that carry what was counted at each depth, and are peeled again among themselves, a small part of the input, until one chunk is left.

Chains are cut at every ``BLOCK`` turns, and blocks are peeled from the deepest up; what is left at a block's top enters the block above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.words import mix
from mailrisk.session import materialise

BLOCK = 1024
CHUNK = 1 << 16  # levels of chains peeled together
IDS = 4096  # conversation numbers to a string of an end's digest
_NONE, _UNKNOWN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``pos``, two hashes ``h``, ``g`` and the text's ``size`` of every turn, in order; no task holds a conversation."""
    r, x = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), F.xxhash64(r, x).alias("h"),
        F.xxhash64(F.lit(7), x, r).alias("g"), F.octet_length(x).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h", "row")]  # copies may be told apart by row

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, done = None, 0
        for batch in batches:
            convs = batch.column(0).to_numpy()
            if not len(convs):
                continue
            at = _running(np.concatenate(([convs[0] != before], convs[1:] != convs[:-1])), done)
            before, done = convs[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(convs), part, np.int32)), pa.array(at.astype(np.int64))], [*batch.schema.names, "part", "at"])

    placed = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "h", "g", "size").mapInArrow(
            place, "conv bigint, h bigint, g bigint, size bigint, part int, at bigint"),
        "placed",
    )
    # A conversation that goes on in the next partition: at most one of each partition does.
    pieces = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    several = pieces.groupBy("conv").agg(F.min("part").alias("l"), F.max("part").alias("m")).filter("l < m").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        pieces.join(several, "conv", "left_semi").select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    return placed.join(offsets, ["conv", "part"], "left").select(
        "conv", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "h", "g", "size")


def _running(fresh: np.ndarray, done: int) -> np.ndarray:
    """Place within its run of every row, where the first run goes on after ``done`` rows."""
    at = np.arange(len(fresh))
    starts = np.maximum.accumulate(np.where(fresh, at, 0))
    return at - starts + np.where(np.cumsum(fresh) == 0, done, 0)


def rebuild(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation (``conv``, ``length``) and its turns (``conv``, ``pos``, ``h``, ``g``, ``size``), rebuilt.

    The first h turns come from conversation ``conv - conv % 5``, h being CRC-32 of the number in decimals, modulo 9; the
    conversation's own turns after its first h follow.
    """
    turns = _turns(df, conv, turn, role, text)
    lengths = materialise(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "lengths")
    number = F.col("conv")
    own = lengths.select("conv", "n", (number - number % 5).alias("base"), (F.crc32(number.cast("string").cast("binary")) % 9).alias("h0"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h0", F.coalesce("base_n", F.lit(0)))
    convs = materialise(own.join(bases, "base", "left").select(
        "conv", "base", "h0", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h0"), F.lit(0))).alias("length")), "conversations")
    kept = turns.join(convs.select("conv", "h0", "taken"), "conv").filter("pos >= h0").withColumn("pos", F.expr("pos - h0 + taken"))
    given = turns.filter("pos < 8 AND conv % 5 = 0").withColumnRenamed("conv", "base").join(
        convs.select("conv", "base", "taken"), "base").filter("pos < taken")
    columns = ["conv", "pos", "h", "g", "size"]
    return convs.select("conv", "length"), kept.select(*columns).unionByName(given.select(*columns))


def _chains(convs: DataFrame, turns: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Chains by conversation and block ``j``: element 0 stands for the prefix before the block, element d for its d-th turn."""
    parts = turns.groupBy("conv", F.expr(f"pos div {block}").alias("j")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "h", "g", "size"))).alias("turns"))
    parts = materialise(parts, "parts")
    deepest = convs.agg(F.coalesce(F.max(F.expr(f"length div {block}")), F.lit(0))).first()[0]
    ends = convs.select("conv", "length", F.expr(f"length div {block}").alias("j"))
    zero = F.lit(0).cast("bigint")
    if deepest:  # prefixes of whole blocks, by hashes of the blocks
        upto = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tops = materialise(
            parts.filter(F.size("turns") == block).select(
                "conv", (F.col("j") + 1).alias("j"), F.bit_xor(F.xxhash64("j", F.col("turns.h"))).over(upto).alias("h0"),
                F.bit_xor(F.xxhash64("j", F.col("turns.g"))).over(upto).alias("g0"), F.element_at("turns", -1)["size"].alias("size0")),
            "tops",
        )
        slots = parts.select("conv", "j").unionByName(ends.select("conv", "j")).distinct()
        rows = slots.join(parts, ["conv", "j"], "left").join(tops, ["conv", "j"], "left").join(ends.select("conv", "length"), "conv")
    else:
        rows = ends.join(parts, ["conv", "j"], "left").select(
            "*", *[F.lit(None).cast("bigint").alias(c) for c in ("h0", "g0", "size0")])
    turns = F.coalesce("turns", F.array().cast("array<struct<pos:bigint,h:bigint,g:bigint,size:bigint>>"))
    head = F.array(F.struct(F.coalesce("h0", zero).alias("h"), F.coalesce("g0", zero).alias("g")))
    rows = rows.select(
        "conv", "length", "j", F.concat(head, F.transform(turns, lambda t: F.struct(t["h"].alias("h"), t["g"].alias("g")))).alias("chain"),
        F.concat(F.array(F.coalesce("size0", zero)), F.transform(turns, lambda t: t["size"])).alias("sizes"))
    return materialise(rows, "chains"), deepest


_COUNTS = ("n", "conv", "children", "leaves", "saved", "ends")
_IDLE = {"n": 0, "conv": _NONE, "children": 0, "leaves": 0, "saved": 0, "ends": _UNKNOWN}
_NODE = "kind int, depth bigint, conv bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends bigint, " \
    "id1 bigint, id2 bigint, up1 bigint, up2 bigint"
_ITEM = "chain array<struct<h:bigint,g:bigint>>, sizes array<bigint>, " + ", ".join(f"at_{c} array<bigint>" for c in _COUNTS)
NODE, PATH, TOP = 0, 1, 2


def _peel(h: np.ndarray, g: np.ndarray, sizes: np.ndarray, at: dict[str, np.ndarray], lens: np.ndarray, whole: bool, top: bool):
    """Peel sorted chains from their greatest depth.

    Returns the complete nodes as columns, and ``held``: what was counted on the first and the last chain, none if ``whole``. Level 0
    is the root if ``top``, else a block's top, given as a node of kind ``TOP`` without its own saving.
    """
    m = len(lens)
    offset = np.concatenate(([0], np.cumsum(lens)))[:-1]
    level = np.arange(len(h)) - np.repeat(offset, lens)
    same = np.zeros(m, dtype=np.int64)  # leading elements shared with the chain before
    for d in range(int(lens.max())):
        i = np.flatnonzero(same == d)
        i = i[(i > 0) & (lens[i] > d) & (lens[i - 1] > d)]
        i = i[(h[offset[i] + d] == h[offset[i - 1] + d]) & (g[offset[i] + d] == g[offset[i - 1] + d])]
        if not len(i):
            break
        same[i] += 1
    ids = []
    for x in (h, g):
        sums = np.cumsum(mix(x.view(np.uint64), 8) * (_ODD ** (level.astype(np.uint64) + np.uint64(1))))
        ids.append(mix(sums - np.repeat(np.concatenate(([np.uint64(0)], sums))[offset], lens), 9).view(np.int64))

    acc = {c: np.full(m, _IDLE[c], dtype=np.int64) for c in _COUNTS[:-1]}
    out: list[list[np.ndarray]] = []
    held = {c: [np.full(lens[i], _IDLE[c], dtype=np.int64) for i in (0, m - 1)] for c in _COUNTS}
    pending = None
    for d in range(int(lens.max()) - 1, -1, -1):
        items = np.flatnonzero(lens > d)
        edges = np.flatnonzero(same[items] <= d)
        first = items[edges]
        own = offset[items] + d
        total = {c: np.add.reduceat(acc[c][items] + at[c][own], edges) for c in ("n", "children", "leaves", "saved")}
        total["conv"] = np.minimum.reduceat(np.minimum(acc["conv"][items], at["conv"][own]), edges)
        total["ends"] = np.maximum.reduceat(at["ends"][own], edges)
        open_first, open_last = np.zeros((2, len(first)), dtype=bool)
        if not whole:  # the groups of the first and of the last chain, where these are so long
            open_first[0] = lens[0] > d
            open_last[-1] = lens[m - 1] > d
        is_open = open_first | open_last
        for which, mask in ((0, open_first), (1, open_last & ~open_first)):
            for k in np.flatnonzero(mask):
                for c in _COUNTS:
                    held[c][which][d] = total[c][k]
        if pending is not None:  # nodes one level deeper: now their parents are known
            group = np.searchsorted(first, pending["first"], side="right") - 1
            up = np.where(is_open[group], _UNKNOWN, total["conv"][group])
            above = offset[pending["first"]] + d
            out.append([np.full(len(up), NODE), np.full(len(up), d + 1), pending["conv"], up] + [
                pending[c] for c in ("n", "children", "leaves", "saved", "ends", "id1", "id2")] + [ids[0][above], ids[1][above]])
        size = sizes[offset[first] + d]
        leaves = np.where(total["children"] == 0, 1, total["leaves"])
        saved = total["saved"] + (total["n"] - 1) * size
        done = np.flatnonzero(~is_open)
        node = {c: total[c][done] for c in _COUNTS} | {
            "leaves": leaves[done], "saved": saved[done], "first": first[done],
            "id1": ids[0][offset[first[done]] + d], "id2": ids[1][offset[first[done]] + d]}
        pending = node if len(done) else None
        if d == 0 and len(done):
            kind = NODE if top else TOP
            if not top:
                node["saved"], node["leaves"] = total["saved"][done], total["leaves"][done]
            none = np.full(len(done), _UNKNOWN)
            out.append([np.full(len(done), kind), np.zeros(len(done), dtype=np.int64), node["conv"], none] + [
                node[c] for c in ("n", "children", "leaves", "saved", "ends", "id1", "id2")] + [none, none])
        for c in acc:
            acc[c][items] = _IDLE[c]
        f = first[done]
        acc["n"][f], acc["conv"][f], acc["children"][f] = total["n"][done], total["conv"][done], 1
        acc["leaves"][f], acc["saved"][f] = leaves[done], saved[done]
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else None
    return columns, (None if whole else held)


def _peeled(batches: Iterator[pa.RecordBatch], base: int, whole: bool, top: bool, chunk: int) -> Iterator[pa.RecordBatch]:
    """Peel sorted chains chunk by chunk; nodes, and the chains that go on elsewhere."""
    names = [f.split()[0] for f in _NODE.split(", ")]
    chain_type = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64())]))
    item_types = [chain_type] + [pa.list_(pa.int64())] * (1 + len(_COUNTS))
    item_names = ["chain", "sizes"] + [f"at_{c}" for c in _COUNTS]
    types = [pa.int32()] + [pa.int64()] * (len(names) - 1)

    def rows(columns: list, items: list[pa.Array] | None, n: int) -> pa.RecordBatch:
        own = [pa.nulls(n, t) for t in item_types] if items is None else items
        return pa.RecordBatch.from_arrays([pa.array(c, t) if c is not None else pa.nulls(n, t) for c, t in zip(columns, types)] + own, names + item_names)

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        columns = {c: table.column(c).combine_chunks() for c in item_names}
        flat = columns["chain"].flatten()
        h, g = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lens = columns["chain"].value_lengths().to_numpy().astype(np.int64)
        sizes = columns["sizes"].flatten().to_numpy()
        at = {c: columns[f"at_{c}"].flatten().to_numpy() for c in _COUNTS}
        nodes, held = _peel(h, g, sizes, at, lens, whole, top)
        if nodes is not None:
            nodes[1] = nodes[1] + base
            yield rows(nodes, None, len(nodes[0]))
        if held is not None:
            some = sorted({0, len(lens) - 1})
            edges = [columns["chain"].slice(i, 1) for i in some]
            lists = [pa.concat_arrays(edges), pa.concat_arrays([columns["sizes"].slice(i, 1) for i in some])]
            lists += [pa.array([held[c][k] for k in range(len(some))], pa.list_(pa.int64())) for c in _COUNTS]
            yield rows([[PATH] * len(some)] + [None] * (len(names) - 1), lists, len(some))

    held_back: list[pa.RecordBatch] = []
    levels = 0
    for batch in batches:
        lens = np.cumsum(batch.column("chain").value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = batch.num_rows if whole else int(np.searchsorted(lens, (lens[at - 1] if at else 0) + chunk - levels, side="left")) + 1
            part = batch.slice(at, min(upto, batch.num_rows) - at)
            held_back.append(part)
            levels += int(lens[at + part.num_rows - 1] - (lens[at - 1] if at else 0))
            at += part.num_rows
            if not whole and levels >= chunk:
                yield from work(held_back)
                held_back, levels = [], 0
    if held_back:
        yield from work(held_back)


def _items(rows: DataFrame, counts: dict) -> DataFrame:
    """Chains with ``counts`` at their last element."""
    def last(c: str):
        idle = F.array_repeat(F.lit(int(_IDLE[c])).cast("bigint"), F.size("chain") - 1)
        return F.concat(idle, F.array(counts[c].cast("bigint"))).alias(f"at_{c}")

    return rows.select("chain", "sizes", *[last(c) for c in _COUNTS])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's sorted strings of numbers, joined by commas."""
    rep, digest, out = None, None, []
    for batch in batches:
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != rep:
                if digest is not None:
                    out.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["ends", "sha256"])
            out = []
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"ends": [rep], "sha256": [digest.hexdigest()]})


def trie_nodes(convs: DataFrame, turns: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """All nodes of the trie of ``convs`` (``conv``, ``length``) and their ``turns`` (``conv``, ``pos`` from 0, ``h``, ``g``, ``size``).

    Turns are equal if both hashes are. Returns ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. The root is there as soon as there is a conversation, with or without turns.
    """
    chains, deepest = _chains(convs, turns, block)
    kind = f"{_NODE}, {_ITEM}"
    hashes = [F.xxhash64(F.lit(i), "length", F.col(f"chain.{x}")).alias(f"e{i}") for i, x in ((1, "h"), (2, "g"))]
    ends = chains.filter(F.expr(f"j = length div {block}")).select("*", *hashes)
    groups = materialise(ends.groupBy("length", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")), "ends")
    distinct = materialise(ends.drop("length", "e1", "e2").join(groups.select(F.col("rep").alias("conv"), "n"), "conv"), "distinct")

    many = groups.filter("n > 1").select("length", "e1", "e2", "rep")
    strings = ends.select("conv", "length", "e1", "e2").join(many, ["length", "e1", "e2"]).groupBy(
        "rep", F.expr(f"conv div {IDS}").alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = materialise(
        strings.repartition("rep").sortWithinPartitions("rep", "part").select("rep", "ids").mapInArrow(_digests, "ends bigint, sha256 string"), "digests")

    found, tops, later = [], None, []
    for j in range(deepest, -1, -1):
        items = _items(distinct.filter(F.col("j") == j), {
            "n": F.col("n"), "conv": F.col("conv"), "children": F.lit(0), "leaves": F.lit(0), "saved": F.lit(0), "ends": F.col("conv")})
        if tops is not None:
            above = tops.join(chains.filter(F.col("j") == j).select("conv", "chain", "sizes"), "conv")
            items = items.unionByName(_items(above, {c: F.col(c) for c in _COUNTS}))
        tops, rounds = [], 0
        while True:
            items = materialise(items, "chains-to-peel")
            levels = items.agg(F.coalesce(F.sum(F.size("chain")), F.lit(0))).first()[0]
            whole = levels <= chunk
            if whole:
                placed = items.coalesce(1)
            else:
                placed = items.repartitionByRange("chain") if not rounds else items.repartitionByRange(-(-levels // chunk), "chain")
            peeled = materialise(
                placed.sortWithinPartitions("chain").mapInArrow(
                    lambda it, b=j * block, w=whole, t=j == 0: _peeled(it, b, w, t, chunk), kind),
                "peeled",
            )
            nodes = peeled.select(*[f.split()[0] for f in _NODE.split(", ")])
            found.append(nodes.filter(F.col("kind") == NODE))
            tops.append(nodes.filter(F.col("kind") == TOP))
            if rounds:
                later.append(nodes.filter(F.col("kind") != PATH))
            rounds += 1
            if whole:
                break
            items = peeled.filter(F.col("kind") == PATH).select(*[f.split()[0] for f in _ITEM.split(", ")])
        tops = _all(tops)
    rows = _all(found)
    if later:  # nodes whose parents went on in other chunks
        parents = materialise(_all(later).select(
            (F.col("depth") + 1).alias("depth"), F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv").alias("found")), "parents")
        waiting = (F.col("parent") == int(_UNKNOWN)) & (F.col("depth") > 0)
        resolved = rows.filter(waiting).join(parents, ["depth", "up1", "up2"]).withColumn("parent", F.col("found")).select(*rows.columns)
        rows = rows.filter(~waiting).unionByName(resolved)
    single = F.sha2(F.when(F.col("ends") == int(_UNKNOWN), "").otherwise(F.col("ends").cast("string")).cast("binary"), 256)
    return rows.join(digests, "ends", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha256", single).alias("ends_sha256"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rebuilt_trie(df: DataFrame, conv: str, turn: str, role: str, text: str, block: int = BLOCK) -> DataFrame:
    """``trie_nodes`` of the rebuilt conversations of ``df``.

    Turns stand in the order of ``turn`` (null first); turns of one number by role and a hash of role and text. Null roles and texts are
    empty. Conversations are whole numbers, taken as bigint; rows without one are left out. Repeated rows are turns of their own.
    Other columns are not read. An empty table has no nodes.
    """
    return trie_nodes(*rebuild(df, conv, turn, role, text), block)
