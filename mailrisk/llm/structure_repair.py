"""Repair of the turn structure of conversations by cost DP and prefix-doubling path ranking.

A conversation becomes well formed, role initials ``(s?(ua)+)?``, by the cheapest edits: keep a turn (K, 0), give it the other
role (R, 2), delete it (D, 3; blank and repeated turns must go), insert an empty turn (I, 2); a truncated turn that stays costs 1.
Nodes are (turns consumed, state of the pattern), arcs are edits, and an arc is optimal if the cost from its tail is its own and
that from its head. Among the optimal paths the one with the least audit string wins.

* Cost DP, backwards: turn by turn over all conversations of a batch at once. Long conversations are cut into blocks of ``BLOCK``
  turns; a block is first reduced to the 4 x 4 costs from its entry to its exit states, and those are chained.
* Ranking: nodes are ranked by the first letter of their least audit, and then by its first 2, 4, 8 letters, from the ranks of a
  node and of the node its pointer leads to; pointers double with the lengths. Each node takes the optimal arc with the least letter
  and head rank. (No letter leaves a node twice, so here a letter alone fixes the arc.)
* The least path is read off the doubled pointers in as many rounds: every round doubles the number of its known nodes.

Texts take no part in this: a turn is one byte. They are joined to their edits at the end, streaming through sorted partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.session import materialise

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 2048  # turns of one conversation that are solved together
BATCH = 1 << 16  # turns solved together, of all conversations

# States of the pattern: nothing yet, after s, after u, after a.
STATES = 4
DELETE_COST, INSERT_COST, REROLE_COST = 3, 2, 2
_NEXT = np.array([2, 2, 3, 2])  # state after the user or assistant turn that may follow
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and initial s, u, a, other
_END = np.array([0, 4, 2, 0])  # cost of the inserts that complete the pattern
_TAIL = ("", "II", "I", "")
_FAR = 1 << 40
_LETTERS = b"\0DIKR"
_ROLE_OF = {2: "user", 3: "assistant"}
_TRUNCATED, _FORCED = 4, 8  # flags of a turn's byte beside its initial


def _symbols_cost(flat: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost from every node, layer by layer: ``last`` holds that from each block's exit states, with any further axes.

    Layers of a block follow each other, one more than it has turns; inserts after its last turn are left to the next block.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first = starts + np.arange(len(sizes))
    cost = np.empty((len(flat) + len(sizes), *last.shape[1:]), dtype=np.int64)
    cost[first + sizes] = last
    by_size = np.argsort(-sizes, kind="stable")
    ordered = sizes[by_size]
    extra = (slice(None),) + (None,) * (last.ndim - 2)
    for back in range(1, int(ordered[0]) + 1 if len(sizes) else 1):
        own = by_size[: np.searchsorted(-ordered, -back, side="right")]
        symbol = flat[starts[own] + sizes[own] - back].astype(np.int64)
        after = cost[first[own] + sizes[own] - back + 1]
        free = (symbol & _FORCED) == 0
        stays = np.where(free, (symbol & _TRUNCATED) >> 2, _FAR)[extra]
        best = np.empty_like(after)
        for q in range(STATES):
            to = _KEEP[q][symbol & 3]
            kept = after[np.arange(len(own)), np.maximum(to, 0)] + np.where(to < 0, _FAR, 0)[extra]
            other = after[:, _NEXT[q]] + REROLE_COST
            best[:, q] = np.minimum(after[:, q] + DELETE_COST, np.minimum(kept, other) + stays)
        two, three = best[:, 2].copy(), best[:, 3].copy()
        best[:, 2] = np.minimum(two, three + INSERT_COST)
        best[:, 3] = np.minimum(three, two + INSERT_COST)
        for q in (0, 1):
            best[:, q] = np.minimum(best[:, q], best[:, 2] + INSERT_COST)
        cost[first[own] + sizes[own] - back] = best
    return cost


def block_matrices(symbols: list[bytes]) -> np.ndarray:
    """Least cost from each entry state to each exit state of every block."""
    sizes = np.array([len(s) for s in symbols], dtype=np.int64)
    last = np.where(np.eye(STATES, dtype=bool), 0, _FAR)
    cost = _symbols_cost(np.frombuffer(b"".join(symbols), np.uint8), sizes, np.broadcast_to(last, (len(sizes), STATES, STATES)))
    return np.minimum(cost[np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]], _FAR)


def _optimal_arcs(flat: np.ndarray, sizes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node (layer, state): heads of its D, I, K and R arcs, and which of them are optimal. Exits have none."""
    layers = len(cost)
    inside = np.ones(layers, dtype=bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    symbol = np.zeros(layers, dtype=np.int64)
    symbol[inside] = flat
    at = np.arange(layers)[:, None]
    q = np.arange(STATES)[None, :]
    after = np.minimum(at + 1, layers - 1)
    free = ((symbol & _FORCED) == 0)[:, None]
    stays = ((symbol & _TRUNCATED) >> 2)[:, None]
    kept = _KEEP[:, symbol & 3].T
    heads = np.stack([after * STATES + q, at * STATES + _NEXT[q], after * STATES + np.maximum(kept, 0), after * STATES + _NEXT[q]], axis=2)
    price = np.stack(np.broadcast_arrays(
        np.full((1, STATES), DELETE_COST), np.full((1, STATES), INSERT_COST), np.where(free & (kept >= 0), stays, _FAR),
        np.where(free, stays + REROLE_COST, _FAR)), axis=2)
    optimal = (price + cost.reshape(-1)[heads] == cost[:, :, None]) & inside[:, None, None]
    return heads.reshape(-1, 4), optimal.reshape(-1, 4)


def rank_paths(heads: np.ndarray, optimal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Rank of every node by its least audit, letters and pointers along it (doubled each time), and its length.

    Columns are the arcs D, I, K, R in the order of their letters; a node without optimal arcs ends its audit.
    """
    ends = ~optimal.any(axis=1)
    own = np.arange(len(heads))
    first = optimal.argmax(axis=1)
    rank = np.where(ends, 0, first + 1)
    pointer = np.where(ends, own, heads[own, first])
    length = np.where(ends, 0, 1)
    pointers = [pointer]
    while not ends[pointer].all():
        rank = np.unique(rank * (len(rank) + 5) + rank[pointer], return_inverse=True)[1]
        length = length + length[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    rank = np.unique(rank * (len(rank) + 5) + rank[pointer], return_inverse=True)[1]
    # The arc with the least letter and the least head.
    order = np.where(optimal, (np.arange(4) + 1) * (len(rank) + 1) + rank[heads], np.iinfo(np.int64).max)
    letters = np.where(ends, 0, order.argmin(axis=1) + 1)
    return rank, letters, pointers, length


def read_paths(starts: np.ndarray, pointers: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the paths from ``starts``, path after path, and where each path begins among them (one entry more)."""
    path, node, offset = np.arange(len(starts)), starts, np.zeros(len(starts), dtype=np.int64)
    keep = length[starts] > 0
    path, node, offset = path[keep], node[keep], offset[keep]
    for k in reversed(range(len(pointers))):
        more = offset + (1 << k) < length[starts[path]]
        path, node, offset = (np.concatenate((x, y)) for x, y in zip(
            (path, node, offset), (path[more], pointers[k][node[more]], offset[more] + (1 << k))))
    order = np.lexsort((offset, path))
    return node[order], np.concatenate(([0], np.cumsum(length[starts])))


def solve_blocks(symbols: list[bytes], last: np.ndarray) -> list[list[tuple[bytes, bytes, int]]]:
    """For each block and entry state: the least audit, the same without forced deletions, and the exit state."""
    sizes = np.array([len(s) for s in symbols], dtype=np.int64)
    flat = np.frombuffer(b"".join(symbols), np.uint8)
    cost = _symbols_cost(flat, sizes, last)
    _, letters, pointers, length = rank_paths(*_optimal_arcs(flat, sizes, cost))
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    starts = (first[:, None] * STATES + np.arange(STATES)).reshape(-1)
    nodes, edges = read_paths(starts, pointers, length)
    audits = np.frombuffer(_LETTERS, np.uint8)[letters[nodes]]
    forced = np.zeros(len(cost), dtype=bool)
    inside = np.ones(len(cost), dtype=bool)
    inside[first + sizes] = False
    forced[inside] = (flat & _FORCED) > 0
    free = ~(forced[nodes // STATES] & (audits == ord("D")))
    exits = pointers[-1][starts] % STATES
    out = []
    for i in range(len(symbols)):
        rows = []
        for j in range(i * STATES, (i + 1) * STATES):
            part = slice(edges[j], edges[j + 1])
            rows.append((audits[part].tobytes(), audits[part][free[part]].tobytes(), int(exits[j])))
        out.append(rows)
    return out


def _block_rows(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted turns into blocks of one conversation: their place, first key, bytes, ends, and costs from entry to exit."""
    part = TaskContext.get().partitionId()
    held: list[dict] = []
    now: dict = {}
    size = seq = 0
    schema = None

    def close() -> None:
        nonlocal now, size
        if now:
            now["symbols"] = bytes(now["symbols"])
            held.append(now)
            size += len(now["symbols"])
            now = {}

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            costs = block_matrices([b["symbols"] for b in held]).reshape(len(held), -1)
            yield pa.RecordBatch.from_pylist([b | {"costs": c} for b, c in zip(held, costs.tolist())], schema=schema)
            held.clear()
            size = 0

    for batch in batches:
        if schema is None:
            fields = [batch.schema.field(i) for i in range(4)]
            schema = pa.schema(fields + [
                ("part", pa.int32()), ("seq", pa.int64()), ("symbols", pa.binary()), ("costs", pa.list_(pa.int64()))])
        for conv, turn, role, digest, symbol, n in zip(*(c.to_pylist() for c in batch.columns)):
            left = n
            while left:
                if now and (now["conv"] != conv or len(now["symbols"]) >= block):
                    close()
                    if size >= BATCH:
                        yield from flush()
                if not now:
                    now = {"conv": conv, "turn": turn, "role": role, "digest": digest, "part": part, "seq": seq, "symbols": bytearray()}
                    seq += 1
                if left == n:
                    now["symbols"].append(symbol)
                    left -= 1
                else:  # copies of a turn just seen
                    more = min(left, block - len(now["symbols"]))
                    now["symbols"] += bytes([(symbol & 3) | _FORCED]) * more
                    left -= more
    close()
    yield from flush()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from last to first: the cost behind each block, and its least audits by entry state."""
    before, behind = object(), _END
    for batch in batches:
        rows = batch.to_pylist()
        while rows:
            some, size = [], 0
            while rows and size < BATCH:
                some.append(rows.pop(0))
                size += len(some[-1]["symbols"])
            last = np.empty((len(some), STATES), dtype=np.int64)
            for i, row in enumerate(some):
                if row["conv"] != before:
                    before, behind = row["conv"], _END
                last[i] = behind
                behind = (np.array(row["costs"]).reshape(STATES, STATES) + behind).min(axis=1)
                row["cost"] = int(behind[0])
            for row, found in zip(some, solve_blocks([r["symbols"] for r in some], last)):
                row |= {"audits": [a for a, _, _ in found], "moves": [m for _, m, _ in found], "exits": [e for _, _, e in found]}
                del row["costs"]
            schema = pa.schema([f for f in batch.schema if f.name != "costs"] + [
                ("cost", pa.int64()), ("audits", pa.list_(pa.binary())), ("moves", pa.list_(pa.binary())), ("exits", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(some, schema=schema)


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from first to last: follow the states, and take the audit of the state that each is entered in."""
    state, before, held = 0, None, None
    for batch in batches:
        out = []
        schema = pa.schema([f for f in batch.schema if f.name not in ("symbols", "audits", "moves", "exits")] + [
            ("audit", pa.string()), ("moved", pa.string()), ("illegal", pa.int64())])
        for row in batch.to_pylist():
            fresh = held is None or row["conv"] != held["conv"]
            if held is not None:
                if fresh:
                    held["audit"] += _TAIL[state]
                    held["moved"] += _TAIL[state]
                out.append(held)
            if fresh:
                state, before = 0, None
            initials = np.frombuffer(row["symbols"], np.uint8) & 3
            pairs = initials[:-1].astype(np.int64) * 4 + initials[1:]
            illegal = int((~np.isin(pairs, [a * 4 + b for a, b in _LEGAL])).sum())
            illegal += before is not None and (before, int(initials[0])) not in _LEGAL
            held = {f: row[f] for f in ("conv", "turn", "role", "digest", "part", "seq")} | {
                "cost": row["cost"] if fresh else 0, "audit": row["audits"][state].decode(),
                "moved": row["moves"][state].decode(), "illegal": illegal}
            before, state = int(initials[-1]), row["exits"][state]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        held["audit"] += _TAIL[state]
        held["moved"] += _TAIL[state]
        yield pa.RecordBatch.from_pylist([held], schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conv``, ``position``, ``role``, ``text``, ``edit`` of every repaired turn, and (``conv``, None, ...) after its last.

    Rows come sorted: edits of a block before its turns. At most the edits of some blocks are held.
    """
    conv, moves, at, position, state, begun = None, "", 0, 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, position, state
        while at < len(moves) and moves[at] == "I":
            state = int(_NEXT[state])
            yield conv, position, _ROLE_OF[state], "", "I"
            at, position = at + 1, position + 1

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "kind", "moved", "text"))):
            if not begun or row[0] != conv:
                if begun:
                    yield from inserted()
                    yield conv, None, None, None, None
                conv, moves, at, position, state, begun = row[0], "", 0, 0, 0, True
            if row[2] == 0:
                moves, at = moves[at:] + row[3], 0
                continue
            yield from inserted()
            edit, role = moves[at], row[1]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = int(_NEXT[state])
                role = _ROLE_OF[state]
            else:
                state = int(_KEEP[state]["sua".index(role[0])])
            yield conv, position, role, row[4], edit
            position += 1
    if begun:
        yield from inserted()
        yield conv, None, None, None, None


def _turn_rows(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", conv), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    held, size = [], 0
    for row in _repaired(batches):
        if row[1] is not None:
            held.append(dict(zip(schema.names, row)))
            size += len(row[3])
        if len(held) >= 1000 or size > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _digest_rows(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", conv), ("sha256", pa.string())])
    held, digest = [], hashlib.sha256()
    for c, position, role, text, _ in _repaired(batches):
        if position is None:
            held.append({"conv": c, "sha256": digest.hexdigest()})
            digest = hashlib.sha256()
        else:
            digest.update(("\n" * (position > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        if len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` of a table damaged by the CRC-32 of ``conv:turn``, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user turn. Nulls count as one space in the
    key, as a role and as a text; a null turn stays null.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


class Repair:
    """Cheapest repair of every conversation of ``df``, by columns ``conv``, ``turn``, ``role``, ``text``.

    Turns stand in the order of ``turn`` (null first); turns of one number by role and the MD5 of the text. Null roles and texts are
    one space. A role counts by its first character; a role that is empty or begins otherwise than s, u, a cannot be kept. A null
    conversation is one like any other. Copies of a turn are folded before they are shuffled: all but the first must go anyway.
    ``block`` turns of a conversation are solved together. Other columns are not read; an empty table gives empty results.
    """

    def __init__(self, df: DataFrame, conv: str, turn: str, role: str, text: str, block: int = BLOCK):
        as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = df.select(
            F.col(conv).alias("conv"), F.col(turn).alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"))
        trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
        digest = F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")
        blank = (trimmed == "").alias("blank")
        truncated = (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")
        # Every turn that may stay, once: its first occurrence.
        self.texts = materialise(
            rows.filter(trimmed != "").groupBy("conv", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
            .select("conv", "role", "text", digest, F.col("first.turn").alias("turn")),
            "texts",
        )
        facts = rows.select("conv", "turn", "role", digest, blank, truncated)
        folded = facts.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
        firsts = self.texts.select("conv", "role", "digest", "turn")
        known = folded.join(firsts, _same(folded, firsts, "conv", "role", "digest"), "left").select(
            *[folded[c] for c in folded.columns], folded["turn"].eqNullSafe(firsts["turn"]).alias("is_first"))
        initial = F.substring("role", 1, 1)
        code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        forced = F.col("blank") | ~F.col("is_first")
        symbol = code + F.when(forced, _FORCED).otherwise(F.when(F.col("truncated"), _TRUNCATED).otherwise(0))
        self.turns = materialise(
            known.withColumn("symbol", symbol.cast("int")).select("conv", "turn", "role", "digest", "symbol", "n", "blank", "is_first", "truncated"),
            "turns",
        )
        self.conv = self.turns.schema["conv"].dataType.simpleString()
        kinds = f"conv {self.conv}, turn {self.turns.schema['turn'].dataType.simpleString()}, role string, digest binary, part int, seq bigint"
        order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest")]
        placed = self.turns.repartitionByRange(*order).sortWithinPartitions(*order)
        self.blocks = materialise(
            placed.select("conv", "turn", "role", "digest", "symbol", "n").mapInArrow(
                lambda it: _block_rows(it, block), f"{kinds}, symbols binary, costs array<bigint>"),
            "blocks",
        )
        by_conversation = self.blocks.repartition("conv")
        solved = by_conversation.sortWithinPartitions("conv", F.desc("part"), F.desc("seq")).mapInArrow(
            _solved, f"{kinds}, symbols binary, cost bigint, audits array<binary>, moves array<binary>, exits array<int>")
        self.plan = materialise(
            solved.sortWithinPartitions("conv", "part", "seq").mapInArrow(
                _chosen, f"{kinds}, cost bigint, audit string, moved string, illegal bigint"),
            "plan",
        )

    def _stream(self, rows_of: Callable, schema: str) -> DataFrame:
        """Edits and texts of each conversation side by side. A conversation's turns pass one task, in order, but are not held."""
        columns = ["conv", "turn", "role", "digest", "kind", "part", "seq", "moved", "text"]
        edits = self.plan.filter("moved <> ''").withColumn("kind", F.lit(0)).withColumn("text", F.lit(None).cast("string"))
        texts = self.texts.select(
            "*", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("moved"))
        both = edits.select(*columns).unionByName(texts.select(*columns)).repartition("conv")
        ordered = both.sortWithinPartitions("conv", "turn", "role", "digest", "kind", "part", "seq")
        return ordered.select("conv", "role", "kind", "moved", "text").mapInArrow(rows_of, schema)

    def repaired_turns(self) -> DataFrame:
        """``conv``, ``position``, ``role``, ``text``, ``edit`` (K, R or I) of the repaired conversations."""
        kind = _arrow_type(self.plan, "conv")
        return self._stream(
            lambda it: _turn_rows(it, kind), f"conv {self.conv}, position bigint, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """``conv`` and the SHA-256 of its repaired ``role:text`` lines; conversations left without turns are missing."""
        kind = _arrow_type(self.plan, "conv")
        return self._stream(lambda it: _digest_rows(it, kind), f"conv {self.conv}, sha256 string")

    def report(self) -> DataFrame:
        """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``."""
        number = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
        span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
        fresh = F.col("is_first").cast("bigint")
        counts = self.turns.groupBy("conv").agg(
            span.alias("gaps"), number(F.when(F.col("blank"), F.col("n"))).alias("blank"),
            number(F.when(~F.col("blank"), F.col("n") - fresh)).alias("duplicate"),
            number(F.when(~F.col("blank") & F.col("truncated"), fresh)).alias("truncated"),
        )
        parts = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
        plans = self.plan.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        return counts.join(plans, _same(counts, plans, "conv")).select(counts["*"], "illegal", "cost", "audit")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def structure_report(
    df: DataFrame, conv: str, turn: str, role: str, text: str, originals: DataFrame, block: int = BLOCK
) -> DataFrame:
    """The report of every conversation of ``originals`` with the digest of its repaired turns.

    One without turns in ``df`` has zeros, an empty audit and the digest of nothing.
    """
    repair = Repair(df, conv, turn, role, text, block)
    ids = originals.select(F.col(conv).alias("conv")).distinct()
    report, digests = repair.report(), repair.digests()
    rows = ids.join(report, _same(ids, report, "conv"), "left").drop(report["conv"])
    rows = rows.join(digests, _same(rows, digests, "conv"), "left").drop(digests["conv"])
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(
        F.col("conv").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
