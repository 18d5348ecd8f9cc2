import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from mailrisk.llm.prefix_trie import rebuilt_trie, trie_nodes

SCHEMA = "conv_id long, turn long, role string, text string, n int, depth int, h string, parent int, size int, chain string"


def trie(lists):
    """All nodes of a dict of conversations by dictionaries of members."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((
        min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
    ) for node, own in ((n, members[n]) for n in members)) if members else []


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((r or "", x or ""))
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "h", 3, 4, "c") for r in rows], SCHEMA)


def made(seed, conversations, longest):
    random.seed(seed)
    rows = []
    for c in random.sample(range(3 * conversations), conversations):
        for t in range(random.randint(1, longest)):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, random.choice(["user", "assistant", None]), random.choice(["a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_equals_brute_force(spark, block):
    rows = made(2, 150, 14) + [(None, 0, "user", "x"), (901, 0, "user", "y" * 300_000)]
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(9)]
    rows += [(2000, t % 2, "user", "again") for t in range(40)]
    result = rebuilt_trie(frame(spark, rows), "conv_id", "turn", "role", "text", block)
    assert rows_of(result) == ordered(trie(rebuilt(rows)))


def test_negative_numbers_and_turnless(spark):
    lists = {-7: [], 3: [("u", "a")], 4: [], 5: [("u", "a"), ("a", "b")]}
    convs = spark.createDataFrame([(c, len(t)) for c, t in lists.items()], "conv long, length long")
    turns = spark.createDataFrame(
        [(c, i, hash(t) % 1000, 5, len(t[1])) for c, ts in lists.items() for i, t in enumerate(ts)],
        "conv long, pos long, h long, g long, size long")
    assert rows_of(trie_nodes(convs, turns)) == ordered(trie(lists))
    assert rebuilt_trie(frame(spark, []), "conv_id", "turn", "role", "text").count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_many_chunks(spark, block):
    """Small chunks, so that most paths are peeled again."""
    random.seed(6)
    lists = {c: [(random.choice("ua"), random.choice("abc")) for _ in range(random.randint(0, 9))] for c in range(400)}
    lists |= {c: [("u", "a")] * random.randint(0, 30) for c in range(500, 560)}
    convs = spark.createDataFrame([(c, len(t)) for c, t in lists.items()], "conv long, length long")
    turns = spark.createDataFrame(
        [(c, i, "ua".index(r) * 10 + "abc".index(x), 5, len(x)) for c, ts in lists.items() for i, (r, x) in enumerate(ts)],
        "conv long, pos long, h long, g long, size long")
    assert rows_of(trie_nodes(convs, turns, block, chunk=40)) == ordered(trie(lists))
