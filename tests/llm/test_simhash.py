import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from frames import empty, odd
from mailrisk.llm import queries, simhash
from mailrisk.llm.components import components


def brute_print(text, width=4):
    words = [] if text is None else text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {n: root(n) for n in nodes}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_simhash"](spark, folder).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == prints
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in rows.items()} == want


@pytest.mark.parametrize("blocks, bucket", [(6, 128), (7, 128), (7, 3), (8, 2)])
def test_links_give_the_components_of_all_close_pairs(spark, blocks, bucket):
    draw = random.Random(blocks * 100 + bucket)
    prints = set()
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            prints.add(x)
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = simhash.links(df, "fp", 4, blocks, bucket)
    got = {p: p for p in signed} | {r["node"]: r["label"] for r in components(found, "a", "b").collect()}
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in found.collect())


def test_exploded_rows_are_never_broadcast(spark, monkeypatch):
    """Spark sees only the size before the explosion; beyond some size the driver could not hold what it then collects."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    df = spark.createDataFrame([(1 << i,) for i in range(60)], "fp bigint")
    found = simhash.links(write(df, "few"), "fp", 4, 6, 3)
    plans.append(plan(found))
    assert sum("Generate explode" in p or "Generate posexplode" in p for p in plans) >= 3
    assert not any("BroadcastExchange" in p for p in plans)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(5, 5), (None, 3), (9, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark), "doc_id", "text").collect()
    assert len(rows) == 13
    of = lambda i: {(r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] == i}
    assert of(1) == of(5) and of(2) == of(3) == of(7) == {(0, 2)} and len(of(6)) == 1
    assert simhash.near_duplicates(empty(spark), "doc_id", "text").count() == 0
    similar = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(odd(spark), "doc_id", "text").collect()}
    assert similar == {1: 1, 5: 1, 2: 2, 3: 2, 7: 2, 4: 4, 9: 4, 6: 6, 8: 8, 10: 10}
    assert simhash.similar_documents(empty(spark), "doc_id", "text").count() == 0


@pytest.mark.parametrize("bucket", [64, 3])
def test_similar_documents_finds_edited_copies(spark, bucket):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, groups = [], []
    for g in range(8):
        base = draw.choices(words, k=300)
        members = []
        for _ in range(1 + g):
            copy = list(base)
            for at in draw.sample(range(300), 4):  # 20 of 296 shingles: similarity about 0.87
                copy[at] = draw.choice(words)
            members.append(len(rows))
            rows.append((len(rows), " ".join(copy if members[1:] else base)))
        groups.append(members)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, "doc_id", "text", pair_bucket=bucket).collect()}
    assert got == {m: members[0] for members in groups for m in members}
    far = simhash.wide_votes(np.arange(1, 500, dtype=np.uint64)) != simhash.wide_votes(np.arange(500, 999, dtype=np.uint64))
    assert far.sum() > 2 * simhash.most_bits(0.8)


def five_word_sets(rows):
    return [{tuple(r[i:i + 5]) for i in range(len(r) - 4)} for r in rows]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_documents_equals_true_jaccard(spark):
    draw = random.Random(11)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(40):  # just above and below 0.8: replaced, appended and cut passages, scattered words
        base = new(400)
        for n in (38, 46):
            at = draw.randrange(300)
            rows += [base, base[:at] + new(n) + base[at + n:]]
            base = new(400)
        for n in (92, 108):
            rows += [base, base + new(n)]
            base = new(400)
        for n in (322, 308):
            rows += [base, base[:n]]
            base = new(400)
    texts = [" ".join(r) for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, "doc_id", "text").collect()}
    sets = five_word_sets(rows)
    want = {j: i if jaccard(sets[i], sets[j]) >= 0.8 else j for i in range(0, len(texts), 2) for j in (i, i + 1)}
    assert got == want and 100 < sum(i != j for i, j in want.items()) < 140


def test_similar_documents_that_keys_and_fingerprints_miss_are_found(spark, monkeypatch):
    draw = random.Random(13)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    shared, rows = new(60), []
    for n in (0, 5, 12, 38, 46, 3, 20, 50):
        base = shared + new(240)
        rows += [base, base[:100] + new(n) + base[100 + n:], shared]
    texts = [" ".join(r) for r in rows]
    sets = five_word_sets(rows)
    monkeypatch.setattr(simhash, "most_bits", lambda *_: -1)  # the fingerprints rule out every pair
    monkeypatch.setattr(simhash, "links", lambda prints, column: prints.selectExpr("fp AS a", "fp AS b").limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, "doc_id", "text").collect()}
    assert got == brute_components(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert sum(i != j for i, j in got.items()) > 10


def test_crowds_whose_original_is_not_the_least(spark):
    draw = random.Random(12)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base, boilerplate = new(300), new(300)
    rows = []
    for _ in range(160):  # similar to the original, not to each other
        copy = list(base)
        for at in draw.sample(range(300), 6):
            copy[at] = new(1)[0]
        rows.append(copy)
    for _ in range(60):  # pairs on shared words
        own = new(84)
        rows += [boilerplate + own, boilerplate + own[:80] + new(4)]
    draw.shuffle(rows)
    rows.append(base)
    texts, sets = [" ".join(r) for r in rows], five_word_sets(rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    for bucket in (64, 4):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, "doc_id", "text", pair_bucket=bucket).collect()}
        assert got == want
