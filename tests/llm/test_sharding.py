from collections import Counter, defaultdict
from math import log

import xxhash
import zlib

from frames import empty, odd
from mailrisk.llm import sharding


def draw(name, key, weight):
    h = xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(name.encode(), 42)) if key is not None else \
        xxhash.xxh64_intdigest(name.encode(), 42)
    return -log(((h >> 11) + 0.5) / 2**53) / weight


def place(key, leaves, path="", levels=("region", "rack", "shard")):
    groups = defaultdict(list)
    for leaf in leaves:
        groups[str(getattr(leaf, levels[0]))].append(leaf)
    name = min(groups, key=lambda n: draw(f"{path}/{n}", key, sum(x.weight for x in groups[n]))) if len(groups) > 1 else next(iter(groups))
    return groups[name][0].shard if len(levels) == 1 else place(key, groups[name], f"{path}/{name}", levels[1:])


def test_places_equal_brute_force_and_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    tree = sharding.even_tree(16)
    rows = sharding.shard_rows(df, "doc_id", "text", tree).collect()
    for r in rows[::7]:
        assert r["shard"] == place(str(r["doc_id"]), tree)
        assert r["grown_shard"] == place(str(r["doc_id"]), sharding.grow(tree))
        assert r["text_crc32"] == zlib.crc32(str(r["doc_id"]).encode())
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * min(sizes.values())
    assert 100 < sum(r["grown_shard"] == 16 for r in rows) < 260


def test_weight_of_a_rack_moves_rows_of_its_subtree_only(spark):
    tree = sharding.even_tree(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in tree]
    for i in range(2000):
        a, b = place(str(i), tree), place(str(i), heavier)
        assert a == b or (tree[b].region == "region1")


def test_slots_are_gapless_and_every_row_is_kept(spark):
    rows = sharding.shard_rows(odd(spark), "doc_id", "text", sharding.even_tree(4), buckets=3).collect()
    assert len(rows) == 13
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["size"] == 1 and by_id[3]["text_crc32"] == 0 and by_id[2]["size"] == 1
    assert sharding.shard_rows(empty(spark), "doc_id", "text", sharding.even_tree(4)).count() == 0
