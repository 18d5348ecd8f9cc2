import random
from itertools import combinations

import numpy as np
import pytest

from frames import LONG, empty, odd
from mailrisk.llm import set_links
from mailrisk.llm.set_links import shingle_set
from mailrisk.llm.superminhash import REGISTERS, _offers, near_duplicates, signatures


def brute(rows, width=4, percent=80):
    """Least key of the component of every text, by all pairs."""
    sets = []
    for k, text in rows:
        words = (text or "").encode().lower().split()
        w = min(width, len(words))
        sets.append({b" ".join(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def one_by_one(shingles):
    """The registers by the definition: one shingle after the other, all its steps."""
    out = [2**64 - 1] * REGISTERS
    for s in shingles:
        order = list(range(REGISTERS))
        for step in range(REGISTERS):
            offer, place = _offers(np.array([s], dtype=np.uint64), step)
            order[step], order[place[0]] = order[place[0]], order[step]
            out[order[step]] = min(out[order[step]], int(offer[0]))
    return out


def test_signatures_equal_the_definition():
    random.seed(3)
    sets = [np.unique(np.array([random.getrandbits(64) for _ in range(n)], dtype=np.uint64)) for n in (0, 1, 2, 7, 90, 400)]
    assert [list(map(int, r)) for r in signatures(sets)] == [one_by_one(s) for s in sets]


def test_a_set_over_the_chunk_equals_the_definition(monkeypatch):
    monkeypatch.setattr("mailrisk.llm.superminhash.CHUNK", 50)
    s = shingle_set(" ".join(f"w{i}" for i in range(333)), 4)
    assert list(map(int, signatures([s, s[:40]])[0])) == one_by_one(s)


def test_equal_registers_estimate_similarity_with_less_variance():
    random.seed(5)
    shares = []
    for _ in range(200):
        h = np.array([random.getrandbits(64) for _ in range(50)], dtype=np.uint64)
        a, b = signatures([h[:40], h[10:]])  # similarity 0.6
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.6) < 0.01
    assert np.var(shares) < 0.75 * 0.24 / REGISTERS


def test_odd_rows(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    result = near_duplicates(df, "doc_id", "text")
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(result) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in result.collect())
    assert near_duplicates(empty(spark), "doc_id", "text").count() == 0


def test_string_keys_keep_their_type(spark):
    rows = [("b", LONG), ("a", LONG + " end"), ("c", None)]
    result = found(near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text"))
    assert result == brute(rows)
    assert [r[2] for r in result] == ["a", "a", "c"]


def edited(words, n, seed):
    random.seed(seed)
    words = list(words)
    for i in random.sample(range(len(words)), n):
        words[i] = f"e{seed}x{i}"
    return words


@pytest.mark.parametrize("bucket", [2, 64])
def test_crowds(spark, bucket):
    """Families whose original is not the least, and texts that share a passage of similarity 0.6 to 0.79 in hundreds."""
    base = [f"w{i}" for i in range(300)]
    rows = [(1000 - i, " ".join(edited(base, 1 + i % 14, i))) for i in range(120)] + [(5000, " ".join(base))]
    shared = [f"s{i}" for i in range(200)]
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(14 + i % 30)]
        rows.append((10_000 + i, " ".join(shared + own)))
        if i % 10 == 0:
            rows.append((20_000 + i, " ".join(shared + own + ["last"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, "doc_id", "text", pair_bucket=bucket)) == brute(rows)


def test_prefixes_meet_whatever_the_order(spark):
    random.seed(9)
    rows = [(i, " ".join(random.choices("abcdefgh", k=random.randint(1, 30)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, "doc_id", "text", pair_bucket=1)) == brute(rows)
    assert set_links.least_overlap(5, 80) == 4
