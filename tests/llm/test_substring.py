import hashlib
import random

import duckdb
import pytest

from frames import LONG, empty, odd
from mailrisk.llm import queries, substring


def brute(rows, window):
    words = [(i, [] if t is None else t.encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, cells", [(5, None), (20, None), (50, 1 << 16)])
def test_equals_brute_force(spark, window, cells):
    draw = random.Random(window)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [draw.choices(vocabulary, k=draw.randint(window, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = draw.choices(vocabulary, k=draw.randint(0, 4 * window))
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(text))
            text[at:at] = draw.choice(shared)
        rows.append((i if i != 9 else None, " ".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (50, rows[4][1] + " x"), (200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring.remove_repeats(df, "doc_id", "text", window, cells).drop("carried").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows, 50)]
    got = queries.QUERIES["op10_substring_dedup"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = substring.remove_repeats(odd(spark), "doc_id", "text", carry=["score", "k"]).collect()
    assert len(rows) == 13 and {tuple(r["carried"]) for r in rows} == {(1, "k")}
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_removed"] == 0 and by_id[4]["kept"] == LONG
    assert by_id[9]["n_removed"] == 60_000 and by_id[9]["kept"] == "tail"
    assert (by_id[3]["n_words"], by_id[3]["kept"]) == (0, "") and by_id[1]["n_removed"] == by_id[5]["n_removed"] == 0
    assert substring.remove_repeats(empty(spark), "doc_id", "text").count() == 0


def test_texts_that_may_go_meet_one_python_step_at_a_time(spark, monkeypatch):
    """Chained steps run at once: every task would start two workers, and all of them stay and are used in turn."""
    plans = []
    cells = substring._repeated_cells
    monkeypatch.setattr(substring, "_repeated_cells", lambda searched, *rest: (
        plans.append(searched._jdf.queryExecution().toString()), cells(searched, *rest))[1])
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " end")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(df, "doc_id", "text").collect()}
    assert got == {1: 0, 2: 60, 3: 60}
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
