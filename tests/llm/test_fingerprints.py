import hashlib

import duckdb
from pyspark.sql import functions as F

from frames import empty, odd
from mailrisk.llm import fingerprints as fp
from mailrisk.llm import queries


def test_query_edits_with_the_next_document(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_fingerprints"](spark, folder).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    ids = sorted(texts)
    sets = {i: fp_set(t) for i, t in texts.items()}
    better = 0
    for at, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(at + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
        better += rows[i]["near_edited"] > rows[i]["near_next"]
        a, b = sets[i], fp_set(edited)
        if min(len(a), len(b)) > 400:
            assert abs(rows[i]["near_edited"] - len(a & b) / min(len(a), len(b))) < 0.15
    assert better > 0.9 * len(ids)
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def fp_set(text):
    w = text.encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_sketches_merge_and_estimate_containment(spark):
    big = " ".join(f"a{i}" for i in range(4000))
    small = " ".join(f"a{i}" for i in range(1000, 1600)) + " " + " ".join(f"b{i}" for i in range(600))
    df = spark.createDataFrame([(big, small, big + " " + small)], "a string, b string, c string")
    for c in "abc":
        df = fp.with_sketch(df, F.col(c), f"s{c}")
    r = df.select(
        "*", fp.containment(F.col("sb"), F.col("sa")).alias("in_big"), fp.merged(F.col("sa"), F.col("sb")).alias("m")
    ).first()
    assert abs(r["in_big"] - 0.5) < 0.15
    assert set(r["m"]) <= set(r["sc"]) and len(set(r["sc"]) - set(r["m"])) <= 4  # shingles across the seam
    assert 0.08 < len(r["sa"]) / 3996 < 0.17 and r["sa"] == sorted(set(r["sa"]))


def test_odd_rows(spark):
    rows = fp.edited_neighbours(odd(spark), "doc_id", "text").collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["edited"] == by_id[3]["edited"] == "" and by_id[2]["sketch"] == []
    assert by_id[1]["sketch"] == by_id[5]["sketch"] and len(by_id[6]["sketch"]) == 1
    assert by_id[10]["edited"] == "tie tie tie " [:12] + "Alpha beta gamma"[:11]  # the first follows the last
    assert len(by_id[10]["sketch"]) == 1
    nameless = [r for r in rows if r["doc_id"] is None and r["n_chars"]]
    assert [r["edited"] for r in nameless] == ["no id here a" + "Alpha beta gamma"[:12]]
    assert fp.edited_neighbours(empty(spark), "doc_id", "text").count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id int, text string")
    assert fp.edited_neighbours(one, "doc_id", "text").first()["edited"] == "abcabc"
