"""Every stage of the pipeline against a brute-force version on its own input."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_decontamination import brute as brute_items
from test_packing import check, plain
from test_simhash import brute_components
from test_substring import brute as brute_windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found, columns = [docs.collect()], docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == columns
        path = str(tmp_path_factory.mktemp("stages") / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    return found


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_the_order_of_the_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert cp.ORACLE_SQL is None


def test_quality(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    wrong = [i for i, q in labels.items() if (i in after) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)


def test_near_duplicates(stages):
    """The least id of every component of all pairs whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    before, after = texts(stages[1]), texts(stages[2])
    sets = {}
    for i, t in before.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    first = brute_components(sorted(before), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert after == {i: t for i, t in before.items() if first[i] == i}
    assert len(after) < len(before)


def test_substrings(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = {i: kept if gone else before[i] for i, _, gone, kept in brute_windows(list(before.items()), 50)}
    assert after == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_benchmark(stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    found = {i for i, _ in brute_items(list(before.items()), items)}
    assert found and after == {i: t for i, t in before.items() if i not in found}


def test_packing(stages):
    before = texts(stages[4])
    assert check(stages[5], {i: len(plain(t)) + 1 for i, t in before.items()}) < 0.02


def test_odd_rows_pass_all_stages(spark, tmp_path):
    row = lambda i, t: (i, t, "en", "src", len(t) if t else 0, "k", 1, "fp")
    long = " ".join(f"w{j % 701}y{j % 11}" for j in range(30_000))
    rows = [row(1, "some plain words here"), row(1, "some plain words here"), row(2, None), row(3, ""), row(None, "lost words"),
            row(None, None), row(4, long), row(5, long + " end")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, n int, fingerprint string"
    docs = spark.createDataFrame(rows, schema)
    for name, data in (("labels", ("doc_id bigint, quality int, toxic int", [(1, 1, 0), (None, 1, 0)])),
                       ("benchmark", ("item_id bigint, text string", [(1, "x"), (2, None)]))):
        spark.createDataFrame(data[1], data[0]).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        empty = stage(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert empty.count() == 0
        if name == "near_duplicates":
            kept = [r["doc_id"] for r in docs.collect()]
            # Null and empty texts are one document, the long ones are similar, null ids stay.
            assert sorted(kept, key=str) == [1, 2, 4, None, None]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids == {1, 2, 4, None}
    assert docs.agg(F.sum("length")).first()[0] > 30_000


def test_the_last_stage_keeps_the_token_ids(spark):
    texts = {1: "some plain words here", 2: "other words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in cp.packing_stage(spark, docs, FOLDER).collect():
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and ids[:-1] == plain(texts[r["doc_id"]]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
