import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from frames import empty, odd
from mailrisk.llm import quality, queries, toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    _, inverse, counts = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks[order] = ((2 * ends - counts + 1) / 2)[inverse]
    pos = np.asarray(label) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# Toxic rows are few: at 0.01 only 18 are held out, too few to tell a good model from a fair one.
@pytest.mark.parametrize("name, label, modulus, remainder, least, folder", [
    ("op1_toxicity", "toxic", 3, 1, 0.93, "/root/testdata/sf0.1"), ("op6_quality", "quality", 5, 0, 0.97, "/root/testdata/sf0.01"),
])
def test_queries_rank_held_out_rows(spark, name, label, modulus, remainder, least, folder):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    cut = 0.7 if label == "toxic" else 0.3
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
    held = [i for i in labels if rows[i]["held_out"]]
    assert auc([rows[i]["score"] for i in held], [labels[i] for i in held]) > least
    called = [labels[i] for i in held if rows[i]["predicted"] == 1]
    assert np.mean(called) > 0.85 and sum(called) > 0.8 * sum(labels[i] for i in held)


def labelled(spark, n=240):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(20, 200))
        if i % 4 == 0:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["vile", "rotten", "fool"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    schema = "doc_id bigint, text string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(marks, "doc_id bigint, y int")


def test_toxic_words_decide_and_shared_ones_do_not(spark):
    documents, marks = labelled(spark)
    model = toxicity.fit(documents, "doc_id", "text", marks, "y")
    new = [(1, "w1 w2 w3 you fool w4"), (2, "w1 w2 w3 w4 w5 w6"), (3, "unseen words say nothing"), (4, ""), (5, None)]
    df = spark.createDataFrame(new, "doc_id int, text string")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(model, df, "doc_id", "text", 0.7).collect()}
    assert rows[1]["predicted"] == 1 and [rows[i]["predicted"] for i in (2, 3, 4, 5)] == [0] * 4
    assert rows[4]["score"] == rows[5]["score"]
    assert len(toxicity.score_documents(model, odd(spark), "doc_id", "text", 0.7).collect()) == 13


def test_without_both_classes(spark):
    documents, marks = labelled(spark, 20)
    none = toxicity.fit(documents, "doc_id", "text", marks.filter("y = 0"), "y")
    assert {r["score"] for r in toxicity.score_documents(none, documents, "doc_id", "text", 0.7).collect()} == {0.0}
    assert toxicity.score_documents(none, empty(spark), "doc_id", "text", 0.7).count() == 0
    odd_marks = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id int, y int")
    assert toxicity.fit(odd(spark), "doc_id", "text", odd_marks, "y").models is None
    assert quality.fit(odd(spark), "doc_id", "text", odd_marks, "y") is None
    assert {r["predicted"] for r in quality.score_documents(None, odd(spark), "doc_id", "text", 0.3).collect()} == {1}


def test_pairs_order_documents(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5))
    y = (x @ [2.0, -1.0, 0, 0, 0] + draw.normal(size=400) * 0.3 > 0).astype(int)
    model = quality.learn(x[:300], y[:300])
    assert auc(model.strength(x[300:]), y[300:]) > 0.95
    accepted = model.chance(x[300:], 0.3) >= 0.3
    assert np.mean(accepted == y[300:]) > 0.85
    assert np.array_equal(accepted, model.strength(x[300:]) >= model.cut)


def test_quality_of_odd_rows(spark):
    marks = spark.createDataFrame([(1, 1), (4, 1), (9, 1), (10, 0), (6, 0), (5, 1)], "doc_id int, y int")
    model = quality.fit(odd(spark), "doc_id", "text", marks, "y")
    rows = quality.score_documents(model, odd(spark), "doc_id", "text", 0.3).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert quality.score_documents(model, empty(spark), "doc_id", "text", 0.3).count() == 0


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    documents, marks = labelled(spark)
    new = spark.createDataFrame([(i, f"w{i} w{i + 1} {'fool' if i % 2 else 'w7'} w{i + 2}") for i in range(60)], "doc_id int, text string")
    scores = []
    for hot in (toxicity.HOT, 8, 0):
        monkeypatch.setattr(toxicity, "HOT", hot)
        model = toxicity.fit(documents, "doc_id", "text", marks, "y")
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score_documents(model, new, "doc_id", "text", 0.7).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-9) and scores[0] == pytest.approx(scores[2], abs=1e-9)
    assert min(scores[0][i] for i in range(1, 60, 2)) > max(scores[0][i] for i in range(0, 60, 2))


def plain_model(texts, marks):
    """Counts, discounts, ratios and calibration of a small corpus in plain Python."""
    sets = {i: set(w.decode() for w in toxicity.plain_words(t)) for i, t in texts.items()}
    count = {y: Counter(w for i in marks if marks[i] == y for w in sets[i]) for y in (0, 1)}
    vocabulary = set(count[0]) | set(count[1])
    shared = Counter(w for s in sets.values() for w in s if w in vocabulary)
    discounts = [toxicity.modified_discounts([sum(c == i for c in count[y].values()) for i in (1, 2, 3, 4)]) for y in (0, 1)]

    def left(c, y, scale):
        return max(c - scale * discounts[y][min(c, 3) - 1], 0.0) if c > 0 else 0.0

    sums = {(s, y): sum(left(c, y, s) for c in count[y].values()) for s in toxicity.SCALES for y in (0, 1)}

    def ratio(word, scale, without=None):
        back = max(1 - sums[scale, y] / sum(count[y].values()) for y in (0, 1))
        base = (shared[word] + 0.5) / (sum(shared.values()) + 0.5 * len(vocabulary))
        p = [(1 - back) * left(count[y][word] - (without == y), y, scale) / max(sums[scale, y], 1e-9) + back * base for y in (0, 1)]
        return float(np.float16(math.log(p[1] / p[0]))) if word in vocabulary else 0.0

    def features(text, scale, without=None):
        r = [ratio(w.decode(), scale, without) for w in toxicity.plain_words(text)]
        if not r:
            return [0.0] * 7
        passages = [max(sum(r[i:i + min(n, len(r))]) for i in range(len(r) - min(n, len(r)) + 1)) / n for n in (1, 4, 16)]
        best = sorted(r, reverse=True)
        return [sum(r) / len(r), *passages, *[sum(best[:n]) / n for n in (2, 4, 8)]]

    return features


def test_scores_equal_plain_ones(spark):
    documents, marks = labelled(spark, 40)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    known = {r["doc_id"]: r["y"] for r in marks.collect() if r["doc_id"] % 5 != 2}
    features = plain_model(texts, known)
    y = np.array([known[i] for i in sorted(known)], dtype=float)
    fits = []
    for scale in toxicity.SCALES:
        x = np.array([features(texts[i], scale, known[i]) for i in sorted(known)])
        weights = toxicity.fit_logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35)))
        fits.append((-np.mean(np.log(np.where(y == 1, p, 1 - p))), scale, weights))
    model = toxicity.fit(documents, "doc_id", "text", marks.filter("doc_id % 5 <> 2"), "y")
    loss, scale, weights = min(fits, key=lambda f: f[0])
    assert model.scale == scale
    got = toxicity.score_documents(model, documents, "doc_id", "text", 0.7).collect()
    assert len(got) == 40
    for r in got:
        want = 1 / (1 + math.exp(-float(np.clip(np.dot(features(texts[r["doc_id"]], scale), weights[:-1]) + weights[-1], -35, 35))))
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["predicted"] == (r["score"] >= 0.7)


def test_shares_of_each_class_sum_to_one(spark):
    documents, marks = labelled(spark, 80)
    known = documents.join(marks, "doc_id").selectExpr("text AS x", "y")
    models = toxicity.Models.of(toxicity.word_counts(documents.selectExpr("text AS x"), known).cache())
    holding = Counter(w for r in documents.collect() for w in set(toxicity.plain_words(r["text"])))
    names = {int(h.view(np.int64)): w for w in holding for h in toxicity.hash_words([w])}
    rows = models.words.collect()
    assert {names[r["key"]]: r["n"] for r in rows} == holding and all(r["c0"] + r["c1"] == r["n"] for r in rows)
    for s in toxicity.SCALES:
        sums = models.words.agg(*[toxicity.F.sum(models.share(y, s)) for y in (0, 1)]).first()
        assert list(sums) == pytest.approx([1, 1])
    models.words.unpersist()


def test_discounts_come_from_counts_of_counts():
    one, two, more = toxicity.modified_discounts([100, 40, 20, 12])
    share = 100 / 180
    assert (one, two, more) == pytest.approx((1 - 2 * share * 0.4, 2 - 3 * share * 0.5, 3 - 4 * share * 0.6))
    assert toxicity.modified_discounts([None, 0, 0, 9]) == pytest.approx((1 - 2 / 3, 1.0, 0.05))


def test_calibration_reaches_its_least_loss():
    # Whole Newton steps swing to and fro on these rows.
    x = np.array([
        (0.0, 3.7, 1.9, 0.6, 3.6, 3.5, 3.2), (-0.1, 0.9, 0.3, 0.1, 0.9, 0.8, 0.7), (-0.1, 3.7, 1.9, 0.7, 3.7, 3.7, 3.7),
        (-0.1, 1.1, 0.6, 0.2, 1.1, 1.1, 1.0), (-0.1, 0.6, 0.3, 0.1, 0.5, 0.4, 0.3), (0.0, 1.8, 0.4, 0.1, 1.4, 0.9, 0.5),
        (0.1, 3.7, 2.0, 0.5, 3.7, 3.6, 3.5), (0.1, 0.4, 0.4, 0.3, 0.4, 0.4, 0.4), (-0.1, 0.4, 0.1, 0.0, 0.3, 0.3, 0.3),
        (-0.1, 3.0, 0.9, 0.3, 2.7, 2.0, 1.6), (-0.1, 1.5, 0.6, 0.2, 1.4, 1.3, 1.1),
    ])
    y = np.array([0.0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0])
    weights = toxicity.fit_logistic(x, y)
    assert toxicity.log_loss(x, y, weights) < 0.06
    assert np.array_equal(x @ weights[:-1] + weights[-1] > 0, y == 1)


def test_rare_words_are_joined_in_proportion(spark, monkeypatch):
    # The same shares of words among five times the documents: as many common words, and rare ones five times as often.
    monkeypatch.setattr(toxicity, "COMMON", 100)
    sent = []
    for times in (1, 5):
        rows = [(k, times * (1 + k % 20), 1.0) for k in range(1, 401)]
        table = spark.createDataFrame(rows, "key bigint, n bigint, r double")
        held, cold = toxicity._held(table, ["r"], 1000 * times)
        sent.append((len(held.value[0]), sum(rows[r["key"] - 1][1] for r in cold.collect())))
    assert sent[0][0] == sent[1][0] == 220 and sent[0][1] > 0
    assert sent[1][1] == 5 * sent[0][1]
