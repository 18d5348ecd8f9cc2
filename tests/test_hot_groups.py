"""Spread-out ranking and scans against the plain definition, on a heavily skewed group."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailrisk.operators import accounts as ac
from mailrisk.operators import corpus as cp
from mailrisk.operators import hot_groups as hg


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    data = []
    for i in range(1500):
        g = "hot" if i % 3 else f"g{rng.randrange(40)}"
        data.append((i, g, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randrange(600)), round(rng.random() * 100, 2), f"t{rng.randrange(300)}"))
    return pd.DataFrame(data, columns=["row_id", "g", "at", "v", "text"])


def test_slots_equal_row_number(spark, rows):
    df = spark.createDataFrame(rows).withColumn("k", hg.hash_key("s", F.col("text")))
    targets = lambda n: [F.floor(n * 0.3), F.lit(0), n]
    got = hg.slot_by_rank(df, ["g"], "k", "row_id", targets, 3, bucket_hex=1).select("row_id", "g", "k", "slot").toPandas()
    got = got.sort_values(["g", "k", "row_id"])
    got["rank"] = got.groupby("g").cumcount() + 1
    size = got.groupby("g")["rank"].transform("max")
    want = (got["rank"] > (size * 3 // 10)).astype(int) + 1
    assert (got["slot"] == want).all()


def test_numbering_and_look_backs(spark, rows):
    df = spark.createDataFrame(rows)
    hour = F.date_trunc("hour", F.col("at"))
    order = ["at", "row_id"]
    n = hg.sliced_row_number(df, ["g"], hour, order, "n")
    n = hg.previous_value(n, ["g"], hour, order, "v", "before")
    n = hg.running_max_before(n, ["g"], hour, order, "v", "peak")
    n = hg.trailing_mean(n, ["g"], hour, order, "v", 10, "mean", block=20)
    got = n.toPandas().sort_values(["g", "at", "row_id"]).reset_index(drop=True)
    by = got.groupby("g")
    assert len(got) == len(rows)
    assert (got["n"] == by.cumcount() + 1).all()
    pd.testing.assert_series_equal(got["before"], by["v"].shift(1), check_names=False)
    pd.testing.assert_series_equal(got["peak"], by["v"].transform(lambda s: s.shift(1).cummax()), check_names=False)
    want = by["v"].transform(lambda s: s.rolling(10, min_periods=1).mean())
    assert (got["mean"] - want).abs().max() < 1e-9


def test_salted_numbering_covers_each_group_once(spark, rows):
    got = hg.salted_row_number(spark.createDataFrame(rows), ["g"], "row_id", "n", 1).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["n"]) == list(range(1, len(part) + 1))


def test_salted_join_keeps_every_row(spark, rows):
    big = spark.createDataFrame(rows)
    small = spark.createDataFrame([("hot", 1)], "g string, x int")
    got = hg.salted_left_join(big, small, ["g"], "row_id", 4).toPandas()
    assert len(got) == len(rows) and got["x"].notna().sum() == (rows["g"] == "hot").sum()


def test_weighted_risk_equals_one_by_one(spark, rows):
    frame = rows.assign(user_id=rows["g"].map(lambda g: 0 if g == "hot" else int(g[1:]) + 1))
    df = spark.createDataFrame(frame).selectExpr("user_id", "row_id AS email_id", "at AS scanned_at", "v AS risk_score")
    got = {r.user_id: r.weighted_risk for r in ac.weighted_user_risk(df.repartition(7)).collect()}
    for user, part in frame.sort_values(["at", "row_id"]).groupby("user_id"):
        state = 0
        for v in part["v"]:
            state = int(state * 0.8 + v * 0.2 + 0.5)
        assert got[user] == state


def test_split_and_samples_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows.assign(label=(rows["row_id"] % 3 == 0).astype(int), text=rows["text"] + rows["row_id"].astype(str)))
    seen = []
    for parts, shuffle in ((1, "3"), (6, "9")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        split = cp.stratified_split(df.repartition(parts)).select("row_id", "split").toPandas()
        sample = cp.exact_sample(df.repartition(parts), 77).select("row_id").toPandas()
        seen.append((split.sort_values("row_id").values.tolist(), sorted(sample["row_id"])))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0][1]) == 77


def test_balance_caps_single_class_sources_exactly(spark):
    data = [(i, f"text {i}", int(i % 2), "mixed", 0) for i in range(400)]
    data += [(1000 + i, f"legit {i}", 0, "only_legit", 1) for i in range(900)]
    data += [(3000 + i, f"phish {i}", 1, "only_phish", 2) for i in range(30)]
    df = spark.createDataFrame(data, "row_id long, text string, label int, source string, source_rank int")
    kept = {r.source: r["count"] for r in cp.balance_sources(df).groupBy("source").count().collect()}
    assert kept == {"mixed": 400, "only_legit": 100, "only_phish": 30}
    assert cp.balance_sources(df, 1.0).count() == len(data)


def test_dedup_keeps_the_first_row_of_a_hot_text(spark):
    data = [(i, "same old text here", i % 2, f"s{i % 5}", i % 5) for i in range(500)] + [(900, "another long text", 1, "s0", 0), (901, "short", 1, "s0", 0)]
    df = spark.createDataFrame(data, "row_id long, text string, label int, source string, source_rank int")
    got = sorted((r.row_id, r.text) for r in cp.dedup_text(df.repartition(5)).collect())
    assert got == [(0, "same old text here"), (900, "another long text")]


def test_copies_at_a_cut_are_counted_exactly(spark):
    rows = [(i, "a", "same text") for i in range(1, 101)] + [(1000 + i, "a", f"t{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "n int, label string, text string").repartition(3)
    df = df.withColumn("row_id", F.xxhash64("text"))
    for wanted in (1, 10, 50, 104, 105, 200):
        assert cp.exact_sample(df, wanted).count() == min(wanted, 105)
    split = cp.stratified_split(df)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 73, "val": 16, "test": 16}
    assert split.select("n").distinct().count() == 105
