"""Small frames with everything a table may hold."""

SCHEMA = "doc_id bigint, text string, k string, score int, fingerprint int, size int, host string, n int, x string, t int"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta"), (2, ""), (3, None), (None, "no id here at all friend"),
    (None, None), (4, LONG), (5, "Alpha beta gamma delta epsilon zeta"), (6, "one"), (6, "one"), (7, "\n \t "),
    (8, "nul\0 and  odd space é"), (9, LONG + " tail"), (10, "tie tie tie tie tie tie"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "h", 4, "x", 5) for i, t in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
