import random
import re

from frames import empty, odd
from mailrisk.llm import decontamination as dc


def words(text):
    return [] if text is None else re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())


def shingles(w, width):
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(documents, items, width=5, threshold=0.8):
    out = {}
    for i, text in documents:
        w = words(text)
        for j, item in items:
            v = words(item)
            if v:
                k = min(width, len(v))
                want = shingles(v, k)
                share = len(want & shingles(w, k)) / len(want)
                if share >= threshold:
                    out[i, j] = share
    return out


def test_equals_brute_force_over_all_sizes(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(j, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 4, 5, 6, 9, 17, 40, 90])))) for j in range(40)]
    items += [(90, None), (91, ""), (92, "!!!"), (3, items[3][1])]
    documents = []
    for i in range(80):
        text = draw.choices(vocabulary, k=draw.choice([0, 3, 30, 600]))
        for _ in range(draw.randint(0, 2)):
            piece = words(draw.choice(items[:40])[1])
            for _ in range(draw.randint(0, 1 + len(piece) // 40)):
                piece[draw.randrange(len(piece))] = "changed"
            at = draw.randint(0, len(text))
            text[at:at] = piece
        documents.append((i, ", ".join(text).upper()))
    schema = "id bigint, text string"
    got = dc.contained_items(spark.createDataFrame(documents, schema).repartition(3), "id", "text", spark.createDataFrame(items, schema), "id", "text")
    assert {(r["k"], r["item"]): r["containment"] for r in got.collect()} == brute(documents, items)
    assert all(0 < r["estimate"] <= 1 for r in got.collect())


def test_signatures_hold_a_shingle_of_every_document_over_the_threshold():
    for n in range(1, 400):
        missing = n - -(-8 * n // 10)
        assert missing < dc.signature_size(n, 0.8) <= n


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta"), (2, "one"), (3, None)], "item_id int, text string")
    rows = dc.contamination(odd(spark), "doc_id", "text", items, "item_id", "text").collect()
    assert len(rows) == 13
    found = {(r["doc_id"], tuple(r["item_ids"])) for r in rows if r["contaminated"]}
    assert found == {(1, (1,)), (5, (1,)), (6, (2,))}
    assert not any(r["contaminated"] for r in dc.contamination(odd(spark), "doc_id", "text", items.limit(0), "item_id", "text").collect())
    assert dc.contamination(empty(spark), "doc_id", "text", items, "item_id", "text").count() == 0
    # Rows without an id are one document of their own.
    nameless = spark.createDataFrame([(None, "beta gamma delta"), (None, "beta gamma delta epsilon zeta"), (7, "x")], "doc_id int, text string")
    flags = [r["contaminated"] for r in dc.contamination(nameless, "doc_id", "text", items, "item_id", "text").orderBy("doc_id").collect()]
    assert flags == [True, True, False]
