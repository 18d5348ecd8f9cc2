import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from frames import ROWS, empty, odd
from mailrisk.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def plain(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def check(pieces, counts):
    """Every id of every document in one piece, sequences gapless and at most 1024 long; share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(counts)
    for i, parts in by_doc.items():
        end = 0
        for start, length, total in sorted(parts):
            assert start == end and length > 0 and total == counts[i]
            end += length
        assert end == counts[i]
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    return padding / sum(counts.values())


def test_encoder_equals_the_tokenizer(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(" \n\t\x1c ab1'.é\0sI") for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "don't  stop 's", "a  b", "\n\na", " x "]
    encoder = packing.Encoder(PATH)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == plain(t), t
    for t in ["Wait, is it? it, it.", "don't. don't, a.b. é, é. x1. x, (a). a).", "one\ntwo, three.\nfour", "a", ""]:
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == plain(t), t


def test_encoder_forgets_and_stays_right(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    encoder = packing.Encoder(PATH)
    text = " ".join(f"word{i % 90}" for i in range(300))
    for t in (text, text[::-1], text):
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == plain(t)


def test_query_packs_every_id_with_little_padding(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    ids = {i: plain(t) + [0] for i, t in texts.items()}
    pieces = queries.QUERIES["op7_packing"](spark, folder).collect()
    assert check(pieces, {i: len(x) for i, x in ids.items()}) < 0.01
    for p in pieces:
        part = np.array(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p["step_group"]] += p["length"]
    assert max(tokens.values()) <= packing.STEP_WINDOWS * 1024


def test_tiers_are_filled_and_leave_less_than_a_window(spark):
    draw = random.Random(2)
    pieces = [packing._Piece(i, np.zeros(n, "<u4"), 0, n) for i, n in enumerate(draw.randint(1, 3000) for _ in range(400))]
    total = sum(p.length for p in pieces)
    windows, left = packing.pack(pieces, packing.TIERS)
    assert all(sum(p.length for p in w) == tier for tier, w in windows)
    assert {tier for tier, _ in windows} == {1024, 512}  # all short pieces fill gaps
    short = [packing._Piece(i, np.zeros(90, "<u4"), 0, 90) for i in range(50)]
    assert {tier for tier, _ in packing.pack(short, packing.TIERS)[0]} == {256}
    rest = sum(p.length for p in left)
    assert rest < 1024 + 512 + 256 and sum(t for t, _ in windows) + rest == total


def test_odd_rows(spark):
    pieces = packing.pack_documents(odd(spark).coalesce(1), "doc_id", "text", PATH).collect()
    rows = [dict(p.asDict(), doc_id=p["doc_id"]) for p in pieces]
    assert sum(p["length"] for p in rows) == sum(len(plain(t or "")) + 1 for _, t in ROWS)
    assert sorted(p["length"] for p in rows if p["doc_id"] in (2, 3)) == [1, 1]
    assert packing.pack_documents(empty(spark), "doc_id", "text", PATH).count() == 0


def test_results_leave_a_task_a_few_windows_at_a_time(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(packing, "TaskContext", Task)
    texts = [f"some w{i} words " * 400 for i in range(400)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["key", "text"])
    out = list(packing._pack_partition(iter([rows]), PATH, packing.TIERS))
    windows = [set(b.column("sequence_id").to_pylist()) for b in out]
    assert len(out) > 1 and max(map(len, windows)) <= 256
    assert sorted(i for w in windows for i in w) == list(range(sum(map(len, windows))))
    assert sum(sum(b.column("length").to_pylist()) for b in out) == sum(len(plain(t)) + 1 for t in texts)
