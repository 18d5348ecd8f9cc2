"""Loaders, sender recovery, back-fill, raw messages, profile and diagnostics."""

import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions import senders as sd
from mailrisk.functions import text as tx
from mailrisk.operators import backfill as bf
from mailrisk.operators import corpus as cp
from mailrisk.operators import diagnose as dg
from mailrisk.operators import joint_fits as jf
from mailrisk.sources import labelled as lb
from mailrisk.sources import profile as pf
from mailrisk.sources import raw_mail as rm
from mailrisk.sources import sinks as sk
from mailrisk.sources.quoted_csv import CHUNK_CONF, read_quoted_csv

RAW = {
    "From: Ann <Ann.Lee@B.com>\nTo: you@x.org\nSubject: s\n\nbody": ("ann.lee@b.com", "from"),
    "From bob@c.com Mon Jan 1\nReceived: x\nX-A: y\nDate: z\n\nbody": ("bob@c.com", "mbox"),
    "Return-Path: <r@d.com>\nReceived: x\nTo: you@x.org\n\nbody": ("r@d.com", "return-path"),
    "X-Sender: s@d.com\nReceived: x\nTo: you@x.org\n\nbody": ("s@d.com", "sender"),
    "From: Ann ann@flat.com To: you@x.org Subject: hi there": ("ann@flat.com", "from"),
    "text before From: Ann <ann@flat.com> To: you@x.org": ("ann@flat.com", "flat"),
    "To: you@x.org\nwrite to me": ("", ""),
    "hello, reach me at me@site.com now": ("me@site.com", "bare"),
    "From: owner-list@x.org\nTo: you@x.org\nDate: now\n\nbody": ("", ""),
    "From: mailer-daemon@x.org\nReturn-Path: <real@y.org>\nDate: now\n\nbody": ("real@y.org", "return-path"),
    "no address": ("", ""), "a\nb\nc\nd\ne\nf\ng late@x.org": ("", ""),
    "wr x@y.com+foo@bar.org": ("x@y.com", "bare"), "ünï@exämple.org hello": ("ünï@exämple.org", "bare"),
}


def test_extract_sender(spark):
    df = spark.createDataFrame([(t,) for t in RAW], "text string")
    got = {r.text: (r.extracted, r.extract_method) for r in sd.extract_sender(df, "text").collect()}
    assert got == RAW


def test_clean_address(spark):
    cases = {"a@b": "", "a@b.c": "", "a@@b.com": "", "x" * 65 + "@b.com": "", "(a@b.co.il)": "a@b.co.il"}
    cases[" <A@B.com>, "] = "a@b.com"
    df = spark.createDataFrame([(c,) for c in cases], "a string")
    assert {r.a: r.c for r in df.select("a", sd.clean_address(F.col("a")).alias("c")).collect()} == cases


def test_clean_text(spark):
    link = "http://" + "a" * 100
    raw = f"<p>x</p> \n y  {link} z"
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    got = [r.c for r in df.select(tx.clean_text(F.col("t")).alias("c")).collect()]
    assert got == ["x y http://" + "a" * 80 + " z", ""]
    assert df.select(tx.clean_text(F.col("t"), 3).alias("c")).first().c == "x y"


def test_backfill_is_seeded_by_the_row_and_follows_the_weights(spark):
    rows = [(i, f"mail {i % 900} about {'paypal' if i % 2 else 'nothing'}", i % 3 == 0, "s", "") for i in range(3000)]
    df = spark.createDataFrame([(i, t, int(y), s, e) for i, t, y, s, e in rows], "row_id long, text string, label int, source string, sender string")
    first = bf.generate_senders(bf.extraction_table(df)).orderBy("row_id").collect()
    again = bf.generate_senders(bf.extraction_table(df.repartition(3))).orderBy("row_id").collect()
    # Copies of one text may swap their numbers only if the order of rows mattered; it does not.
    assert first == again
    pools = {}
    for r in first:
        assert r.sender_filled == r.sender_generated and "@" in r.sender_filled
        pools.setdefault((r.label, rows[r.row_id][1].endswith("paypal")), []).append(r.sender_pool)
    assert "lookalike" not in pools[(0, True)] and "lookalike" not in pools[(1, False)]
    assert "brand-official" not in pools[(0, False)]
    share = pools[(0, True)].count("free") / len(pools[(0, True)])
    assert abs(share - 0.34) < 0.06


def test_csv_loaders(spark, tmp_path):
    def write(name, header, *lines):
        path = tmp_path / name
        path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
        return lb.read_csv(spark, str(path))

    def pairs(df):
        return sorted((r.text, r.label) for r in df.collect())

    spelled = write("a.csv", "Email Text,Spam Class", '"one, ""x""\nline",spam', "two,phishing", "three,ham", ",ham")
    assert pairs(lb.mixed_corpus(spelled)) == [('one, "x"\nline', 0), ("three", 0), ("two", 1)]
    assert pairs(lb.mixed_corpus(spelled, None)) == [("three", 0), ("two", 1)]
    odd = write("b.csv", "text,label", "a,spam", "b,7", "c,-2", "d,what", "e,1")
    assert pairs(lb.mixed_corpus(odd)) == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 1)]
    assert pairs(lb.mixed_corpus(write("c.csv", "id,text,label", "1,a,0", "2,b,1"))) == [("a", 0), ("b", 1)]
    archive = write("d.csv", "file,message", *[f"path/{i},{'long body ' * 20}{i}" for i in range(30)])
    assert lb.pick_text_column(archive)[0] == "message"
    assert lb.negative_corpus(archive, 12).count() == 12
    assert pairs(lb.positive_corpus(write("e.csv", "id,url", "1,http://x"))) == [("http://x", 1)]
    spam = write("f.csv", "text,label", "a,1", "b,0")
    assert pairs(lb.spam_corpus(spam)) == [("a", 0), ("b", 0)] and pairs(lb.spam_corpus(spam, None)) == [("b", 0)]
    rich = lb.rich_corpus(write("g.csv", "sender,text,label,extra", "s,a,1,z", ",b,5,z"), "src")
    assert rich.columns == ["sender", "text", "label", "source"]
    stacked = cp.union_sources([rich, lb.plain_corpus(spam)])
    assert sorted((r.sender, r.subject, r.source) for r in stacked.collect()) == [
        ("", "", "src"), ("", "", "unknown"), ("", "", "unknown"), ("s", "", "src"),
    ]


def test_splits_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(200)], "row_id long, text string, label int")
    split = cp.stratified_split(df).drop("slot")
    sk.write_splits(split, str(tmp_path / "out"))
    val = lb.load_split(spark, str(tmp_path / "out"), "val")
    assert {"sender", "subject", "content"} <= set(val.columns) and val.count() == 30
    with pytest.raises(ValueError):
        lb.load_split(spark, str(tmp_path / "out"), "holdout")
    leak = cp.split_leakage(split).first()
    assert (leak.distinct_texts, leak.train_and_val, leak.train_and_test) == (200, 0, 0)


def test_raw_messages(spark, tmp_path):
    folder = tmp_path / "ham"
    folder.mkdir()
    body = "a body that is long enough to be kept, surely"
    (folder / "1").write_bytes(f"Subject: hi\n\n{body}".encode())
    encoded = base64.b64encode(("<b>é " + body + "</b>").encode()).decode()
    (folder / "2").write_bytes(
        b'Subject: two\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: image/png\n\nx\n--b\n'
        b"Content-Type: text/html\nContent-Transfer-Encoding: base64\n\n" + encoded.encode() + b"\n--b--\n"
    )
    (folder / "cmds").write_bytes(f"Subject: hi\n\n{body}".encode())
    (folder / "3").write_bytes(b"Subject: x\n\nshort")
    got = sorted(r.text for r in rm.read_messages(spark, str(tmp_path), 0).collect())
    assert got == [f"hi {body}", f"two <b>é {body}</b>"]


def test_schema_profile(spark):
    prepared = spark.createDataFrame([("archive", "a@b.com"), ("archive", ""), ("mixed", "")], "source string, sender string")
    headers = {"archive_mail": ["file", "From_addr", "message"], "mixed": ["Email Sender", "Title"], "other": ["text"]}
    got = {r.stem: (r.source, r.n_rows, r.n_kept, r.status) for r in pf.schema_profile(spark, headers, prepared).collect()}
    assert got == {"archive_mail": ("archive", 2, 1, "kept"), "mixed": ("mixed", 1, 0, "dropped"), "other": ("", 0, 0, "absent")}


def test_char_terms(spark):
    def padded(word):
        w = f" {word} "
        out = []
        for n in range(2, 6):
            if len(w) < n:
                continue
            out += [w[i:i + n] for i in range(len(w) - n + 1)]
        return out

    df = spark.createDataFrame([("Ab c@d.org",)], "v string")
    got = df.select(dg.char_terms(F.col("v")).alias("t")).first().t
    assert sorted(got) == sorted(padded("ab") + padded("c@d.org"))


def test_audit_sees_a_planted_leak_and_no_ghosts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        y = i % 2
        local = "".join(rng.choice("abcdefgh") for _ in range(6))
        rows.append((i, y, f"{local}@{'bad' if y else 'good'}.com", f"{local}@same.com"))
    df = spark.createDataFrame(rows, "row_id long, label int, leaky string, clean string")
    assert dg.leakage_audit(df, "leaky")["auc"] > 0.95
    assert 0.35 < dg.leakage_audit(df, "clean")["auc"] < 0.65
    assert dg.leakage_audit(df.limit(50), "clean")["note"] == "too few rows"
    assert lx.POOLS["lookalike"][1] == 0.0


def _quoted(value):
    return "" if value is None else '"' + value.replace('"', '""') + '"'


@pytest.mark.parametrize(("end", "sizes"), [("\n", (1500, None)), ("\r\n", (20_000,))])
def test_quoted_csv_in_chunks_equals_one_task(spark, tmp_path, end, sizes):
    rng = random.Random(11)
    bits = ['say ""hi""', "a\nb", "line\r\nbreak", "x,y", "שלום", "", "\n\n", '"', "word " * 9, "long " * 900, "\n".join("abcdefgh") * 60]
    title = "Email\nBody" if len(end) == 1 else "Email Body"
    given = []
    folder = tmp_path / f"csv-{len(end)}"
    folder.mkdir()
    for name in ("a", "b", "c"):  # c holds a header only, and no last line end
        rows = [(str(i), *(rng.choice([None, *bits]) for _ in range(2)), "0") for i in range(700 if name != "c" else 0)]
        given += [tuple(v or None for v in r) for r in rows]  # an empty field is null to both readers
        head = ",".join(map(_quoted, ("id", title, "b", "label")))
        lines = [head, *(",".join(map(_quoted, r)) for r in rows)]
        lines[200:200] = [""] * 3
        (folder / f"{name}.csv").write_bytes((end.join(lines) + ("" if name == "c" else end)).encode())
    # With \r\n between records the one-task reader changes line ends inside fields; this one keeps them.
    names = ["id", title, "b", "label"]
    want = lb.read_csv(spark, str(folder)) if end == "\n" else spark.createDataFrame(given, ", ".join(f"`{n}` string" for n in names))
    total = want.count()
    assert total == 1400
    for size in sizes:
        got = read_quoted_csv(spark, str(folder), size)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and got.count() == total
    before = spark.conf.get(CHUNK_CONF)
    spark.conf.set(CHUNK_CONF, str(sizes[0]))
    try:
        assert spark.read.text(str(folder / "a.csv")).rdd.getNumPartitions() > 400_000 // sizes[0]
    finally:
        spark.conf.set(CHUNK_CONF, before)


def test_quoted_csv_that_never_closes_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('"text","label"\n"one","0"\n"two,"1"\n')
    with pytest.raises(Exception, match="never closed"):
        read_quoted_csv(spark, str(tmp_path)).count()


def test_a_fit_ends_at_the_optimum(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(" ".join(rng.choices(words[:30] if i % 2 else words[10:], k=12)), float(i % 2)) for i in range(160)]
    df = spark.createDataFrame(rows, "text string, label double")
    table = dg.word_features(df).transform(df).select("features", "label").cache()
    model = dg.classifier(len(rows)).setTol(1e-6).fit(table)
    got = table.collect()
    x = np.array([r.features.toArray() for r in got])
    x1, y = np.c_[x, np.ones(len(x))], np.array([r.label for r in got])
    ridge = np.r_[np.full(x.shape[1], 1 / len(x)), 0.0]  # the intercept is free

    def loss(w):
        z = x1 @ w
        return np.mean(np.logaddexp(0, z) - y * z) + (ridge * w * w).sum() / 2

    def gradient(w):
        return x1.T @ (1 / (1 + np.exp(-x1 @ w)) - y) / len(x) + ridge * w

    w = np.zeros(x1.shape[1])
    for _ in range(30):  # Newton's method on the dense features
        p = 1 / (1 + np.exp(-x1 @ w))
        w = w - np.linalg.solve((x1.T * (p * (1 - p))) @ x1 / len(x) + np.diag(ridge), gradient(w))
    fitted = np.r_[model.coefficients.toArray(), model.intercept]
    assert np.linalg.norm(gradient(w)) < 1e-10
    assert loss(fitted) - loss(w) <= 1e-5 * loss(w)
    assert np.linalg.norm(gradient(fitted)) < 1e-3


def test_held_out_models_share_their_passes_and_equal_dense_optima(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words[:22] if i % 2 else words[8:], k=10)) + " rare" * (i % 60 == 0), i % 2, "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int, source string")
    passes = []
    shared = jf._pass
    monkeypatch.setattr(jf, "_pass", lambda *a: passes.append(len(a[2])) or shared(*a))
    got = {r.source: r for r in dg.leave_one_source_out(df).collect()}
    assert passes[0] == 3 and len(passes) < 60  # all models in one pass
    cut = dg.word_terms().transform(df)
    for part in "abc":
        train, test = cut.filter(F.col("source") != part), cut.filter(F.col("source") == part)
        features = dg.weigh_terms(train)
        x, y = (np.array(v) for v in zip(*[(r.features.toArray(), r.label) for r in features.transform(train).collect()]))
        x1 = np.c_[x, np.ones(len(x))]
        ridge = np.r_[np.ones(x.shape[1]), 0.0]
        w = np.zeros(x1.shape[1])
        for _ in range(30):  # Newton's method
            p = 1 / (1 + np.exp(-x1 @ w))
            w = w - np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        held = features.transform(test).collect()
        z = np.array([r.features.toArray() for r in held]) @ w[:-1] + w[-1]
        clear = np.abs(z) > 0.02
        right = (z > 0) == np.array([r.label for r in held])
        assert abs(got[part].accuracy - right.mean()) <= (~clear).mean() + 1e-9


def test_joint_fits_of_several_classes(spark):
    rows = [(i, f"text of {'red green blue'.split()[i % 3]} kind {i % 7}", "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame([*rows, (998, "", "a"), (999, "?", "b")], "row_id long, text string, source string")
    assert dg.source_separability(df).first().accuracy > 0.95


def test_terms_of_held_out_models_are_counted_by_part_only_where_likely(spark, monkeypatch):
    """Words that one source alone repeats push the others down the list of all; the words kept are still those of the definition."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(240):
        part = "abc"[i % 3]
        words = [common[int(300 * rng.random() ** 2)] for _ in range(40)] + [f"own{rng.randrange(60)}" for _ in range(60) if part == "a"]
        rows.append((words, i % 2, part))
    df = spark.createDataFrame(rows, "terms array<string>, label int, part string")
    written, write = {}, dg.materialise
    monkeypatch.setattr(dg, "materialise", lambda df, name: written.setdefault(f"{name}-{len(written)}", write(df, name)))
    for size in (20, 1000):
        written.clear()
        blocks, weights, outside = dg.held_out_terms(df, ["a", "b", "c"], 2, size, "few")
        want = []
        for part in "abc":
            train = [words for words, _, p in rows if p != part]
            n, d = Counter(w for words in train for w in words), Counter(w for words in train for w in set(words))
            kept = sorted((w for w in n if d[w] >= 2), key=lambda w: (-n[w], w))[:size]
            want.append({w: np.log((len(train) + 1) / (d[w] + 1)) + 1 for w in kept})
        vocabulary = sorted(set().union(*want))
        assert np.allclose(weights, [[of.get(w, 0) for w in vocabulary] for of in want], rtol=1e-12) and outside.tolist() == [160] * 3
        counted = [t.count() for name, t in written.items() if name.startswith("few-counts")]
        assert len(counted) > 1 and max(counted) < 200 if size == 20 else len(counted) == 1
        block = [r for r in blocks.collect()]
        assert sum(r.rows for r in block) == 240
        assert sum(np.frombuffer(r.n, "float32").sum() for r in block) == sum(w in vocabulary for words, _, _ in rows for w in words)
