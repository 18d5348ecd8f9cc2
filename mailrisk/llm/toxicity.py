"""Toxicity by class-conditional Kneser-Ney models.

A word's context is the class of the document it stands in: toxic or ordinary. Each class has an interpolated Kneser-Ney
model with modified discounts: a count is the number of documents of the class that hold the word, and an absolute discount
for words of one, two, and three or more documents comes from the counts of counts of the class. What the discounts free goes to
the lower order, which the classes share: the continuation count of a word, in how many documents of the whole
corpus, labelled or not, it occurs. Both classes back off with one weight, the larger, so a word too rare for either has
the same share in both and says nothing.

The log-likelihoods are compared word by word and normalised by length: over the whole text, over its best
passages of 1, 4 and 16 words, and over its best 2, 4 and 8 words wherever they stand, since a few words make a long text
toxic. A logistic calibration weighs these seven. It is learned by leaving one out: a labelled text is measured with its own
document taken from the counts of its class. Copies of texts make words look commoner than they are, so the discounts
are also tried at the multiples ``SCALES``; the one of least left-out loss is kept.

Counts are exact, by 64-bit hashes of words, in a table that Spark groups and writes; it grows with the corpus. Entries of
the words that one document in ``COMMON`` holds, at most ``HOT``, are broadcast, so that the share of words sent does not hang on the size of the corpus; a bit map tells which others a text may need. A text that
needs none is measured on the spot; only the others send two bytes per word to meet the rest of the table. Ratios are
rounded to half precision wherever they are kept, so that both ways give one result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.llm import bitmap
from mailrisk.llm.bitmap import collect_bits, has_bits, maybe_member
from mailrisk.llm.words import hash_words, plain_words
from mailrisk.session import materialise

HOT = 1 << 18
COMMON = 1 << 13  # a word is common if one document in so many holds it: few words are, whatever the corpus
MAP_CELLS = 1 << 28
FLUSH_WORDS = 1 << 20
SCALES = (1.0, 1.5, 2.0)
PASSAGES = (1, 4, 16)
BEST_WORDS = (2, 4, 8)
FEATURES = 1 + len(PASSAGES) + len(BEST_WORDS)
CALIBRATION_ROWS = 20_000
COPIES = 1 << 16
BROADCAST_IDS = 1 << 19  # labelled ids, of a fixed width, that are broadcast; more are joined by key


def _map_of(keys: DataFrame, number: int) -> tuple[np.ndarray, int]:
    """Bit map with two cells set for each of some ``number`` values of ``key``, and how many cells it has."""
    cells = min(MAP_CELLS, max(bitmap.BLOCK, 1 << (32 * number).bit_length()))
    last = F.lit(cells - 1)
    places = F.array(F.col("key").bitwiseAND(last), F.shiftrightunsigned("key", 32).bitwiseAND(last))
    return collect_bits(keys.select(F.lit(0).alias("depth"), F.explode(places).alias("cell")), 1, cells)[0], cells


def _maybe(bits: np.ndarray, cells: int, w: np.ndarray) -> np.ndarray:
    last = np.uint64(cells - 1)
    return has_bits(bits, (w & last).astype(np.int64)) & has_bits(bits, ((w >> np.uint64(32)) & last).astype(np.int64))


def _documents_of_words(batches: Iterator[pa.RecordBatch], held=None) -> Iterator[pa.RecordBatch]:
    """Documents of each word, by class where the rows have one; added up over some texts at a time.

    ``held``: broadcast bit map of the only words asked for.
    """
    kept: dict[int, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for y, parts in kept.items():
            w, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), pa.array(np.full(len(w), y, np.int32)), pa.array(n.astype(np.int32))], ["w", "y", "n"])
        kept.clear()

    for batch in batches:
        classes = batch.column(1).to_pylist() if batch.num_columns > 1 else [0] * batch.num_rows
        for text, y in zip(batch.column(0), classes):
            w = np.unique(hash_words(plain_words(text.as_py())))
            if held is not None:
                w = w[_maybe(*held.value, w)]
            kept.setdefault(y, []).append(w)
            size += len(w)
            if size >= FLUSH_WORDS:
                yield from flush()
                size = 0
    if size:
        yield from flush()


_COUNTED = "w bigint, y int, n int"


def word_counts(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every word of the classes (``key``) with the documents of each class that hold it, ``c0`` and ``c1``, and of the corpus, ``n``.

    ``documents`` has texts ``x``, ``labelled`` also classes ``y``. Words that no labelled text holds are left out before
    the shuffle: they say nothing.
    """
    by_class = labelled.select("x", "y").mapInArrow(_documents_of_words, _COUNTED).groupBy(F.col("w").alias("key")).agg(
        *[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"c{y}") for y in (0, 1)])
    by_class = materialise(by_class, "class-words")
    held = documents.sparkSession.sparkContext.broadcast(_map_of(by_class, by_class.count()))
    shared = documents.select("x").mapInArrow(lambda it: _documents_of_words(it, held), _COUNTED)
    return by_class.join(shared.groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("n")), "key", "left").fillna(0, ["n"])


def modified_discounts(counts: list[int]) -> tuple[float, float, float]:
    """Discounts of words of one, two, and three or more documents, from how many words have 1, 2, 3 and 4."""
    n = [max(1, int(x or 0)) for x in counts]
    share = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * share * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _left(count: Column, discounts: tuple[float, float, float], scale: float) -> Column:
    """What its discount leaves of a count."""
    one, two, more = (scale * d for d in discounts)
    taken = F.when(count == 1, one).when(count == 2, two).otherwise(more)
    return F.when(count > 0, F.greatest(count - taken, F.lit(0.0))).otherwise(0.0)


@dataclass
class Models:
    """The written counts of words with what the models need to know of all of them."""

    words: DataFrame
    discounts: list[tuple[float, float, float]]
    total: float
    number: int
    sums: dict[tuple[float, int], float]
    backoff: dict[float, float]
    documents: int = 0

    @staticmethod
    def of(words: DataFrame, documents: int = 0) -> Models:
        """Discounts, sums of what they leave, and backoff weights, for each of ``SCALES``."""
        seen = words.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("number"),
            *[F.coalesce(F.sum(f"c{y}"), F.lit(0)).alias(f"sum{y}") for y in (0, 1)],
            *[F.count(F.when(F.col(f"c{y}") == i, 1)).alias(f"n{i}{y}") for y in (0, 1) for i in (1, 2, 3, 4)],
        ).first()
        discounts = [modified_discounts([seen[f"n{i}{y}"] for i in (1, 2, 3, 4)]) for y in (0, 1)]
        left = words.agg(*[
            F.coalesce(F.sum(_left(F.col(f"c{y}"), discounts[y], s)), F.lit(0.0)) for s in SCALES for y in (0, 1)
        ]).first()
        sums = dict(zip([(s, y) for s in SCALES for y in (0, 1)], left))
        backoff = {s: max(1 - sums[s, y] / max(1, seen[f"sum{y}"]) for y in (0, 1)) for s in SCALES}
        return Models(words, discounts, float(seen["total"]), seen["number"], sums, backoff, documents)

    def share(self, y: int, scale: float, without: int | None = None) -> Column:
        """Share of a word in class ``y``; ``without``: with one document less in that class."""
        base = (F.col("n") + 0.5) / (self.total + 0.5 * self.number)
        count = F.col(f"c{y}") - (1 if without == y else 0)
        own = _left(count, self.discounts[y], scale) / max(self.sums[scale, y], 1e-9)
        return (1 - self.backoff[scale]) * own + self.backoff[scale] * base

    def ratio(self, scale: float, without: int | None = None) -> Column:
        return F.log(self.share(1, scale, without) / self.share(0, scale, without))

    def entries(self, values: dict[str, Column]) -> DataFrame:
        """``key``, ``n`` and the given ratios, for words that say anything."""
        rows = self.words.select("key", "n", *[v.cast("float").alias(name) for name, v in values.items()])
        return rows.filter(reduce(Column.__or__, [F.col(name) != 0 for name in values]))


def _held(table: DataFrame, values: list[str], documents: int = 0) -> tuple:
    """Broadcast of the entries common among so many ``documents`` and of a bit map of the others, and the others."""
    step = F.when(F.col("n") * COMMON >= documents, F.floor(4 * F.log2(F.col("n") + 1))).otherwise(-1)
    steps = table.groupBy(step.alias("step")).count().collect()
    least, total = None, 0
    for at, n in sorted(((r["step"], r["count"]) for r in steps if r["step"] >= 0), reverse=True):
        if total + n > HOT:
            break
        least, total = at, total + n
    many = F.lit(False) if least is None else step >= least
    hot = table.filter(many).select("key", *values).toPandas()
    keys = hot["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    said = hot[values].to_numpy(dtype=np.float16)[order].T.copy()
    cold = table.filter(~many).select("key", *values)
    held = (keys[order], said, *_map_of(cold, sum(r["count"] for r in steps) - total))
    return table.sparkSession.sparkContext.broadcast(held), cold


def length_normalised(r: np.ndarray) -> list[float]:
    """Ratios of the whole text, of its best passages, and of its best words. Zeros without words."""
    if not len(r):
        return [0.0] * FEATURES
    sums = np.concatenate(([0.0], np.cumsum(r, dtype=np.float64)))
    out = [sums[-1] / len(r)]
    for width in PASSAGES:
        w = min(width, len(r))
        out.append(float((sums[w:] - sums[:-w]).max()) / width)
    best = np.sort(r)[::-1][: max(BEST_WORDS)].astype(np.float64)
    return out + [float(best[:k].sum()) / k for k in BEST_WORDS]


def _features(said: np.ndarray) -> list[float]:
    return [x for r in said.astype(np.float32) for x in length_normalised(r)]


def _said(text: str | None, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, what the common ones say, and the places of those that may be among the others."""
    keys, values, bits, cells = held.value
    w = hash_words(plain_words(text))
    said = np.zeros((len(values), len(w)), dtype=np.float16)
    rest = np.ones(len(w), dtype=bool)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
        common = keys[at] == w
        said[:, common] = values[:, at[common]]
        rest = ~common
    return w, said, np.flatnonzero(rest & _maybe(bits, cells, w))


def _heads(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """A row per text: its features if common words are all it has, else what they say."""
    for batch in batches:
        said, features = [], []
        for text in batch.column("x"):
            _, own, rest = _said(text.as_py(), held)
            said.append(own.tobytes() if len(rest) else None)
            features.append(None if len(rest) else _features(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("r1", "r2", "k")] + [pa.array(said, pa.binary()), pa.array(features, pa.list_(pa.float64()))],
            ["r1", "r2", "k", "said", "f"])


def _asked(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """A row per word that may be among the others."""
    for batch in batches:
        row, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, text in enumerate(batch.column("x")):
            w, _, rest = _said(text.as_py(), held)
            row.append(np.full(len(rest), i))
            keys.append(w[rest].view(np.int64))
            places.append(rest)
        row = pa.array(np.concatenate(row))
        yield pa.RecordBatch.from_arrays(
            [batch.column("r1").take(row), batch.column("r2").take(row), pa.array(np.concatenate(keys)),
             pa.array(np.concatenate(places).astype(np.int32))], ["r1", "r2", "key", "at"])


def _finish(batches: Iterator[pa.RecordBatch], n_values: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for f, said, parts in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if f is None:
                r = np.frombuffer(said.as_py(), dtype=np.float16).reshape(n_values, -1).copy()
                inner = parts.values
                if inner is not None and len(inner):
                    at = inner.field(0).to_numpy(zero_copy_only=False)
                    for i in range(n_values):
                        r[i, at] = inner.field(1 + i).to_numpy(zero_copy_only=False)
                f = _features(r)
            out.append(f)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64())), batch.column(4)], ["k", "f", "n"])


def measured(rows: DataFrame, table: DataFrame, values: list[str], documents: int = 0) -> DataFrame:
    """``k`` and the features ``f`` of every row (``k``, ``x``), ``FEATURES`` of them by each of the ``values`` of ``table``.

    Texts are read twice, for the rare words they ask for and for what the common ones say, so that the latter is
    sent once. A row is known by a hash of 128 bits of key and text; rows repeated with both are measured once.
    """
    held, cold = _held(table, values, documents)
    kind = rows.schema["k"].dataType.simpleString()
    absent = (F.col("k").isNull(), F.col("x").isNull())
    known = rows.select(F.xxhash64("k", "x", *absent).alias("r1"), F.xxhash64(F.lit(1), "x", "k", *absent).alias("r2"), "x", "k")
    heads = known.mapInArrow(lambda it: _heads(it, held), f"r1 bigint, r2 bigint, k {kind}, said binary, f array<double>")
    asked = known.select("r1", "r2", "x").mapInArrow(lambda it: _asked(it, held), "r1 bigint, r2 bigint, key bigint, at int")
    met = asked.join(cold, "key").select("r1", "r2", F.struct("at", *values).alias("part"))
    both = heads.withColumn("n", F.lit(1)).unionByName(met.withColumn("n", F.lit(0)), allowMissingColumns=True)
    texts = both.groupBy("r1", "r2").agg(
        *[F.first(x, ignorenulls=True).alias(x) for x in ("k", "f", "said")], F.collect_set("part").alias("parts"), F.sum("n").alias("n")
    )
    number = len(values)
    once = texts.select("k", "f", "said", "parts", "n").mapInArrow(
        lambda it: _finish(it, number), f"k {kind}, f array<double>, n bigint")
    # In two steps, so that no list of copies is long.
    part = F.col("n") - F.col("part") * COPIES
    parted = once.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))).alias("part"))
    return parted.select("k", "f", F.explode(F.sequence(F.lit(1), F.least(part, F.lit(COPIES)))).alias("copy")).drop("copy")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights (last: bias) of a logistic regression by Newton's method on standardised columns.

    A step is halved until the loss falls: whole steps may swing ever wider where classes are nearly separable.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.sum(np.logaddexp(0, m) - y * m) + w @ penalty @ w / 2)

    least = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + penalty, slope)
        gain, size = slope @ step, 1.0
        while (found := loss(w - size * step)) > least - 1e-4 * size * gain and size > 1e-9:
            size /= 2
        if found >= least:
            break
        w, least = w - size * step, found
        if size * np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - weights @ mean)


def log_loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    z = np.clip(x @ weights[:-1] + weights[-1], -35, 35)
    return float(np.mean(np.logaddexp(0, z) - y * z))


@dataclass
class ToxicityModel:
    """Written counts, the multiple of the discounts that was kept, and the weights of the calibration."""

    models: Models | None
    scale: float = 1.0
    weights: np.ndarray | None = None

    def score(self, features: Column) -> Column:
        """Probability of label 1 for a column of features."""
        z = reduce(Column.__add__, [features[i] * float(w) for i, w in enumerate(self.weights[:-1])]) + float(self.weights[-1])
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))


def fit(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> ToxicityModel:
    """Learn from ``documents`` (counts over all rows) and ``labels`` (``key``, ``label`` 0/1; training rows only).

    Counts use every labelled row and the shared counts every document. The calibration uses at most
    ``CALIBRATION_ROWS`` labelled ids, those with the smallest key hash, with one text each. An id labelled twice is toxic if
    any label is; null ids and labels are left out. Null and empty texts have no words.
    """
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("x"))
    known = materialise(
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y")), "known"
    )
    both = known.agg(F.min("y"), F.max("y")).first()
    if tuple(both) != (0, 1):
        return ToxicityModel(None)
    narrow = known.schema["k"].dataType not in (T.StringType(), T.BinaryType()) and known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    labelled = docs.filter(maybe_member(known, "k")(F.col("k"))).join(F.broadcast(known) if narrow else known, "k")
    models = Models.of(materialise(word_counts(docs, labelled), "words"), docs.count())

    sample = F.broadcast(known.orderBy(F.xxhash64("k"), "k").limit(CALIBRATION_ROWS))
    texts = docs.join(sample, "k").select(F.struct(F.col("k").alias("id"), "y", F.xxhash64("x").alias("h")).alias("k"), "x")
    values = {f"r{i}{y}": models.ratio(s, y) for i, s in enumerate(SCALES) for y in (0, 1)}
    found = measured(texts, models.entries(values), list(values), models.documents)
    # One text for each id: repeated ids crowd out no others.
    rows = found.groupBy("k.id").agg(F.min(F.struct("k.h", "k.y", "f")).alias("t")).select("id", "t.y", "t.f").orderBy("id").collect()
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(None)
    x = np.array([r["f"] for r in rows]).reshape(len(rows), len(SCALES), 2, FEATURES)
    x = x[np.arange(len(rows)), :, y.astype(int)]
    fitted = [(fit_logistic(x[:, i], y), x[:, i]) for i in range(len(SCALES))]
    best = min(range(len(SCALES)), key=lambda i: log_loss(fitted[i][1], y, fitted[i][0]))
    return ToxicityModel(models, SCALES[best], fitted[best][0])


def score_documents(model: ToxicityModel, documents: DataFrame, key: str, text: str, cut: float) -> DataFrame:
    """One row per input row: ``key``, ``score`` (0 to 1), ``predicted`` (1 from ``cut`` on).

    Only the text is scored; the score is 0.0 throughout if the model never saw both classes. Null and empty texts
    get the score of a text without evidence. Repeated rows
    and null keys are kept; an empty table gives an empty result; other columns are not read.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("x"))
    if model.models is None:
        scored = rows.select(F.col("k").alias(key), F.lit(0.0).alias("score"))
    else:
        found = measured(rows, model.models.entries({"r": model.models.ratio(model.scale)}), ["r"], model.models.documents)
        scored = found.select(F.col("k").alias(key), model.score(F.col("f")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
