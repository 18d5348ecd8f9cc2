"""Quality by Bradley-Terry ranking of documents.

A document's strength is a weighted sum of features of its text. The chance that one document is preferred
to another is the logistic function of the difference of their strengths, so the weights are learned from
preference pairs by logistic loss on feature differences. A document is accepted if its strength reaches a
quantile of the strengths seen in training.

Features are read in one pass inside the tasks. Only a bounded sample of labelled rows reaches the
driver; every document is scored where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log, log1p
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 20_000
PAIRS_PER_ROW = 8
_ASCII = np.array([
    0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 if chr(c).isspace()
    else 4 if chr(c) in ".,;:'\"-?()" else 5 if c == ord("!") else 6 if c < 128 else 7
    for c in range(256)
])
_MARKED = re.compile(rb"[@/\\<>{}|#$%&*_=+~^]")
_ENDS = (b".", b"!", b"?")


def features(text: str | None) -> list[float]:
    """Shape of a text: sizes, repetition, character classes, punctuation and lines. Null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    classes = np.bincount(_ASCII, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=8) / size
    share = np.array(list(counts.values()), dtype=np.float64) / n
    lines = [x for x in raw.split(b"\n") if x]
    n_lines = max(1, len(lines))
    return [
        log1p(len(words)), log1p(len(raw) / n), len(counts) / n, top / n,
        sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n,
        float(-(share * np.log(share)).sum()) / log(n + 1) if words else 0.0,
        *classes.tolist(),
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isdigit, words)) / n,
        sum(w.endswith(_ENDS) for w in words) / n, len(_MARKED.findall(raw)) / n,
        log1p(n_lines), log1p(size / n_lines), len(set(lines)) / n_lines,
        sum(len(w) > 20 for w in words) / n, sum(len(w) < 3 for w in words) / n,
    ]


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, kept within bounds so that no odd text is off the scale."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([z, np.minimum(z * z, 12)])


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on the differences, Newton's method."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # chance of the wrong order
        gradient = -(d.T @ p) + ridge * w
        step = np.linalg.solve((d.T * np.maximum(p * (1 - p), 1e-9)) @ d + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product may round equal rows apart.
        return (_wide(x, self.mean, self.scale) * self.weights).sum(axis=1)

    def chance(self, x: np.ndarray, accepted: float) -> np.ndarray:
        """Logistic in the strength; ``accepted`` is the value at the quantile."""
        z = self.strength(x) - self.cut + log(accepted / (1 - accepted))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> QualityModel | None:
    """Model of a labelled sample; none without both labels.

    Every row meets ``PAIRS_PER_ROW`` rows of the other label, drawn with a fixed seed. The quantile is the
    one that puts most sample rows on their label's side, in the middle of the gap it falls into.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _wide(x, mean, scale)
    draw = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(good, PAIRS_PER_ROW), draw.choice(good, PAIRS_PER_ROW * len(bad))])
    worse = np.concatenate([draw.choice(bad, PAIRS_PER_ROW * len(good)), np.repeat(bad, PAIRS_PER_ROW)])
    weights = fit_pairs(z[better], z[worse])
    order = np.argsort(z @ weights, kind="stable")
    s, labels = (z @ weights)[order], y[order]
    # Right decisions if the first i rows are rejected.
    right = np.concatenate([[0], np.cumsum(labels == 0)]) + labels.sum() - np.concatenate([[0], np.cumsum(labels == 1)])
    i = int(right.argmax())
    cut = s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2
    return QualityModel(mean, scale, weights, float(cut))


def fit(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> QualityModel | None:
    """Learn from ``labels`` (``key``, ``label`` 0/1; training rows only) and the texts they name.

    At most ``TRAINING_ROWS`` labelled ids are used, those with the smallest key hash, with one text each: of several, the one
    with the least hash. An id labelled twice is good only if all its labels are; null ids and labels are left out. None without both labels.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.min((F.col(label) > 0).cast("int")).alias("y"))
    )
    sample = F.broadcast(known.orderBy(F.xxhash64("k"), "k").limit(TRAINING_ROWS))
    # One text for each id: repeated ids crowd out no others.
    texts = (
        documents.select(F.col(key).alias("k"), F.col(text).alias("x"))
        .join(sample, "k")
        .groupBy("k", "y")
        .agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x")).alias("t"))
    )
    rows = texts.orderBy("k").select("y", _features(F.col("t.x")).alias("f")).collect()
    if not rows:
        return None
    return learn(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows]))


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return of(text)


def score(model: QualityModel | None, text: Column, cut: float) -> Column:
    """Score from 0 to 1 that reaches ``cut`` exactly where the model accepts; without a model, 1.0."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        return pd.Series(model.chance(x, cut) if len(x) else [])

    return of(text)


def score_documents(
    model: QualityModel | None, documents: DataFrame, key: str, text: str, cut: float
) -> DataFrame:
    """One row per input row: ``key``, ``score`` (0 to 1), ``predicted`` (1 from ``cut`` on: accepted).

    Only the text is scored; null and empty texts are scored as a text without words. Repeated rows and
    null keys are kept; an empty table gives an empty result; other columns are not read.
    """
    scored = documents.select(F.col(key), score(model, F.col(text), cut).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
