"""Toxicity by hashed-text logistic regression with a counterfactual penalty.

The classifier is fitted on the driver to a bounded sample of labelled documents; scoring runs where the documents are. For
sentences that name a group, the training set holds twins that name another group or none, and the squared change of the
score between twins is part of the loss. So a mention as such moves the score little, and neutral sentences about
people are not taken for attacks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import inline
from .common import slices, text_bytes

BITS = 20
#: Occurrences of a feature that count.
MOST = 3
#: Lengths of the word beginnings that are features beside the word.
PREFIXES = (4, 5)
#: Groups whose mention must not move the score.
IDENTITY = (
    "women men woman man girls boys muslims muslim christians christian jews jewish hindus buddhists atheists gay lesbian bisexual "
    "transgender queer straight black white asian african arab latino hispanic indigenous european american mexican chinese "
    "indian immigrants refugees disabled deaf blind elderly teenagers femmes hommes musulmans chrétiens juifs immigrés frauen "
    "männer muslime christen juden flüchtlinge mujeres hombres musulmanes cristianos judíos inmigrantes"
).split()
_KNOWN = frozenset(IDENTITY)
_WORD = re.compile(r"[^\W\d_]+")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> tuple[int, ...]:
    """The word itself and, for longer words, its first letters (endings vary with the language)."""
    return (bucket("w:" + word), *[bucket("p:" + word[:n]) for n in PREFIXES if len(word) >= n])


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text and how often each occurs, at most ``MOST`` times: long texts are not louder."""
    found: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            found[f] += n
    cols = np.array(sorted(found), dtype=np.int32)
    return cols, np.array([min(MOST, found[f]) for f in cols.tolist()], dtype=np.float32)


class Sparse:
    """Rows of buckets with values."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate(values) if values else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray, size: int, absolute: bool = False) -> np.ndarray:
        return np.bincount(self.col, (np.abs(self.val) if absolute else self.val) * g[self.row], minlength=size)


def twins(named: list[Counter], plain: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature differences between a text and its twin: identity words swapped or taken out, and a mention put into a plain text.

    Only the changed words matter to the difference of a linear score, so a pair is made of these alone.
    """
    rows, values = [], []

    def pair(one: Counter, two: Counter) -> None:
        diff: dict[int, float] = {}
        for bag, sign in ((one, 1.0), (two, -1.0)):
            for f, n in zip(*features(bag), strict=True):
                diff[int(f)] = diff.get(int(f), 0.0) + sign * n
        rows.append(np.array(list(diff), np.int64))
        values.append(np.array(list(diff.values()), float))

    for word in IDENTITY[:plain]:
        pair(Counter([word]), Counter())
    for bag in named:
        pair(bag, Counter({IDENTITY[(IDENTITY.index(w) + 7) % len(IDENTITY)]: n for w, n in bag.items()}))
        pair(bag, Counter())
    return rows, values


def select_features(x: Sparse, y: np.ndarray, least: int, most: int) -> np.ndarray:
    """Buckets of at least ``least`` texts, the ``most`` of them that differ most between the classes (chi-square)."""
    size = 1 << BITS
    total, hit = np.bincount(x.col, minlength=size), np.bincount(x.col, y[x.row], minlength=size)
    share, n = y.mean(), len(y)
    expected = total * share
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(total >= least, (hit - expected) ** 2 / (expected * (1 - share) * (1 - total / (n + 1))), -1.0)
    best = np.argsort(-score, kind="stable")[:most]
    return best[score[best] > 0]


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        hits: dict[int, int] = {}
        known = self.words
        for w in tokens(text):
            got = known.get(w)
            if got is None:
                if len(known) > 300_000:
                    known.clear()
                got = known[w] = tuple(f for f in word_features(w) if f in self.weights)
            for f in got:
                hits[f] = hits.get(f, 0) + 1
        z = self.bias + sum(self.weights[f] * min(MOST, hits[f]) for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit(
    texts: Iterable[str], labels: list[int], ridge: float = 0.1, fairness: float = 1.0, toxic_weight: float = 10.0, least: int = 4, most: int = 1024, plain: int = 1000, rounds: int = 300
) -> Model:
    """Gradient descent with momentum on log-loss + ridge + ``fairness`` times the mean squared score change of twins.

    Toxic rows count ``toxic_weight`` times. No rows, or one class only: a model without weights that gives the smoothed
    rate of the labels, below one half unless all are toxic.
    """
    y = np.array(labels, float)
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Model({}, bias)
    rows, named = [], []  # one text at a time: only buckets and mentions are kept
    for t in texts:
        bag = Counter(tokens(t))
        rows.append(features(bag))
        if mentions := {w: n for w, n in bag.items() if w in _KNOWN}:
            named.append(Counter(mentions))
    x = Sparse(*zip(*rows, strict=True))
    del rows
    keep = np.unique(np.concatenate([select_features(x, y, least, most), *[np.array(word_features(w)) for w in IDENTITY]]))
    at = np.full(1 << BITS, -1)
    at[keep] = np.arange(len(keep))
    t = Sparse(*twins(named, plain))
    for s in (x, t):
        ok = at[s.col] >= 0
        s.row, s.col, s.val = s.row[ok], at[s.col[ok]], s.val[ok]
    size, n = len(keep), len(y)
    weight = np.where(y > 0, toxic_weight, 1.0)
    pull = fairness * n / max(1, t.n)
    # a diagonal bound of the curvature makes one step size fit frequent and rare buckets alike
    bound = lambda m, scale: m.back(scale * np.bincount(m.row, np.abs(m.val), minlength=m.n), size, absolute=True)
    step = 1 / (bound(x, 0.25 * weight) + bound(t, np.full(t.n, 2 * pull)) + ridge)
    w, v, b, vb = np.zeros(size), np.zeros(size), bias, 0.0
    for i in range(rounds):
        momentum = i / (i + 3)
        at_w, at_b = w + momentum * v, b + momentum * vb
        p = 1 / (1 + np.exp(-np.clip(x.times(at_w) + at_b, -50, 50)))
        error = weight * (p - y)
        grad = x.back(error, size) + ridge * at_w + t.back(2 * pull * t.times(at_w), size)
        new, new_b = at_w - step * grad, at_b - error.sum() * 0.4 / weight.sum()
        v, vb, w, b = new - w, new_b - b, new, new_b
    return Model({int(f): float(c) for f, c in zip(keep, w, strict=True) if abs(c) > 1e-6}, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """Fit on at most ``sample`` labelled documents whose crc32(doc_id) mod 5 is not 0, the first in the order of a hash.

    Labelled rows with a null id or label are not used; of rows that share an id, one label and one text are.
    """
    good = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = good.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(inline(chosen)), "doc_id")
    table = rows.groupBy("doc_id").agg(F.max("__toxic").alias("y"), F.min("__text").alias("text")).orderBy("doc_id").toArrow()
    return fit((t.as_py() for t in table.column("text")), table.column("y").to_pylist())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` appended (0 to 1). Null and empty texts get the score of no words; repeated rows score alike. Other
    columns pass through; an input column named score is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__data"):
            scores = [model.score(t.decode("utf-8", "replace")) for t in batch.column("__data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(scores, pa.float64())], names=[*columns, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.withColumn("__data", text_bytes()).mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.select("doc_id", "text")
    scored = score_documents(docs, train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns."""
    scored = score_documents(docs, train(docs, labels))
    return scored.where(F.col("score") < threshold).drop("score")
