"""Quality grades by ordinal regression: one hashed-text score and ordered thresholds (cumulative logits).

P(grade >= j) = 1 / (1 + exp(threshold_j - score)). The score's weights are shared by all thresholds, so a few graded
documents of each kind suffice. A document gets its expected grade and the probability of reaching the grade wanted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import inline
from .common import slices, text_bytes, without
from .toxicity import BITS, MOST, Sparse, bucket, word_features

_RUN = re.compile(r"([Aa0])\1+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters to A or a, digits to 0; marks stay.
_SHAPES = {i: "A" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else chr(i) for i in range(0x250)}
SCALE = 4.0


def shape(word: str) -> str:
    return _RUN.sub(r"\1", word.translate(_SHAPES))[:12]


class Reader:
    """Turns texts into hashed features; keeps what it knows of a word (bounded)."""

    def __init__(self, kept: set[int] | None = None):
        self.kept = kept
        self.known: dict[str, tuple[int, tuple[int, ...]]] = {}

    def word(self, w: str) -> tuple[int, tuple[int, ...]]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            words = [f for x in _WORD.findall(w.lower()) for f in word_features(x)]
            got = self.known[w] = (bucket("s:" + shape(w)), tuple(f for f in words if self.kept is None or f in self.kept))
        return got

    def features(self, text: str) -> dict[int, float]:
        """Shares of word shapes, of words equal to the one before, of known words and lines seen earlier in the text; and words by occurrence."""
        words = text.split()
        shapes: Counter = Counter()
        hits: Counter = Counter()
        for w, n in Counter(words).items():
            s, features = self.word(w)
            shapes[s] += n
            for f in features:
                hits[f] += n
        n = max(1, len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        shapes[bucket("repeat")] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        shapes[bucket("old words")] += len(words) - len(set(words))
        out = {f: SCALE * c / n for f, c in shapes.items()}
        out[bucket("old lines")] = SCALE * (len(lines) - len(set(lines))) / max(1, len(lines))
        out[bucket("long")] = min(1.0, len(words) / 50)
        return out | {f: float(min(MOST, c)) for f, c in hits.items()}


class Model:
    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.reader = Reader(set(weights))

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        z = sum(self.weights.get(f, 0.0) * v for f, v in sorted(self.reader.features(text).items()))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - z, -700, 700)))


def fit(texts: Iterable[str], grades: list[int], levels: int = 3, ridge: float = 0.5, least: int = 4, most: int = 2048, rounds: int = 400) -> Model:
    """Gradient steps with momentum on the cumulative-link likelihood + ridge; thresholds are kept in order.

    Without rows, all grades are equally likely. A grade that no row has keeps its place between its neighbours.
    """
    y = np.array(grades, int)
    counts = np.array([(y >= j).sum() for j in range(1, levels)], float)
    tail = (counts + 1) / (len(y) + 2) if len(y) else np.array([1 - j / levels for j in range(1, levels)])
    theta = np.log((1 - tail) / tail) + np.arange(levels - 1) * 1e-3
    if not len(y) or y.min() == y.max():
        return Model({}, theta.tolist())
    reader, rows, values = Reader(), [], []  # one text at a time: only buckets and values are kept
    for t in texts:
        found = reader.features(t)
        rows.append(np.fromiter(found, np.int32, len(found)))
        values.append(np.fromiter(found.values(), float, len(found)))
    x = Sparse(rows, values)
    del reader, rows, values
    size = 1 << BITS
    # the features whose mean differs most between the grades, by the spread of grade sums against chance
    total, square = np.bincount(x.col, minlength=size), np.bincount(x.col, x.val**2, minlength=size)
    pull = np.bincount(x.col, x.val * (y - y.mean())[x.row], minlength=size)
    score = np.where(total >= least, pull**2 / np.maximum(square, 1e-9), -1.0)
    keep = np.sort(np.argsort(-score, kind="stable")[:most])
    keep = keep[score[keep] > 0]
    at = np.full(size, -1)
    at[keep] = np.arange(len(keep))
    ok = at[x.col] >= 0
    x.row, x.col, x.val = x.row[ok], at[x.col[ok]], x.val[ok]
    size, n = len(keep), len(y)
    weight = n / (levels * np.maximum(1, np.bincount(y, minlength=levels)))[y]
    weight = np.minimum(weight, 10.0)
    step = 1 / (x.back(0.5 * weight * np.bincount(x.row, np.abs(x.val), minlength=n), size, absolute=True) + ridge)
    w, v, last = np.zeros(size), np.zeros(size), theta.copy()
    for i in range(rounds):
        momentum = i / (i + 3)
        at_w, at_t = w + momentum * v, theta + momentum * (theta - last)
        at_t = np.maximum.accumulate(at_t)
        z = x.times(at_w)
        edge = np.concatenate([[-np.inf], at_t, [np.inf]])
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(-(edge[y + 1] - z))), 1 / (1 + np.exp(-(edge[y] - z)))
        p = np.maximum(up - low, 1e-9)
        slope = weight * (up + low - 1)
        grad_t = np.bincount(y, weight * up * (1 - up) / p, minlength=levels)[: levels - 1] - np.bincount(y, weight * low * (1 - low) / p, minlength=levels)[1:]
        new = at_w + step * (x.back(slope, size) - ridge * at_w)
        last, theta = theta, np.maximum.accumulate(at_t + grad_t / weight.sum() + np.arange(levels - 1) * 1e-9)
        v, w = new - w, new
    return Model({int(f): float(c) for f, c in zip(keep, w, strict=True)}, theta.tolist())


def train(docs: DataFrame, ratings: DataFrame, sample: int = 6000, levels: int = 3) -> Model:
    """Fit on at most ``sample`` rated documents, the first in the order of a hash. Null ids and grades are not used; of several
    grades or texts of one id, the lowest grade and smallest text are."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("__grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(inline(chosen)), "doc_id")
    table = rows.groupBy("doc_id").agg(F.min("__grade").alias("y"), F.min("__text").alias("text")).orderBy("doc_id").toArrow()
    return fit((t.as_py() for t in table.column("text")), [min(levels - 1, max(0, g)) for g in table.column("y").to_pylist()], levels)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the two labels: 0 poor, 1 well made but toxic, 2 well made and clean; a null label gives no rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def rate(docs: DataFrame, model: Model, wanted: int = 1, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of grade ``wanted`` or better) and ``kept`` appended.

    Null and empty texts are rated as texts without words. Repeated rows are rated alike; other columns pass through; input
    columns named like the outputs are replaced; an empty table gives an empty table.
    """
    docs = without(docs, ["expected_grade", "tail_probability", "kept"])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__data"):
            tails = [model.tails(t.decode("utf-8", "replace")) for t in batch.column("__data").to_pylist()]
            reach = [float(t[wanted - 1]) for t in tails]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(reach, pa.float64()), pa.array([r >= threshold for r in reach], pa.bool_())],
                names=[*columns, "expected_grade", "tail_probability", "kept"],
            )

    own = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.withColumn("__data", text_bytes()).mapInArrow(run, T.StructType([*docs.schema.fields, *own]))


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return rate(docs, train(docs, grades(labels))).drop("text")
