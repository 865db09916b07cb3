"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's emission score is linear in features of the line and of its two
neighbours; a 2 x 2 matrix scores how labels follow each other. Forward-backward gives each line's marginal
probability of being good; a document's score is the mean of these, weighted by the lines' lengths, made a
probability by a logistic curve. The field is trained in numpy on the driver, on a bounded number of labelled
documents, whose label all their lines take.

With two states a forward or backward message is one log-odds value, so all documents of a slice go forward
together, line by line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._labels import held_out, training_rows
from plumbline.llm._spark import annotate
from plumbline.llm._text import SPACED, Words, buffer, mix, slices

#: Texts of either class that the field is fitted on, at most, and lines of a training sequence; longer texts make several.
TRAIN_EACH = 2000
TRAIN_LINES = 64


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


CLASSES = [_class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b"*%$&#@^~=_<>{}[]\\"), _class(b"|\t"), _class(b"!?"), _class(b".,;:"), _class(b"\"'()-/+`"), _class(bytes([*range(97, 123), *range(128, 256)]))]
WIDTH = len(CLASSES) + 5


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and where each text's lines begin (one more than texts)."""
    data, offsets = buffer(column)
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, first = cuts[:-1], np.searchsorted(cuts, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * WIDTH + 3)), np.zeros(0), np.zeros(len(offsets), np.int64)
    length = np.diff(cuts).astype(float)
    own = np.zeros((n, WIDTH))
    for i, kind in enumerate(CLASSES):
        own[:, i] = np.sqrt(np.add.reduceat(kind[data].astype(np.int32), starts) / length)
    words = Words((data, cuts), SPACED)
    h = words.hashes()
    count = np.diff(words.first)
    line = np.repeat(np.arange(n), count)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    filled = np.maximum(count, 1)
    own[:, -5] = np.sqrt(np.bincount(line, again, minlength=n) / filled)
    own[:, -4] = np.minimum(np.bincount(line, words.ends - words.starts, minlength=n) / filled / 16, 2)
    own[:, -3] = np.log1p(count) / 6
    mark = np.zeros(n, np.uint64)
    np.add.at(mark, line, mix(h))
    own[1:, -2] = (mark[1:] == mark[:-1]) & (count[1:] > 0)
    own[:, -1] = count == 0
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    filled_texts = np.flatnonzero(np.diff(first))
    is_first[first[:-1][filled_texts]] = True
    is_last[first[1:][filled_texts] - 1] = True
    own[is_first, -2] = 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[is_first], after[is_last] = 0, 0
    return np.column_stack([own, before, after, is_first, is_last, np.ones(n)]), length, first


def messages(emission: np.ndarray, first: np.ndarray, change: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good against bad that come forward to each line (its own emission included) and backward to it.

    change[i, j] scores label j after label i; start is the score of a good first line.
    """
    forward, backward = np.zeros(len(emission)), np.zeros(len(emission))
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    many = np.searchsorted(-count[order], -np.arange(count.max(initial=0)), "left")  # texts with more than t lines
    for t in range(len(many)):
        at = first[order[: many[t]]] + t
        if t == 0:
            forward[at] = emission[at] + start
        else:
            r = forward[at - 1]
            forward[at] = emission[at] + np.logaddexp(r + change[1, 1], change[0, 1]) - np.logaddexp(r + change[1, 0], change[0, 0])
    for t in range(len(many) - 2, -1, -1):
        at = first[order[: many[t + 1]]] + t
        r = emission[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(r + change[1, 1], change[1, 0]) - np.logaddexp(r + change[0, 1], change[0, 0])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Field:
    emission: np.ndarray
    change: np.ndarray
    start: float
    curve: tuple[float, float]

    def marginals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each line to be good, its length, and where each text's lines begin."""
        features, length, first = lines(column)
        forward, backward = messages(features @ self.emission, first, self.change, self.start)
        return sigmoid(forward + backward), length, first

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in slices(column):
            good, length, first = self.marginals(column.slice(lo, hi - lo))
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            out.append((np.bincount(text, good * length, minlength=hi - lo) + 0.5 * (np.diff(first) == 0)) / np.maximum(np.bincount(text, length, minlength=hi - lo), 1))
        a, b = self.curve
        share = np.clip(np.concatenate(out), 1e-4, 1 - 1e-4)
        return sigmoid(a * np.log(share / (1 - share)) + b)


def _adam(gradient, parameters: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, steps + 1):
        g = gradient(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        parameters = parameters - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return parameters


def log_likelihood(p: np.ndarray, features: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted conditional log-likelihood of the lines' labels, and its gradient. p: emission, change (row by row), start."""
    d = features.shape[1]
    emission, change, start = features @ p[:d], p[d : d + 4].reshape(2, 2), p[-1]
    forward, backward = messages(emission, first, change, start)
    good = sigmoid(forward + backward)
    full = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(emission), bool)
    inner[full] = False
    b = np.flatnonzero(inner)
    a = b - 1
    eb = emission[b] + backward[b]
    pair = np.stack([np.zeros(len(b)) + change[0, 0], change[0, 1] + eb, forward[a] + change[1, 0], forward[a] + change[1, 1] + eb])
    pair = np.exp(pair - pair.max(0))
    pair /= pair.sum(0)
    seen = np.zeros((4, len(b)))
    seen[2 * labels[a] + labels[b], np.arange(len(b))] = 1
    gradient = np.concatenate([features.T @ ((labels - good) * weight), ((seen - pair) * weight[b]).sum(1), [((labels - good) * weight)[full].sum()]])
    # The labels' probability is a chain of conditionals: P(first) times P(next | before).
    odds = forward + backward
    value = (weight[full] * -np.logaddexp(0, np.where(labels[full] == 1, -odds[full], odds[full]))).sum()
    given = np.where(labels[a] == 1, change[1, 1] - change[1, 0], change[0, 1] - change[0, 0]) + eb
    value += (weight[b] * -np.logaddexp(0, np.where(labels[b] == 1, -given, given))).sum()
    return value, gradient


def fit(rows: list[tuple[str, int]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty; classes weigh alike, whatever their texts' lengths.

    With fewer than two classes every text scores the share of class 1 (0 without rows).
    """
    width = 3 * WIDTH + 3
    column, y = pa.array([t for t, _ in rows], pa.string()), np.array([y for _, y in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), 0.0, (0.0, 60.0 if y.any() else -60.0))
    features, _, first = lines(column)
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    labels = y[doc]
    weight = 1 / np.maximum(np.diff(first), 1)[doc]
    weight *= np.where(labels == 1, 0.5 / weight[labels == 1].sum(), 0.5 / weight[labels == 0].sum())
    place = np.arange(len(doc)) - first[doc]
    cuts = np.append(np.flatnonzero(place % TRAIN_LINES == 0), len(doc))
    p = _adam(lambda p: decay * p - log_likelihood(p, features, cuts, labels, weight)[1], np.zeros(width + 5), steps, rate)
    field = Field(p[:width], p[width : width + 4].reshape(2, 2), float(p[-1]), (1.0, 0.0))
    share = np.clip(field.scores(column), 1e-4, 1 - 1e-4)
    x, each = np.log(share / (1 - share)), np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def curve(q: np.ndarray) -> np.ndarray:
        error = (sigmoid(q[0] * x + q[1]) - y) * each
        return np.array([(error * x).sum() + 1e-4 * q[0], error.sum()])

    a, b = _adam(curve, np.array([1.0, 0.0]), 300, 0.05)
    return Field(field.emission, field.change, field.start, (float(a), float(b)))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "quality", keep: list[str] | None = None, train_each: int = TRAIN_EACH, threshold: float = 0.3) -> DataFrame:
    """`row` (a struct of the kept columns, all by default), score (0 to 1) and predicted (0 or 1) of each row.

    The field learns from the labels alone that training_rows() picks; scores depend on texts only. Null and
    empty texts have no line and count as half good. Labels of one class alone make a constant score. Rows that
    share an id are scored each by its text. Nothing else is read, so other columns can have any names; an empty
    table gives an empty one.
    """
    fitted = fit(training_rows(docs, labels, label, train_each, id_col, text_col))
    # Some dozens of numbers: executors need not know this package's classes to read them.
    field = docs.sparkSession.sparkContext.broadcast((fitted.emission, fitted.change, fitted.start, fitted.curve))
    found = annotate(docs, text_col, docs.columns if keep is None else keep, lambda texts: [pa.array(Field(*field.value).scores(texts), pa.float64())], "score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole of documents."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
