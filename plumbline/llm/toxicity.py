"""Toxicity: a bag of subword embeddings, averaged, under a linear softmax.

A text's subwords are its words and their character 3- to 6-grams with the word's ends marked, hashed into
buckets. A bucket that the classes of the training texts hold at different rates, beyond chance, has an embedding;
a text is the average of the embeddings of its distinct subwords and goes through a linear softmax layer. (The
average divides by the square root of their number, so that many telling subwords count for more than one.) Both
are trained together, by Adam in numpy on the driver, on a bounded number of labelled rows. A misspelling that
never occurred shares n-grams with the words that did. As averaging and the layer are linear, scoring looks up one
number for each bucket: the difference of the two classes' logits that its embedding makes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._labels import held_out, training_rows
from plumbline.llm._spark import annotate, release
from plumbline.llm._text import mix, slices

BITS = 18
SIZES = (3, 4, 5, 6)
#: Bytes of text that are handled at once.
SLICE = 1 << 18
#: Texts of either class that the model is fitted on, at most.
TRAIN_EACH = 1500
#: Weight of class 1 in training: clean texts that are called toxic cost more than toxic ones that pass.
TOXIC_SHARE = 0.4
#: A bucket counts where its share of texts differs between the classes by so many standard errors.
ERRORS = 4.0
K = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str):
    """The text in parts of about SLICE characters that end where a word does."""
    at = 0
    while at < len(text):
        end = at + SLICE
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 if end < len(text) else len(text)
        if cut <= at:  # one word that is longer
            after = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
            cut = min(after) + 1 if after else len(text)
        yield pa.array([text[at:cut]])
        at = cut


def letters() -> np.ndarray:
    """Which code points below 0x3100 are parts of words: digits, letters, and what lies beyond Latin-1's signs."""
    inside = np.zeros(0x3100, bool)
    inside[48:58] = inside[97:123] = inside[0xC0:] = True
    inside[[0xD7, 0xF7]] = inside[0x2000:0x2070] = inside[0x3000:0x3040] = False
    return inside


INSIDE = letters()


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts, and which text each is of; not in the order of the texts."""
    texts = pc.utf8_lower(column.fill_null("")).to_pylist()
    joined = "\0".join(texts) + "\0"
    point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    inside = INSIDE[np.minimum(point, 0x30FF)]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    keep = inside | before  # a word, and one place after it
    point, doc, inside = np.where(inside, point, 0)[keep], doc[keep], inside[keep]
    point, doc, inside = (np.concatenate([a, np.zeros(6, a.dtype)]) for a in (point, doc, inside))
    # Place i is the end of a word where inside is false; a word begins after it. Place -1 is an end as well.
    n = len(point) - 6
    value = point.astype(np.uint64) + np.uint64(1)
    value = np.concatenate([np.ones(1, np.uint64), value])
    inside = np.concatenate([[False], inside])
    doc = np.concatenate([doc[:1], doc])
    h, found, owners = value[: n + 1].copy(), [], []
    open_ = np.ones(n + 1, bool)  # the places between the first and the last are all inside
    for size in range(2, max(SIZES) + 1):
        h = h * K + value[size - 1 : size - 1 + n + 1]
        if size > 2:
            open_ = open_ & inside[size - 2 : size - 2 + n + 1]
        if size in SIZES:
            at = np.flatnonzero(open_)
            found.append(h[at] + np.uint64(size))
            owners.append(doc[at + 1])
    # Whole words: a hash of all their places.
    starts = np.flatnonzero(inside[1 : n + 1] & ~inside[:n]) + 1
    if len(starts):
        place = np.arange(n + 7) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n + 7]])))
        spread = mix(value + (place.astype(np.uint64) << np.uint64(32))) * inside
        found.append(np.add.reduceat(spread, starts))
        owners.append(doc[starts])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix(np.concatenate(found))
    return (h >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners)


@dataclass
class Model:
    """logit = offset + sum of weights of a text's distinct known buckets / sqrt(1 + their number): of class 1 against class 0.

    known: the numbers of the buckets that have an embedding, sorted.
    """

    known: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(column)), np.zeros(len(column))
        number = np.full(1 << BITS, -1, np.int32)
        number[self.known] = np.arange(len(self.known), dtype=np.int32)
        for lo, hi in slices(column, SLICE):
            owner, at = held(column.slice(lo, hi - lo), number)
            total[lo:hi] = np.bincount(owner, self.weights[at], minlength=hi - lo)
            count[lo:hi] = np.bincount(owner, minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(self.offset + total / np.sqrt(1 + count), -60, 60)))


def held(column: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of every distinct known subword of some texts, by text. A column of one text can be of any length."""
    keys = []
    for part in [column] if len(column) > 1 else pieces(column[0].as_py() or ""):
        bucket, owner = subwords(part)
        at = number[bucket]
        keys.append(np.unique(owner[at >= 0].astype(np.int64) << BITS | at[at >= 0]))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def spread(values: np.ndarray, into: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by a sorted number each."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(into):
        begin = np.flatnonzero(np.diff(into, prepend=-1))
        out[into[begin]] = np.add.reduceat(values, begin)
    return out


def fit(rows: list[tuple[str, int]], width: int = 8, epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 1e-3, errors: float = ERRORS, seed: int = 7) -> Model:
    """Train embeddings and softmax layer together by Adam on small batches; class 1 weighs TOXIC_SHARE of all.

    With fewer than two classes the model gives every text the share of class 1 (0 without rows). Without a bucket
    that tells the classes apart the layer's offset alone scores.
    """
    labels = np.array([y for _, y in rows], np.int64)
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if labels.any() else -30.0)
    rng = np.random.default_rng(seed)
    column, every, parts = pa.array([t for t, _ in rows], pa.string()), np.arange(size, dtype=np.int32), []
    for lo, hi in slices(column, SLICE // 4):
        owner, bucket = held(column.slice(lo, hi - lo), every)
        parts.append((owner.astype(np.int32) + np.int32(lo), bucket.astype(np.int32)))
    doc, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    many = np.bincount(labels, minlength=2)
    of_toxic = np.bincount(bucket[labels[doc] == 1], minlength=size)
    of_all = np.bincount(bucket, minlength=size)
    rate_all = (of_all + 0.5) / (len(rows) + 1)
    apart = (of_toxic / many[1] - (of_all - of_toxic) / many[0]) / np.sqrt(rate_all * (1 - rate_all) * (1 / many).sum())
    known = np.flatnonzero((np.abs(apart) >= errors) & (of_all > 1))
    number = np.full(size, -1, np.int32)
    number[known] = np.arange(len(known), dtype=np.int32)
    keep = number[bucket] >= 0
    doc, bucket = doc[keep], number[bucket[keep]]
    share = (1 / np.sqrt(1 + np.bincount(doc, minlength=len(rows))))[doc].astype(np.float32)
    first = np.searchsorted(doc, np.arange(len(rows) + 1, dtype=np.int32))
    weight = (len(rows) * np.array([1 - TOXIC_SHARE, TOXIC_SHARE]) / many)[labels].astype(np.float32)
    p = {"E": rng.normal(0, 0.01, (len(known), width)).astype(np.float32), "W": rng.normal(0, 1, (width, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen, t = order[k : k + batch], t + 1
            held_by = np.diff(first)[chosen]
            row = np.repeat(np.arange(len(chosen)), held_by)
            at = np.arange(len(row)) + np.repeat(first[chosen] - (np.cumsum(held_by) - held_by), held_by)
            mean = spread(p["E"][bucket[at]] * share[at, None], row, len(chosen))
            logits = mean @ p["W"] + p["b"]
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error *= weight[chosen, None] / len(chosen)
            back = (error @ p["W"].T)[row] * share[at, None]
            grad = {"W": mean.T @ error + decay * p["W"], "b": error.sum(0), "E": np.stack([np.bincount(bucket[at], back[:, i], minlength=len(known)) for i in range(width)], 1).astype(np.float32) + decay * p["E"]}
            for n, g in grad.items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-4)
    return Model(known, p["E"].astype(float) @ (p["W"][:, 1] - p["W"][:, 0]).astype(float), float(p["b"][1] - p["b"][0]))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "toxic", keep: list[str] | None = None, train_each: int = TRAIN_EACH, threshold: float = 0.5) -> DataFrame:
    """`row` (a struct of the kept columns, all by default), score (0 to 1) and predicted (0 or 1) of each row.

    The model learns from the labels alone that training_rows() picks; scores depend on texts only, on whole ones.
    Null and empty texts, and all others without a known subword, score what the layer's offset gives. Labels of
    one class alone make a constant score. Rows that share an id are scored each by its text. Nothing else is read,
    so other columns can have any names; an empty table gives an empty one.
    """
    fitted = fit(training_rows(docs, labels, label, train_each, id_col, text_col))
    release()
    # Arrays, of at most 2**18 entries: executors need not know this package's classes to read them.
    model = docs.sparkSession.sparkContext.broadcast((fitted.known, fitted.weights, fitted.offset))
    found = annotate(docs, text_col, docs.columns if keep is None else keep, lambda texts: [pa.array(Model(*model.value).scores(texts), pa.float64())], "score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole of documents."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
