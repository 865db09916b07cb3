import random
import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import quality, toxicity
from plumbline.llm._labels import training_rows


def test_subwords_against_plain_python():
    texts = ["Ab, cde  f", "", "éa\nb", None, "xyz"]
    buckets, owners = toxicity.subwords(pa.array(texts))
    for i, t in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        grams = sum(max(0, len(f"<{w}>") - n + 1) for w in words for n in toxicity.SIZES)
        assert (owners == i).sum() == grams + len(words)
    a, b = toxicity.subwords(pa.array(["cde"])), toxicity.subwords(pa.array(["q, cde!"]))
    assert set(a[0]) <= set(b[0])


def test_toxicity_learns_and_generalises_to_misspellings(monkeypatch):
    rng = random.Random(1)
    syllables = ["na", "ti", "or", "len", "ka", "su"]
    say = lambda n: [rng.choice(syllables) + rng.choice(syllables) for _ in range(n)]

    def text(toxic, words):
        w = say(60)
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(words)
        return " ".join(w)

    rows = [(text(y, ["wretched", "horrible"]), y) for y in [0, 1] * 150]
    model = toxicity.fit(rows)
    held = [(text(y, ["wretchedd", "horribl"]), y) for y in [0, 1] * 50]
    scores = model.scores(pa.array([t for t, _ in held]))
    assert np.mean((scores >= 0.5) == [y for _, y in held]) > 0.9
    whole = model.scores(pa.array([held[1][0]]))
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert np.allclose(model.scores(pa.array([held[1][0]])), whole)


def test_field_marginals_against_all_labellings():
    import itertools

    rng = np.random.default_rng(0)
    emission, change, start = rng.normal(size=7), rng.normal(size=(2, 2)), 0.3
    first = np.array([0, 4, 4, 7])
    forward, backward = quality.messages(emission, first, change, start)
    got = quality.sigmoid(forward + backward)
    for a, b in ((0, 4), (4, 7)):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(start * y[0] + sum(e for e, v in zip(emission[a:b], y, strict=True) if v) + sum(change[i, j] for i, j in zip(y, y[1:])))
            total += s
            good += s * np.array(y)
        assert np.allclose(got[a:b], good / total)


def test_gradient_of_the_field():
    rng = np.random.default_rng(1)
    features, first = rng.normal(size=(9, 3)), np.array([0, 5, 9])
    labels, weight, p = rng.integers(0, 2, 9), np.ones(9), rng.normal(size=8)
    _, gradient = quality.log_likelihood(p, features, first, labels, weight)
    for i in range(8):
        step = np.eye(8)[i] * 1e-5
        up, down = (quality.log_likelihood(p + s, features, first, labels, weight)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-4


def frames(spark):
    docs = spark.createDataFrame([(1, "good text here", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "a b", 9), (4, "x " * 200_000, 9)], "doc_id long, text string, score int")
    return docs, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 1), (4, 0, 1), (9, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_edge_cases(spark):
    docs, labels = frames(spark)
    for module in (toxicity, quality):
        rows = module.classify(docs, labels).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 and r.row.score == 9 for r in rows)
        assert len({r.score for r in rows if r.row.text in (None, "")}) == 1
        assert module.classify(docs.limit(0), labels.limit(0)).collect() == []
        assert len({r.score for r in module.classify(docs, labels.where("doc_id = 1")).collect()}) == 1


def test_training_leaves_the_held_out_fifth(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 500)
    used = {int(t.split()[1]) for t, _ in rows}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(training_rows(docs, labels, "toxic", 10)) == 20


def accuracy(spark, query, label, folder="/root/testdata/sf0.1"):
    """Share that is right, area under the curve, share of class 1 found, share of class 0 flagged: of the held-out rows."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = query(spark, folder).join(labels, "doc_id").where("held_out").select("predicted", "score", label).collect()
    right = np.mean([r.predicted == r[label] for r in rows])
    good, bad = [r for r in rows if r[label] == 1], [r for r in rows if r[label] == 0]
    auc = np.mean([(g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad])
    return right, auc, np.mean([r.predicted for r in good]), np.mean([r.predicted for r in bad])


def test_held_out_accuracy(spark):
    right, auc, *_ = accuracy(spark, quality.op7_quality, "quality")
    assert right > 0.97 and auc > 0.98
    right, auc, found, flagged = accuracy(spark, toxicity.op9_toxicity, "toxic")
    assert right > 0.95 and auc > 0.95 and found >= 0.9 and flagged <= 0.04


def test_few_labels(spark):
    """329 training rows, of which 45 are toxic."""
    _, auc, _, flagged = accuracy(spark, toxicity.op9_toxicity, "toxic", "/root/testdata/sf0.01")
    assert auc >= 0.9 and flagged <= 0.1
    assert toxicity.op9_toxicity(spark, "/root/testdata/sf0.01").where("predicted = 1").count() < 200
    right, auc, *_ = accuracy(spark, quality.op7_quality, "quality", "/root/testdata/sf0.01")
    assert right > 0.9 and auc > 0.9


def test_training_texts_are_whole_or_not_chosen(spark):
    docs = spark.createDataFrame([(i, "a" * (10 + 100 * (i == 3))) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 500, text_bytes=50, train_bytes=200)
    assert len(rows) == 10 and {len(t) for t, _ in rows} == {10}
