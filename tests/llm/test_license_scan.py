import re

import numpy as np
import pandas as pd

from plumbline.llm import license_scan as L


def brute(text, model):
    out = []
    for i, line in enumerate((text or "").split("\n") if text else []):
        if not re.search(L.ANCHOR, line):
            continue
        words = L._tokens(line)
        names = {n: k for k, n in enumerate(model.names)}
        logits = model.bias + sum((model.weights[names[f]] for f in L.features(line) if f in names), np.zeros(len(L.CLASSES)))
        p = model._softmax(logits[None] / model.temperature)[0]
        family, own = L.CLASSES[int(p.argmax())], set(L._pairs(words))
        if family != L.UNKNOWN and p.max() >= model.threshold:
            shared = [(len(own & set(L._pairs(L._tokens(t)))), len(set(L._pairs(L._tokens(t))))) for t in L.TEMPLATES[family]]
            out.append((i, family, any(n >= min(2, m) and (n >= 0.6 * m or n >= 0.6 * len(own)) for n, m in shared)))
    return out


def test_against_plain_python(spark):
    model = L.Model()
    texts = [None, "", "\n\n", "Released under the MIT License.", "prose\nLicensed under CC BY-NC 4.0.\nmore prose here", "He lost his driving license.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "x " * 100_000 + "license", "All rights reserved.", "license", *[t for t, _ in L.samples(5, 3)], *[" ".join(t.split()[:9]) for ts in L.TEMPLATES.values() for t in ts]]
    texts += list(pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text[:300])
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    rows = {r.row.doc_id: r for r in L.scan(docs, model=model).collect()}
    for i, t in enumerate(texts):
        assert [(x.paragraph, x.family, x.confirmed) for x in rows[i].found] == brute(t, model), t
        assert rows[i].n_paragraphs == (len(t.split("\n")) if t else 0)
    for i, family in ((3, "mit"), (4, "cc-by-nc"), (6, "apache-2.0"), (7, "gpl")):
        assert [(x.family, x.confirmed) for x in rows[i].found] == [(family, True)]
    assert not any(x.confirmed for x in rows[5].found)
    assert L.scan(docs.limit(0), model=model).collect() == []


def test_held_out_samples():
    model = L.Model()
    names = {n: k for k, n in enumerate(model.names)}
    right = []
    for t, c in L.samples(99, 20):
        logits = model.bias + sum((model.weights[names[f]] for f in L.features(t) if f in names), np.zeros(len(L.CLASSES)))
        p = model._softmax(logits[None] / model.temperature)[0]
        k = int(p.argmax())
        right.append((k if p.max() >= model.threshold else len(L.CLASSES) - 1) == c)
    assert np.mean(right) > 0.9


def test_statements_without_keywords(spark):
    texts = ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution 4.0 International", "prose\nin the Software without restriction, including without limitation the rights\nprose", "Unless required by applicable law or agreed to in writing, software"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.row.doc_id: [(x.paragraph, x.family, x.confirmed) for x in r.found] for r in L.scan(docs).collect()}
    assert [rows[i] for i in range(4)] == [[(0, "cc-by", True)], [(0, "cc-by", True)], [(1, "mit", True)], [(0, "apache-2.0", True)]]
