"""Licence scans: a trained paragraph classifier, confirmed by templates; scored by DataFrame functions alone.

A paragraph is a line of a text. Its sparse features are the words and word pairs that occur in the samples; a
multinomial logistic regression over them, fitted on the driver on samples that rules make from the templates,
gives each licence family, and the class `unknown`, a probability. A temperature and a threshold, set on samples
that were held out, calibrate it: below the threshold a paragraph is unknown. A prediction counts as confirmed
only if the paragraph and a template of the family share enough word pairs. Every paragraph is scored. Scoring
looks weights up in a literal of the plan.
"""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements and paragraphs of common licences, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org MPL 2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "Copyright 2020 The Company. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Sentences with the same words that state no licence.
ORDINARY = "He lost his driving license last week. | A license to practise medicine is required by law. | The copyright debate goes on in parliament. | She asked for permission to leave the room. | The warranty of the car expired. | They met at MIT and moved to Boston. | Apache helicopters flew over the valley. | The public library is a free domain of knowledge. | Rights were reserved for members only. | Version 2.0 of the report was published. | The general public was invited. | Free software is discussed in this article about licenses. | The licensed driver was late. | You may obtain a copy of the report at the desk. | The following conditions are met by the weather station. | Attribution of the painting is uncertain.".split(" | ")
#: Of the lines that are scored: all.
ANCHOR = ""
UNKNOWN = "unknown"
CLASSES = (*TEMPLATES, UNKNOWN)
BUCKETS = 4096
#: Of a template's pairs of words, or of the paragraph's, so many must be shared.
CONFIRM = 0.6
LEAST_PAIRS = 2


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def features(text: str) -> list[str]:
    words = _tokens(text)
    return sorted({*words, *_pairs(words)})


def samples(seed: int = 11, each: int = 60) -> list[tuple[str, int]]:
    """Paragraphs with their class: templates whole, cut, with words lost, and with words around; and ordinary ones."""
    rng = random.Random(seed)
    filler = [w for s in ORDINARY for w in _tokens(s)] + "der die das et le la que and of to in with for was said then house water people year place".split()
    out = []
    for c, family in enumerate(CLASSES):
        texts = TEMPLATES.get(family, ORDINARY)
        for _ in range(each if family != UNKNOWN else 5 * each):
            words = _tokens(rng.choice(texts)) if family != UNKNOWN or rng.random() < 0.5 else [rng.choice(filler) for _ in range(rng.randrange(1, 40))]
            if len(words) > 20 and rng.random() < 0.5:
                a = rng.randrange(len(words) - 12)
                words = words[a : a + rng.randrange(12, 24)]
            words = [w for w in words if rng.random() > 0.05]
            around = [[rng.choice(filler) for _ in range(rng.randrange(0, 6))] for _ in range(2)]
            out.append((" ".join(around[0] + words + around[1]), c))
    return out


class Model:
    """Weights of features by class, a temperature and the threshold of the best family's probability."""

    def __init__(self, steps: int = 300, decay: float = 1e-3):
        train, test = samples(11), samples(12)
        names = sorted({f for t, _ in train for f in features(t)})
        number = {f: i for i, f in enumerate(names)}

        def matrix(rows: list[tuple[str, int]]) -> np.ndarray:
            x = np.zeros((len(rows), len(names)), np.float32)
            for i, (t, _) in enumerate(rows):
                x[i, [number[f] for f in features(t) if f in number]] = 1
            return x

        x, y = matrix(train), np.array([c for _, c in train])
        w, b = np.zeros((len(names), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            p = self._softmax(x @ w + b)
            p[np.arange(len(y)), y] -= 1
            g = x.T @ p / len(y) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= 0.5 * p.mean(0)
        logits, truth = matrix(test) @ w + b, np.array([c for _, c in test])
        loss = [-np.log(self._softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.arange(0.5, 3.01, 0.1)]
        self.temperature = float(0.5 + 0.1 * int(np.argmin(loss)))
        p = self._softmax(logits / self.temperature)
        families = p[:, :-1]
        # The threshold that puts an end to 99 of 100 wrong families, 1/2 at least.
        wrong = families.max(1)[(families.argmax(1) != truth)]
        self.threshold = float(max(0.5, np.quantile(wrong, 0.99) if len(wrong) else 0.5))
        self.names, self.weights, self.bias = names, w, b

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def literal(self) -> Column:
        """The weights as an array of small maps, of which a feature's CRC-32 picks one. JSON is folded beforehand."""
        maps: list[dict] = [{} for _ in range(BUCKETS)]
        for name, row in zip(self.names, self.weights, strict=True):
            maps[zlib.crc32(name.encode()) % BUCKETS][name] = [round(float(v), 5) for v in row]
        return F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<double>>>")


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """Licence statements in texts.

    Returns, for each row of docs, `row` (a struct of the kept columns, all by default), n_paragraphs, and
    found: of each paragraph whose family the classifier names, its number (from 0), family, probability and
    whether a template confirms it. Null and empty texts have no paragraph; blank lines count but have no words.
    """
    keep, model = docs.columns if keep is None else keep, model or Model()
    families = F.array(*map(F.lit, CLASSES))
    templates = F.from_json(F.lit(json.dumps([[_pairs(_tokens(t)) for t in TEMPLATES.get(c, [])] for c in CLASSES])), "array<array<array<string>>>")
    bias = F.array(*[F.lit(float(b)) for b in model.bias])

    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def pairs_of(words: Column) -> Column:
        return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))

    def judge(x: Column) -> Column:
        words = F.regexp_extract_all(F.lower(x["line"]), F.lit("[a-z0-9]+"), F.lit(0))

        def scored(w: Column) -> Column:
            names = F.array_distinct(F.concat(w, pairs_of(w)))
            rows = bound(model.literal(), lambda table: F.filter(F.transform(names, lambda n: F.try_element_at(F.element_at(table, (F.crc32(n.cast("binary")) % BUCKETS + 1).cast("int")), n)), lambda r: r.isNotNull()))
            logits = F.aggregate(rows, bias, lambda a, r: F.zip_with(a, r, lambda p, q: p + q))
            raised = bound(logits, lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / model.temperature)))
            return bound(raised, lambda e: F.struct(w.alias("w"), F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, q: a + q)).alias("p")))

        def named(s: Column) -> Column:
            best = F.array_position(s["p"], F.array_max(s["p"])).cast("int")
            family = (best < len(CLASSES)) & (F.array_max(s["p"]) >= model.threshold)  # of others, pairs aren't compared
            own = F.array_distinct(pairs_of(s["w"]))
            shared = F.exists(F.element_at(templates, best), lambda t: (F.size(F.array_intersect(own, t)) >= F.least(F.lit(LEAST_PAIRS), F.size(F.array_distinct(t)))) & ((F.size(F.array_intersect(own, t)) >= CONFIRM * F.size(F.array_distinct(t))) | (F.size(F.array_intersect(own, t)) >= CONFIRM * F.size(own))))
            return F.struct(x["at"].alias("paragraph"), F.element_at(families, best).alias("family"), F.array_max(s["p"]).alias("probability"), F.when(family, shared).otherwise(F.lit(False)).alias("confirmed"))

        return bound(bound(words, scored), named)

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    packed = docs.select((F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))).alias("row"), lines.alias("lines"))
    marked = packed.select("row", F.size("lines").alias("n_paragraphs"), F.transform("lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"))).alias("marked"))
    found = F.filter(F.transform("marked", judge), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= model.threshold))
    return marked.select("row", "n_paragraphs", F.when(F.size("marked") > 0, found).otherwise(F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")).alias("found"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence families of the whole of documents: those confirmed, and the number of statements."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select("row.doc_id", "n_paragraphs", F.size("found").alias("n_predicted"), F.size(sure).alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))
