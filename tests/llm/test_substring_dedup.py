import hashlib
import random
import re
from collections import Counter

from plumbline.llm.substring_dedup import substring_dedup


def brute(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, n):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    rows = {r.id: r for r in substring_dedup(docs, window=n).collect()}
    assert len(rows) == len(texts)
    for i, (words, removed, kept) in enumerate(brute(texts, n)):
        r = rows[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (words, removed, kept), (i, texts[i])
        assert sum(x.end - x.start for x in r.removed) == removed
        assert all(x.end < y.start for x, y in zip(r.removed, r.removed[1:]))


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    texts += ["é ü x y  z\t\n w " * 3, "a b", "", None, "  ", "x" * 300_000, " ".join(f"w{i}" for i in range(60_000)), "q w e r t " * 4]
    check(spark, texts, 4)
    check(spark, texts, 7)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(docs).collect() == []
    rows = substring_dedup(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string"), window=2).collect()
    assert sorted((r.id is None, r.n_words, r.n_removed) for r in rows) == [(False, 0, 0), (True, 3, 3), (True, 3, 3)]


def test_query(spark):
    import pandas as pd

    from plumbline.llm.substring_dedup import op6_substring_dedup

    folder = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in op6_substring_dedup(spark, folder).collect()}
    for i, (words, removed, kept) in zip(docs.doc_id, brute(docs.text, 35), strict=True):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (words, removed, hashlib.sha256(kept.encode()).hexdigest())
