import hashlib
import random

import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from plumbline.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def coder(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_tiktoken(spark, ranks, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cé\n\t'st1ß漢😀.-_  ") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", " ", "<|endoftext|>", "anana ananas ereere ......", "a" * 3000, "the  quick\r\n\r\nbrown   ", "x y " * 20_000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = coder(ranks)
    for known, size in ((1 << 20, 1 << 20), (20, 50)):
        monkeypatch.setattr(bpe, "KNOWN", known)
        monkeypatch.setattr(bpe, "TEXT_BYTES", size)
        rows = {r.row.doc_id: r for r in bpe.encode_and_decode(docs, ranks, P.PATTERN).collect()}
        for i, t in enumerate(texts):
            assert rows[i].ids == enc.encode_ordinary(t or ""), t
            assert bytes(rows[i].decoded) == (t or "").encode()


def test_very_long_pieces(spark, ranks):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(100_000)), "ab" * 5000 + " short", "é" * 1000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = coder(ranks)
    for r in bpe.encode_and_decode(docs, ranks, P.PATTERN).collect():
        assert r.ids == enc.encode_ordinary(texts[r.row.doc_id]) and bytes(r.decoded).decode() == texts[r.row.doc_id]


def test_merge_is_the_fold(ranks):
    rng, enc = random.Random(6), coder(ranks)
    for _ in range(300):
        word = "".join(rng.choice("abcdeioné") for _ in range(rng.randrange(2, 40)))
        assert bpe.merge(word.encode(), ranks) == enc._encode_single_piece(word) or word.encode() in ranks


def test_tokens_that_merges_do_not_make(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    docs = spark.createDataFrame([(1, "abc abcd")], "doc_id long, text string").limit(1)
    (r,) = bpe.encode_and_decode(docs, ranks, P.PATTERN).collect()
    assert r.ids == coder(ranks).encode_ordinary("abc abcd")
    assert bpe.encode_and_decode(docs.limit(0), ranks, P.PATTERN).collect() == []


def test_plans_do_not_spell_the_ranks(spark, ranks):
    """The driver keeps each plan's description; and the tables must stay in the fold, not in the rows."""
    docs = spark.createDataFrame([(1, "some text zzqxxyk")], "doc_id long, text string")
    plans = bpe.encode_and_decode(docs, ranks, P.PATTERN)._jdf.queryExecution()
    assert len(plans.toString()) < 100_000
    assert "scalar-subquery" in plans.optimizedPlan().toString() and " AS tables#" not in plans.optimizedPlan().toString()


def test_query(spark, ranks):
    folder, enc = "/root/testdata/sf0.001", coder(ranks)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op10_bpe(spark, folder).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
