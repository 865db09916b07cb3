"""The pipeline's rows against its operators' brute-force versions."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    say = lambda n: " ".join(rng.choice("na ti or len ka su".split()) + rng.choice("na ti or len ka su mo".split()) + str(rng.randrange(9)) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        words = say(60).split()
        if i % 5 == 4:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(["horrible", "wretched"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 4)))
    bench = say(40)
    docs += [(1000, docs[0][1]), (1001, docs[1][1] + " end"), (1002, bench), (1003, say(40) + " password=abcdef0123456789 x"), (1004, None), (1005, ""), (None, say(30))]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {i for i in range(300) if i % 5 == 4}
    assert len(toxic & set(kept[0])) <= 3 and len(set(range(300)) - toxic - set(kept[0])) <= 5
    assert set(kept[0]) - set(kept[1]) == {i for i, of in ((1000, 0), (1001, 1)) if i in kept[0] and of in kept[0]}
    assert set(kept[1]) - set(kept[2]) == {1002} & set(kept[1])
    assert set(kept[3]) == set(kept[2]) and {None, 1004, 1005} <= set(kept[3])
    assert kept[3][1003].endswith(" [secret] x") and kept[3][1004] is None
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(kept[3]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
