"""Passages shared with texts that have identical copies."""

from plumbline.operators import text as T
from plumbline.plans.corpus import shingle_df

PASSAGE = " ".join(f"word{i}" for i in range(20))  # 13 shingles


def test_copies_count_as_one_text(spark):
    docs = spark.createDataFrame([(1, f"before {PASSAGE} after"), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([(i, PASSAGE.upper() if i % 2 else PASSAGE) for i in range(6)] + [(9, None), (10, "short")], "item_id long, text string")
    found = T.shared_passages(docs, "doc_id", items, "item_id").collect()
    assert sorted((r.doc_id, r.item_id, r.shared) for r in found) == [(1, i, 13) for i in range(6)]


def test_boilerplate_of_distinct_texts_goes(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    for n in (3, 4):
        items = spark.createDataFrame([(i, f"{PASSAGE} end{i}") for i in range(n)] * 2, "item_id long, text string")
        assert T.shared_passages(docs, "doc_id", items, "item_id").count() == (3 if n == 3 else 0)


def test_shingle_df_counts_distinct_texts(spark, tmp_path):
    rows = [(i, PASSAGE) for i in range(5)] + [(5, f"{PASSAGE} end")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, shingle_df(spark, str(tmp_path)).collect())) == [(1, 1), (2, 13)]
