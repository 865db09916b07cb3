"""A training corpus from documents: toxic, near-duplicate and contaminated texts go, secrets are masked, tokens made."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontamination, jaccard_join, secret_scan, toxicity
from plumbline.llm._spark import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labels of documents of this input, doesn't call toxic."""
    found = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where("predicted = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts, the document with the smallest doc_id; null ids and texts without words stay.

    Rows that share a doc_id are judged each by its text; of rows that share both one stays.
    """
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows don't make up a twentieth or more."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret in a text becomes [secret], and n_chars is the new length. A null text stays null."""
    found = secret_scan.scan(docs)
    text = F.when(F.col("row")["text"].isNotNull(), secret_scan.redact(F.col("text"), F.col("spans")))
    changed = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.encode_and_decode(docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), ranks, public_tokenizers.PATTERN, keep=["doc_id", "sha"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("row.sha")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
