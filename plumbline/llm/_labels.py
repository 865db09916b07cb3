"""Labelled training rows, of a bounded number and size, that leave out the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training texts: bytes of the longest that is chosen, and of all of them. Texts are never cut.
TEXT_BYTES, TRAIN_BYTES = 1 << 20, 48 << 20


def held_out(id_column):
    """A fifth of all ids: CRC-32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, each: int, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT_BYTES, train_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """At most `each` whole texts of either class, those whose id hashes lowest, none of them held out.

    Rows without a text or label don't count; of several labels of one id the largest does, and of several texts
    the largest. Texts of more than text_bytes aren't chosen, nor those that would bring a class to more than half
    of train_bytes.
    """
    key = F.col(id_col)
    known = labels.where(key.isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key.cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("id"), F.col("id")
    chosen = [known.where(F.col("label") == c).orderBy(*order).limit(each) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(key.cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= text_bytes)
    # At most 2 * each ids of 12 bytes are broadcast; their rows, as many at most but for repeats, are what follows.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(*order))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= train_bytes // 2).select("id", "label", "text")
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: r.id)]
