"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Texts are dealt into chunks of bounded size. Each chunk sends every distinct window hash once to the bucket
of that hash (so a window that a third of all texts hold arrives once a chunk, not once a text); a bucket
counts in how many chunks a hash occurs and names to each chunk the ones that others hold too. The chunk then
knows every repeated window, its own repetitions included, and merges them into maximal removal intervals.
A window is known by its 64-bit hash and by the bucket, which an independent hash picks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import blob, text_bytes, unblob
from plumbline.llm._text import WORD_BASE, WORD_BASE_2, Words, covered, rolling, runs, slices, window_starts

CHUNK_BYTES = 16 << 20
BUCKET_WINDOWS = 2 << 20
SCHEMA = "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _windows(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    column, parts, others = column.combine_chunks(), [], []
    for lo, hi in slices(column):
        words = Words(column.slice(lo, hi - lo))
        starts, h = window_starts(words.first, n), words.hashes()
        if len(starts):
            parts.append(rolling(h, n, WORD_BASE)[starts])
            others.append(rolling(h, n, WORD_BASE_2)[starts])
    none = np.zeros(0, np.uint64)
    return np.concatenate(parts or [none]), np.concatenate(others or [none])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word that a repeated window of so many words covers.

    Returns one row per input row: id, n_words, n_removed, removed (maximal runs of removed words as
    [start, end) word positions) and kept_text (kept words joined by one space).

    Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words and an
    empty kept_text. A text shorter than the window keeps all. Rows that repeat (same id, same text) count as
    occurrences of their own, as do overlapping occurrences in one text. Null ids stay null. Other columns are
    not read. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(docs, "text")
    chunks, buckets = max(1, math.ceil(size / CHUNK_BYTES)), max(1, math.ceil(size / 6 / BUCKET_WINDOWS))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        h, other = _windows(table["text"], window)
        h, at = np.unique(h, return_index=True)
        bucket = (other[at] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, ends = h[order], np.cumsum(np.bincount(bucket, minlength=buckets))
        full = np.flatnonzero(np.diff(ends, prepend=0))
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "hashes": pa.array([blob(x) for x in np.split(h, ends[:-1]) if len(x)], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        sent = unblob(table["hashes"])
        every = np.sort(np.concatenate(sent))
        repeated = every[1:][every[1:] == every[:-1]]
        back = [x[np.isin(x, repeated, assume_unique=False, kind="sort")] for x in sent] if len(repeated) else []
        keep = [i for i, x in enumerate(back) if len(x)]
        return pa.table({"chunk": table["chunk"].combine_chunks().take(pa.array(keep, pa.int32())), "hashes": pa.array([blob(back[i]) for i in keep], pa.binary())})

    def remove(texts: pa.Table, elsewhere: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in OUT.items()})
        h, _ = _windows(texts["text"], window)
        ordered = np.sort(h)
        known = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *unblob(elsewhere["hashes"])]))
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        repeated = known[at] == h if len(known) else np.zeros(len(h), bool)
        column, used, out = texts["text"].combine_chunks(), 0, {n: [] for n in OUT}
        for lo, hi in slices(column):
            part = column.slice(lo, hi - lo)
            words = Words(part)
            starts = window_starts(words.first, window)
            gone = covered(len(words), starts[repeated[used : used + len(starts)]], window)
            used += len(starts)
            begin, end = runs(gone, words.first) if len(gone) else (np.zeros(0, np.int64),) * 2
            cut = np.searchsorted(begin, words.first)
            raw, stay = words.data.tobytes(), ~gone
            for d in range(hi - lo):
                a, b = int(words.first[d]), int(words.first[d + 1])
                all_words = raw[words.offsets[d] : words.offsets[d + 1]].split()
                if cut[d] < cut[d + 1]:
                    all_words = [w for w, s in zip(all_words, stay[a:b].tolist(), strict=True) if s]
                out["n_words"].append(b - a)
                out["n_removed"].append(b - a - len(all_words))
                out["removed"].append([{"start": x - a, "end": y - a} for x, y in zip(begin[cut[d] : cut[d + 1]].tolist(), end[cut[d] : cut[d + 1]].tolist(), strict=True)])
                out["kept_text"].append(b" ".join(all_words).decode())
        return pa.table({"id": texts["id"].combine_chunks(), **{n: pa.array(v, OUT[n]) for n, v in out.items() if n != "id"}})

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary")
    back = sent.groupBy("bucket").applyInArrow(count, "chunk int, hashes binary")
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(remove, SCHEMA)


OUT = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept_text": pa.string()}


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 35 words over the whole of documents."""
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
