"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of 13 benchmark words (a shorter item as a whole) is a test string: its words between single
spaces. Texts are brought to the same form and searched in many lanes at once. In each lane the block of
bytes at the end of the current position is looked up in the shift table and the lane skips ahead by the
shift; at shift 0 the block's hash picks a bucket of test strings, whose first bytes are compared, and then
all of them. Test strings are grouped by length, as the shortest bounds the shifts.

A benchmark beyond BLOCK_BYTES is searched for in parts of about that size, one pass over the texts each, with a
written table between passes: what a stage broadcasts and holds stays bounded however large the benchmark grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.llm._spark import Tables, release, small_batches
from plumbline.llm._text import ALNUM, Words, covered, runs, slices

BLOCK_BYTES = 8 << 20
#: Bytes of text that are searched at once.
SLICE = 1 << 20
LANE = 2048
BITS = 18
LENGTHS = (3, 6, 12, 24, 48)
HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of ' w1 w2 ... wn \\n' for each text; where each word begins in it; where each text begins and ends."""
    lengths, docs = words.ends - words.starts, len(words.first) - 1
    d = np.repeat(np.arange(docs), np.diff(words.first))
    before = np.cumsum(lengths) - lengths
    begin = before + np.arange(len(lengths)) + 2 * d + 1
    total = int(lengths.sum()) + len(lengths) + 2 * docs
    out = np.full(total + 8, 32, np.uint8)
    step = np.arange(int(lengths.sum()))
    out[np.repeat(begin - before, lengths) + step] = words.data[np.repeat(words.starts - before, lengths) + step]
    upto = np.concatenate([[0], np.cumsum(lengths)])[words.first] + words.first + 2 * np.arange(docs + 1)
    out[upto[1:] - 1] = 10
    return out, begin, upto


class Patterns:
    """Shift table and suffix-hash buckets of test strings of similar length."""

    def __init__(self, strings: list[bytes]):
        self.m = min(map(len, strings))
        self.b = min(4, self.m)
        self.mask = np.uint32((1 << 8 * self.b) - 1)
        heads = np.frombuffer(b"".join(s[: self.m] + b"\0" * 4 for s in strings), np.uint8).reshape(len(strings), -1)
        self.shift = np.full(1 << BITS, self.m - self.b + 1, np.int32)
        for j in range(self.m - self.b + 1):
            keys = self.key(np.ascontiguousarray(heads[:, j : j + 4]).view("<u4")[:, 0])
            np.minimum.at(self.shift, keys, self.m - self.b - j)
        order = np.argsort(keys, kind="stable")
        self.strings = [strings[i] for i in order]
        self.order = order
        self.low = np.searchsorted(keys[order], np.arange((1 << BITS) + 1))
        self.first = np.ascontiguousarray(heads[order, :4]).view("<u4")[:, 0] & self.mask

    def key(self, block: np.ndarray) -> np.ndarray:
        return ((block & self.mask) * np.uint32(2654435761)) >> np.uint32(32 - BITS)

    def search(self, text: np.ndarray, upto: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions of the space before each occurrence, and the numbers of the strings that occur there."""
        blocks = np.ndarray(len(text) - 3, "<u4", text, strides=(1,))
        begin = upto[:-1] + self.m - 1
        lanes = np.maximum(0, -(-(upto[1:] - begin) // LANE))
        within = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + within * LANE
        end = np.minimum(at + LANE, np.repeat(upto[1:], lanes))
        found, raw, places, which = [], text.tobytes(), [], []
        while len(at):
            key = self.key(blocks[at - self.b + 1])
            shift = self.shift[key]
            if (zero := shift == 0).any():
                found.append((at[zero], key[zero]))
            at = at + np.maximum(shift, 1)
            more = at < end
            if not more.all():
                at, end = at[more], end[more]
        for at, key in found:
            low, many = self.low[key], self.low[key + 1] - self.low[key]
            place = np.repeat(at - self.m + 1, many)
            string = np.arange(len(place)) + np.repeat(low - (np.cumsum(many) - many), many)
            same = (blocks[place] & self.mask) == self.first[string]
            for p, s in zip(place[same].tolist(), string[same].tolist(), strict=True):
                if raw.startswith(self.strings[s], p):
                    places.append(p)
                    which.append(int(self.order[s]))
        return places, which


class Searcher:
    def __init__(self, groups: list[tuple[dict, list[int], list[set]]]):
        """groups: the fields of Patterns, the words of each string, and the items that hold it."""
        self.groups = []
        for fields, sizes, who in groups:
            patterns = Patterns.__new__(Patterns)
            patterns.__dict__.update(fields)
            self.groups.append((patterns, sizes, who))

    @staticmethod
    def groups_of(items: list[tuple[str | None, str | None]], window: int) -> list[tuple[dict, list[int], list[set]]]:
        """As plain data, which executors can read that don't know this package's classes."""
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        owners: dict[bytes, set] = {}
        raw = words.data.tobytes()
        for i, (item, _) in enumerate(items):
            a, b = words.first[i], words.first[i + 1]
            w = [raw[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
            for j in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(b" " + b" ".join(w[j : j + window]) + b" ", set()).add(item)
        groups = []
        for low, high in zip(LENGTHS, (*LENGTHS[1:], math.inf), strict=True):
            if strings := sorted(s for s in owners if low <= len(s) < high):
                groups.append((vars(Patterns(strings)), [s.count(b" ") - 1 for s in strings], [owners[s] - {None} for s in strings]))
        return groups

    def __call__(self, column: pa.Array, before: tuple[list, list] | None = None) -> list[pa.Array]:
        """Word counts, runs of hit words and items of each text, with those that earlier passes found."""
        counts, hits, items = [], [], []
        for lo, hi in slices(column, SLICE):
            words = Words(column.slice(lo, hi - lo), ALNUM, lower=True)
            text, begin, upto = spaced(words)
            starts, lengths, owners = [], [], [None] * (hi - lo)
            for patterns, sizes, who in self.groups:
                places, which = patterns.search(text, upto)
                if places:
                    word = np.searchsorted(begin, np.array(places) + 1)
                    starts.append(word)
                    lengths.append(np.array([sizes[s] for s in which]))
                    for d, s in zip((np.searchsorted(words.first, word, "right") - 1).tolist(), which, strict=True):
                        if owners[d] is None or not who[s] <= owners[d]:
                            owners[d] = (owners[d] or set()) | who[s]
            for d in range(hi - lo) if before else ():
                owners[d] = (owners[d] or set()) | set(before[1][lo + d])
                for x in before[0][lo + d]:
                    starts.append(np.array([words.first[d] + x["start"]]))
                    lengths.append(np.array([x["end"] - x["start"]]))
            flags = covered(len(words), np.concatenate(starts), np.concatenate(lengths)) if starts else np.zeros(len(words), bool)
            first, last = runs(flags, words.first) if len(flags) else (np.zeros(0, np.int64),) * 2
            cut = np.searchsorted(first, words.first)
            counts += np.diff(words.first).tolist()
            hits += [[{"start": int(x - words.first[d]), "end": int(y - words.first[d])} for x, y in zip(first[cut[d] : cut[d + 1]], last[cut[d] : cut[d + 1]], strict=True)] for d in range(hi - lo)]
            items += [sorted(x) if x else [] for x in owners]
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Find benchmark windows in texts.

    Returns, for each row of docs, `row` (a struct of the kept columns, all by default), n_words, hits
    (maximal runs of hit words as [start, end) word positions), items (ids, as sorted strings, of the items
    with a window in the text), n_hit, and contaminated: some word is hit and share * n_hit >= n_words.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Null and empty texts have
    no words and are not contaminated. Items without words have no window; an item with a null id hits words but
    is not listed; repeated items are listed once. With an empty benchmark nothing is hit.
    """
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(size / BLOCK_BYTES))
    held = F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    found = docs.select(held.alias("row"), docs[text_col].cast("string").alias("text"))
    row = found.schema["row"]
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession, "decontamination")
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher.groups_of([tuple(r) for r in some.collect()], window))
        last = part == parts - 1
        schema = StructType([row, *([] if last else [StructField("text", StringType())]), *StructType.fromDDL(HITS).fields])
        found = found.mapInArrow(_pass(searcher, part == 0, schema.names), schema)
        found = found if last else tables.put(found, "pass")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _pass(searcher, first: bool, names: list[str]):
    def run(batches):
        search = Searcher(searcher.value)
        for batch in batches:
            before = None if first else (batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            release()
            made = dict(zip(("n_words", "hits", "items"), search(batch.column("text"), before), strict=True))
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words of benchmark in the whole of documents."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
