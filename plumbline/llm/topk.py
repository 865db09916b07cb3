"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments. Two codes at Hamming distance d agree in some segment up to d // m bits.
So all codes whose segment s is within radius r of the query's, for s below j, and within r - 1 for the others,
include every code at distance m * r + j - 1 or less. Codes lie in index blocks of bounded size; a block has a
table for each segment (m grows as the block shrinks: a segment is about as wide as the logarithm of the block),
and a query probes the tables at growing radii, one segment after another, until its kth verified distance is
covered, without a limit. A candidate is verified where it is found, once: in the first table that gives it.

Each block answers with a query's k nearest of its own at most, and what a bounded sample of the codes shows to be
out of reach isn't looked for: the sample's kth distance bounds the kth distance. Queries come in blocks of
bounded size, each a broadcast and a pass over the index. Equal codes are one entry with its least ids, so a code
that a third of all vectors share is one candidate.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import Tables

BITS = 64
#: Codes of an index block, queries of a pass, queries that are searched for at once, and codes of the sample.
BLOCK, PASS, TOGETHER, SAMPLE = 1 << 17, 1 << 16, 128, 1 << 13
ANSWER = "asked long, best array<struct<distance:int,id:long>>"


def sign_code(vector: Column) -> Column:
    """64 bits: whether each of the first 64 components is above 0; null for shorter vectors."""
    bits = F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.when(F.size(vector) >= 64, bits)


def masks(width: int, radius: int) -> np.ndarray:
    """All values of so many bits with radius of them set."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.int64)


class Index:
    """A block's codes, with a table for each segment: the codes by the segment's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.view(np.uint64)
        self.m = min(16, max(1, round(BITS / max(4, math.log2(max(2, len(codes)))))))
        cuts = np.linspace(0, BITS, self.m + 1).astype(int)
        self.low, self.width = cuts[:-1], np.diff(cuts)
        self.order, self.first = [], []
        for s in range(self.m):
            value = self.segment(self.codes, s)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.first.append(np.searchsorted(value[order], np.arange((1 << self.width[s]) + 1)))

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(self.low[s])) & np.uint64((1 << int(self.width[s])) - 1)).astype(np.int64)

    def search(self, asked: np.ndarray, many: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, code numbers and distances of all codes within each query's bound or kth distance, whichever is less.

        many: ids of each code. The radius grows until that distance is covered.
        """
        asked, bound = asked.view(np.uint64), bound.astype(np.int64)
        seen = np.zeros((len(asked), BITS + 1), np.int64)
        active, found = np.arange(len(asked)), []
        for radius in range(int(self.width.max()) + 1):
            for s in range(self.m):
                if radius <= self.width[s]:
                    flips = masks(int(self.width[s]), radius)
                    value = (self.segment(asked[active], s)[:, None] ^ flips[None, :]).ravel()
                    low, high = self.first[s][value], self.first[s][value + 1]
                    size = high - low
                    query = np.repeat(np.repeat(active, len(flips)), size)
                    place = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
                    code = self.order[s][place]
                    apart = self.codes[code] ^ asked[query]
                    fresh = np.ones(len(code), bool)
                    for t in range(self.m):
                        if t != s:  # where another table gave the code before
                            fresh &= np.bitwise_count(self.segment(apart, t)) >= radius + (t < s)
                    query, code, distance = query[fresh], code[fresh], np.bitwise_count(apart[fresh]).astype(np.int64)
                    near = distance <= bound[query]
                    query, code, distance = query[near], code[near], distance[near]
                    np.add.at(seen, (query, distance), many[code])
                    found.append((query, code, distance))
                    reached = np.cumsum(seen[active], 1) >= k
                    kth = np.where(reached.any(1), reached.argmax(1), BITS)
                    bound[active] = np.minimum(bound[active], kth)
                active = active[bound[active] > self.m * radius + s]
                if not len(active):
                    break
            if not len(active):
                break
        query, code, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        near = distance <= bound[query]
        return query[near], code[near], distance[near]


def _answers(codes: np.ndarray, ids: np.ndarray, first: np.ndarray, queries: tuple[np.ndarray, np.ndarray], k: int):
    """Batches of each query's least (distance, id), k at most, of the ids first[c] to first[c + 1] of each code c."""
    index, many = Index(codes), np.diff(first)
    for at in range(0, len(queries[0]), TOGETHER):
        asked = queries[0][at : at + TOGETHER]
        query, code, distance = index.search(asked, many, k, queries[1][at : at + TOGETHER])
        size = many[code]
        place = np.arange(int(size.sum())) + np.repeat(first[code] - (np.cumsum(size) - size), size)
        query, distance, named = np.repeat(query, size), np.repeat(distance, size), ids[place]
        order = np.lexsort((named, distance, query))
        query, distance, named = query[order], distance[order], named[order]
        begin = np.searchsorted(query, np.arange(len(asked) + 1))
        keep = np.arange(len(query)) - begin[query] < k
        query, distance, named = query[keep], distance[keep], named[keep]
        own = np.unique(query)
        ends = pa.array(np.append(np.searchsorted(query, own), len(query)), pa.int32())
        best = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(distance, pa.int32()), pa.array(named, pa.int64())], names=["distance", "id"]))
        yield pa.RecordBatch.from_arrays([pa.array(asked[own]), best], names=["asked", "best"])


def _block(entries: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = pa.concat_arrays([b.column("ids") for b in entries])
    return np.concatenate([b.column("code").to_numpy() for b in entries]), lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def search(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code", every: int = 100) -> DataFrame:
    """The k nearest of all other rows, for each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), neighbour_id and distance, ties by the lower id. Rows with a null id or code
    neither ask nor answer; a repeated id with one code counts once, one with several codes answers with each.
    With k or fewer other rows all are given; an empty table gives an empty one. Other columns are not read.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).dropna().distinct()
    # Of equal codes only the k + 1 least ids can be among anyone's k nearest. Ranked in two steps: no task gets a code's every row.
    least = lambda ids: F.slice(F.array_sort(ids), 1, k + 1).alias("ids")
    ranked = rows.groupBy("code", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(least(F.collect_list("id")))
    entries = ranked.groupBy("code").agg(least(F.flatten(F.collect_list("ids"))))
    entries = tables.put(entries.repartition(spark.sparkContext.defaultParallelism, "code"), "entries")
    queries = rows.where(F.col("id") % every == 0)
    asked = tables.put(queries.select(F.col("code").alias("asked")).distinct(), "asked")
    total, wanted = entries.count(), asked.count()
    passes, sampled = max(1, -(-wanted // PASS)), max(1, total // SAMPLE)
    sample = entries.where(F.pmod(F.xxhash64(F.col("code") + 1), F.lit(sampled)) == 0).coalesce(1)
    found = None
    for number in range(passes):
        some = asked.where(F.pmod(F.xxhash64("asked"), F.lit(passes)) == number).select("asked").toArrow()["asked"].to_numpy()
        every_bound = np.full(len(some), BITS, np.int64)
        if sampled > 1:  # about SAMPLE codes show how far the kth neighbour can be
            first = spark.sparkContext.broadcast((some, every_bound))
            known = {r.asked: r.far for r in sample.mapInArrow(_pass(first, k), ANSWER).where(F.size("best") > k).select("asked", F.element_at("best", -1)["distance"].alias("far")).collect()}
            every_bound = np.array([known.get(c, BITS) for c in some.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((some, every_bound))
        new = tables.put(entries.mapInArrow(_pass(shared, k), ANSWER), f"answers-{number}")
        found = new if found is None else found.unionByName(new)
    best = found.groupBy("asked").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    answers = queries.join(best, F.col("code") == F.col("asked")).select("id", F.posexplode(own).alias("rank", "x"))
    return answers.select(F.col("id").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), "x.distance")


def _pass(queries, k: int):
    """Blocks of the index are built from the entries as they come, and searched; k + 1, as a query finds itself."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    yield from _answers(*_block(held), queries.value, k + 1)
                    held, size = [], 0
        if size:
            yield from _answers(*_block(held), queries.value, k + 1)

    return run


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes of the whole of embeddings, for ids divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return search(vectors)


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 64),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, hamming(q.bits, v.bits) AS distance FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, neighbour_id, distance::INTEGER AS distance FROM r WHERE rank <= 10
"""
