"""N-gram Jaccard join by universe partition, one-deletion neighbourhoods and cost-based allocation.

Texts are sets of hashed word shingles; equal sets are one node. Sets are dealt into bands by size, so that
similar sets lie in one band or in neighbouring ones. In band k the universe of shingles is split by hash into m
segments. Sets of similarity 4/5 and sizes a and b differ in at most (a + b) / 9 shingles, so however a set
allots more units than that to its segments, some segment differs in fewer shingles than it was allotted: with
one unit it is equal, with two (offered by every eighth segment) it differs by one deletion at most. Every set is
indexed under all its segments and the one-deletion neighbourhoods of those that offer two units; as a probe, it
allots its units where a sketch, which counts the index entries of all sets, promises the fewest candidates.

Entries travel as arrays, by the bucket of their signature; a signature that the sketch finds in very many sets
is dealt over several buckets, to each of which a few sets, the same ones, go. A bucket pairs all entries of a
signature that few sets share; of one that many share it pairs each set with a hub, and lists the members. Pairs
are verified exactly, and linked sets merge into components. Listed signatures whose members are then still in
different components go into another round: their members alone, under another partition of the universe, and
with a larger limit of what is paired in full. Two sets that link share a signature in every round until they are
in one component, so no link is lost, a group of copies costs its size and not its square, and only sets that stay
together under several independent partitions are all compared.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import Tables, annotate, blob, release, text_bytes, unblob
from plumbline.llm._text import Words, mix, rolling, slices, window_starts
from plumbline.operators.components import components

U = np.uint64
SKETCH = 1 << 18
CHUNK_BYTES = 1 << 20
BUCKET_ENTRIES = 1 << 21
#: Entries of a bucket that are paired at once, and pairs after which repeats are dropped.
PART_ENTRIES, PART_PAIRS = 1 << 18, 1 << 18
#: Sets that are compared in one task, by their size.
BLOCK_BYTES = 32 << 20
#: Entries of a signature that are all paired at once in the first round; the limit grows from round to round.
SMALL, GROWTH = 16, 8
#: Entries of a signature beyond which it is dealt over several buckets, and how many sets go to each of these.
SPLIT, HUBS = 1 << 16, 2
#: A task's memory of the sets that it has sent.
SENT = 1 << 20
#: Buckets of the broadcast that texts are filtered by: its bound.
FILTER = 1 << 20
INDEX, INDEX_DELETED, PROBE, PROBE_DELETED = 1, 2, 4, 8
LOW = U((1 << 32) - 1)

_bands: list[tuple[int, int]] = [(1, 1)]


def bands(size: int) -> int:
    """Number of the band of sets of a size. A band's upper size is at most 5/4 of its lower one."""
    while _bands[-1][1] < size:
        low = _bands[-1][1] + 1
        _bands.append((low, max(low, 5 * low // 4)))
    return bisect.bisect_right(_bands, (size, math.inf)) - 1


def shape(band: int) -> tuple[int, int]:
    """Segments of a band, and how many of them offer two units."""
    most = _bands[band][1] // 4
    m = most + 1 + math.ceil(0.15 * most)
    return m, math.ceil(m / 8)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of a shorter text, of all its words."""
    out = []
    for lo, hi in slices(column, 1 << 20):
        words = Words(column.slice(lo, hi - lo), lower=True)
        h = words.hashes()
        full, at = rolling(h, n), window_starts(words.first, n)
        cut = np.searchsorted(at, words.first)
        for d in range(hi - lo):
            a, b = words.first[d], words.first[d + 1]
            out.append(np.unique(full[at[cut[d] : cut[d + 1]]]) if b - a >= n else rolling(h[a:b], int(b - a)) if b > a else np.zeros(0, U))
    return out


def set_key(tokens: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return int(mix(mix(tokens).sum(dtype=U)[None] + U(len(tokens)))[0].view(np.int64))


def partition(tokens: np.ndarray, band: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    m, _ = shape(band)
    own = U(band * 2 + 1) ^ U(seed * 0x9E3779B97F4A7C15 % 2**64)
    seg = (mix(tokens + own) % U(m)).astype(np.int64)
    value = mix(tokens ^ U(0x2545F4914F6CDD1D))
    order = np.argsort(seg, kind="stable")
    total = np.concatenate([np.zeros(1, U), np.cumsum(value[order], dtype=U)])
    sums = np.diff(total[np.searchsorted(seg[order], np.arange(m + 1))])
    salt = mix(np.arange(m, dtype=U) + (U(band << 32) ^ own))
    return seg, value, sums, salt, mix(sums ^ salt)


def entries(tokens: np.ndarray, sketch: np.ndarray, seed: int = 0, noise: float = 0.0) -> np.ndarray:
    """Signatures of a set, with their roles in the four low bits.

    noise: what a slot of the sketch can be off by. Deletions, of which each is one more entry to send, are
    taken where they save more than that.
    """
    n, out = len(tokens), []
    k = bands(n)
    for band, own in ((k, True), (k - 1, False)) if k else ((k, True),):
        m, two = shape(band)
        units = (2 * n if own else _bands[band][1] + n) // 9 + 1
        seg, value, sums, salt, exact = partition(tokens, band, seed)
        cost = sketch[slot(exact)].astype(float)
        near = np.flatnonzero(seg < two)
        deleted = mix((sums[seg[near]] - value[near]) ^ salt[seg[near]])
        more = np.bincount(seg[near], np.maximum(sketch[slot(deleted)] - noise, 0) + 1, two) + 1 + noise
        chosen = np.argsort(np.concatenate([cost, np.maximum(more, cost[:two]) + 0.5]), kind="stable")[:units]
        allotted = np.zeros(m, np.int64)
        np.add.at(allotted, np.where(chosen < m, chosen, chosen - m), 1)
        roles = INDEX * own + PROBE * (allotted > 0) + PROBE_DELETED * (allotted > 1)
        both = [(exact, roles), (deleted, INDEX_DELETED * own + PROBE * (allotted[seg[near]] > 1))]
        for sig, role in both:
            out.append((sig & ~U(15) | role.astype(U))[role > 0])
    return np.concatenate(out)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether entries with these roles are to be paired."""
    one = ((x & PROBE > 0) & (y & INDEX > 0)) | ((x & PROBE_DELETED > 0) & (y & INDEX_DELETED > 0))
    other = ((y & PROBE > 0) & (x & INDEX > 0)) | ((y & PROBE_DELETED > 0) & (x & INDEX_DELETED > 0))
    return one | other


def pair_up(sig: np.ndarray, nodes: np.ndarray, groups: np.ndarray, small: int, split: np.ndarray, told: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes to verify, and the numbers of the entries of large signatures.

    Nodes of one group (the component that they are known to be in) aren't paired. A signature that at most
    `small` sets probe (or are indexed under) is paired in full, which costs its size at most so often; another
    is large. Its hubs are the nodes of the least hashes, which are the same in every bucket that the signature
    is dealt over. split: whether an entry's signature is dealt over several buckets, and so counts as large
    whatever is here of it. told: tallies, sizes of sets, and which of these an entry has; nodes that these
    tell apart aren't paired.
    """
    order = np.lexsort((mix(nodes.view(U)), sig >> U(4)))
    sig, nodes, groups, split = sig[order], nodes[order], groups[order], split[order]
    role, key = (sig & U(15)).astype(np.uint8), sig >> U(4)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    pairs, large, held, most = [], [], 0, PART_PAIRS
    whole = ~split[begin]
    vectorised = min(small, 6) if told is None else 1
    for s in range(2, vectorised + 1):
        rows = begin[(size == s) & whole][:, None] + np.arange(s)
        for i, j in itertools.combinations(range(s), 2):
            a, b = rows[:, i], rows[:, j]
            ok = joined(role[a], role[b]) & (groups[a] != groups[b])
            pairs.append(np.stack([nodes[a[ok]], nodes[b[ok]]], 1))
    others = (size > vectorised) | ~whole
    for b, s, w in zip(begin[others].tolist(), size[others].tolist(), whole[others].tolist(), strict=True):
        every = np.arange(b, b + s)
        for index, probe in ((INDEX, PROBE), (INDEX_DELETED, PROBE_DELETED)):
            x, y = every[role[every] & index > 0], every[role[every] & probe > 0]
            if len(x) > len(y):
                x, y = y, x
            if w and not len(x):
                continue
            full = w and len(x) <= small
            if not full:
                large.append(order[np.union1d(x, y)])
            for few, many in ((x, y),) if full else ((x, y), (y, x)):
                # All of them, or hubs: the first nodes of some groups, in the order of their hashes.
                few = few if full else few[np.sort(np.unique(groups[few], return_index=True)[1])[:HUBS]]
                near = _compared(few, many, order, told) if told is not None and len(few) and len(many) else None
                for k, i in enumerate(few.tolist()):
                    z = many[(groups[many] != groups[i]) & (near(k) if near else True)]
                    pairs.append(np.stack([np.full(len(z), nodes[i]), nodes[z]], 1))
                    held += len(z)
                    if held > most:  # sets that are alike share many signatures
                        pairs = [distinct(pairs)]
                        held, most = len(pairs[0]), max(PART_PAIRS, 2 * len(pairs[0]))
    return distinct(pairs), np.concatenate(large) if large else np.zeros(0, np.int64)


def distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """The pairs of all arrays, each once, the lesser node first; in order."""
    if not sum(map(len, pairs)):
        return np.zeros((0, 2), np.int64)
    found = np.concatenate(pairs)
    found.sort(axis=1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[np.append(True, (found[1:] != found[:-1]).any(1))]


def pair_bucket(table: pa.Table, later: bool, small: int, sketch: np.ndarray, limit: int) -> pa.Table:
    """Rows a, b, sig of a bucket: its pairs, and the members of large signatures.

    Signatures are dealt into parts of about PART_ENTRIES entries, and one part after the other is paired. Until
    then an entry is its signature and the number of its set among those that the bucket names.
    """
    counts, sigs = unblob(table["counts"], np.uint8), unblob(table["sigs"], np.uint32)
    each = np.concatenate(counts)
    number = np.repeat(np.arange(len(each), dtype=np.int32), each)
    sig, part, at = np.empty(len(number), U), np.empty(len(number), np.uint8), 0
    parts = min(256, 1 << max(0, math.ceil(math.log2(max(1, len(number)) / PART_ENTRIES))))
    for h, x in zip(table["home"].to_pylist(), sigs, strict=True):
        sig[at : at + len(x)] = U(h << 32) | x.astype(U)
        part[at : at + len(x)] = (x >> np.uint32(4)) & np.uint32(parts - 1)
        at += len(x)
    nodes = np.concatenate(unblob(table["nodes"], np.int64))
    groups = np.concatenate(unblob(table["groups"], np.int64)) if later else nodes
    tallies, sizes = [], None
    if later:
        for t, n in zip(unblob(table["tallies"], np.uint8), unblob(table["sizes"], np.int32), strict=True):
            tallies += np.split(t, np.cumsum(_tally_size(n))[:-1])
        sizes = np.concatenate(unblob(table["sizes"], np.int32)).astype(np.int64)
    pairs, members, listed = [], [], []
    for p in np.flatnonzero(np.bincount(part)).tolist():
        of = np.flatnonzero(part == p)
        own, who = sig[of], number[of]
        told = (tallies, sizes, who) if later else None
        found, large = pair_up(own, nodes[who], groups[who], small, sketch[slot(own)] > limit, told)
        pairs.append(found)
        members.append(nodes[who[large]])
        listed.append((own[large] >> U(4)).view(np.int64))
    found, members, listed = distinct(pairs), np.concatenate(members), np.concatenate(listed)
    return pa.table({
        "a": pa.concat_arrays([pa.array(found[:, 0]), pa.array(members)]), "b": pa.concat_arrays([pa.array(found[:, 1]), pa.nulls(len(members), pa.int64())]),
        "sig": pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(listed)]),
    })


def _compared(few: np.ndarray, many: np.ndarray, order: np.ndarray, told: tuple):
    """For each of few, which of many can be similar by their tallies."""
    tallies, sizes, number = told
    x, y = number[order[few]], number[order[many]]
    least = min(512, min(len(tallies[i]) for i in x.tolist()), min(len(tallies[i]) for i in y.tolist()))
    fold = lambda at: np.stack([np.minimum(tallies[i].reshape(-1, least).sum(0, dtype=np.int32), 255).astype(np.uint8) for i in at.tolist()])
    left, right = fold(x).astype(np.int16), fold(y)

    def near(k: int) -> np.ndarray:
        apart = [np.abs(right[i : i + 4096] - left[k]).sum(1, dtype=np.int64) for i in range(0, len(right), 4096)]
        alike = 5 * np.minimum(sizes[x[k]], sizes[y]) >= 4 * np.maximum(sizes[x[k]], sizes[y])
        return (9 * np.concatenate(apart) <= sizes[x[k]] + sizes[y]) & alike

    return near


def slot(sig: np.ndarray) -> np.ndarray:
    return ((sig >> U(4)) % U(SKETCH)).astype(np.int64)


def dealt(sig: np.ndarray, node: np.ndarray, sketch: np.ndarray, buckets: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry that is sent: its number, its signature's home and the bucket it goes to; they differ only where a signature is split."""
    home = ((sig >> U(32)) % U(buckets)).astype(np.int64)
    at, bucket = np.arange(len(sig)), home.copy()
    many = sketch[slot(sig)]
    for i in np.flatnonzero(many > limit).tolist():
        parts = 1 + int(many[i]) // limit
        h = int(mix(node[i : i + 1].view(U) ^ U(0xA24BAED4963EE407))[0])
        bucket[i] = (home[i] + h % parts) % buckets
        if int(mix(node[i : i + 1].view(U))[0]) < 2**64 * HUBS // int(many[i]):
            others = np.setdiff1d((home[i] + np.arange(min(parts, buckets))) % buckets, bucket[i : i + 1])
            at, bucket = np.concatenate([at, np.full(len(others), i)]), np.concatenate([bucket, others])
    return at, home[at], bucket


def _tally_size(n: np.ndarray, fine: bool = False) -> np.ndarray:
    """A power of two, from n / 8 to n / 4 (or from n / 2 to n); 64 at least."""
    return np.maximum(64, 1 << np.maximum(0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - (0 if fine else 2)))


def tally(tokens: np.ndarray, fine: bool = False) -> np.ndarray:
    """How many tokens, 255 at most, fall into each of a number of groups."""
    groups = int(_tally_size(np.array([len(tokens)]), fine)[0])
    return np.minimum(np.bincount((mix(tokens ^ U(0x1CE4E5B9BF58476D)) & U(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def can_be_similar(x: np.ndarray, y: np.ndarray, total: int) -> bool:
    """False if two sets' tallies differ by more than tokens of similar sets, total in all, can. The finer tally is folded onto the coarser."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    if len(x) != len(y):
        x, y = (np.minimum(v.reshape(-1, min(len(x), len(y))).sum(0), 255) for v in (x, y))
    return 9 * int(np.abs(x - y).sum()) <= total


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


class Join:
    """One run: the tables sets (id, n, node; one row per input row), nodes (node, n, rep, tally) and found (node, component).

    A node is a set of shingles, and rep the least id of a text that has it. Nodes without a link aren't in found.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int):
        self.spark, self.words, self.tables = docs.sparkSession, words, Tables(docs.sparkSession, "jaccard")
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.buckets = max(1, math.ceil(text_bytes(self.docs, "text") / 6 * 0.75 / BUCKET_ENTRIES))
        self._read()
        waiting, small, seed = None, SMALL, 0
        while True:
            pairs = self._pairs(waiting, seed, small)
            new = self._verified(pairs.where("b IS NOT NULL").select("a", "b").distinct(), waiting)
            if seed == 0:
                self.found = components(new, "a", "b")
            elif new.take(1):
                self._merge(new)
            waiting = self._waiting(pairs.where("b IS NULL"), waiting)
            if not waiting.take(1):
                break
            small, seed = small * GROWTH, seed + 1
        self.tables.drop("pairs", "waiting", "verified", "listed", "members", "need")

    def _merge(self, links: DataFrame) -> None:
        """Put links between nodes into found: only components that they touch are looked at."""
        at = self.found.select(F.col("node").alias("end"), F.col("component").alias("c"))
        for end in ("a", "b"):
            links = links.join(at.withColumnRenamed("end", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        over = components(links.where("a <> b"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("least"))
        known = self.found.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        alone = over.join(self.found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
        self.found = self.tables.put(known.unionByName(alone), "found")

    def _read(self) -> None:
        """One pass over the texts: sets, tallies of those that are new to a task, and counts of all index entries."""
        words = self.words

        def read(batches):
            total, known, part = np.zeros(SKETCH, np.int32), set(), _Part(words)
            for batch in batches:
                ids = batch.column("id")
                for lo, sets in part.of(batch):
                    keys, tallies = [], []
                    for i, s in enumerate(sets):
                        keys.append(set_key(s) if len(s) else None)
                        fresh = len(s) > 0 and ids[lo + i].is_valid and keys[-1] not in known
                        tallies.append(blob(tally(s)) if fresh else None)
                        if fresh:
                            known.add(keys[-1])
                            np.add.at(total, slot(partition(s, bands(len(s)))[4]), 1)
                    known = known if len(known) < SENT else set()
                    release()
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(tallies, pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
            known.clear()
            release()
            blocks = _blocks(total)
            none = [pa.nulls(blocks.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *blocks.columns], names=names)

        names = ["id", "n", "node", "tally", "block", "counts"]
        rows = self.tables.put(self.docs.mapInArrow(read, "id long, n long, node long, tally binary, block int, counts binary"), "read")

        self.sketch = self._sketch(rows.where("block IS NOT NULL").select("block", "counts"))
        self.sets = rows.where("block IS NULL").select("id", "n", "node")
        told = rows.where("node IS NOT NULL AND id IS NOT NULL")
        self.nodes = self.tables.put(told.groupBy("node").agg(F.min("n").alias("n"), F.min("id").alias("rep"), F.min("tally").alias("tally")), "nodes")

    def _sketch(self, blocks: DataFrame):
        """The tasks' counts, added up and broadcast: of fixed size, 32 blocks and 2 MB in all."""

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(SKETCH // 32, np.int64)
            for x in unblob(table["counts"], np.int32):
                total += x
            return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([blob(total)], pa.binary())})

        counted = blocks.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
        total = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(counted, key=lambda r: r.block)]) if counted else np.zeros(SKETCH, np.int64)
        # A slot's rare signatures grow in number with the input: what the median slot holds is theirs, the rest is of frequent ones.
        rare = int(np.median(total))
        return self.spark.sparkContext.broadcast((total - rare, 4 * math.sqrt(rare)))

    def _recount(self, waiting: DataFrame, seed: int):
        """The sketch of the sets of a later round, under its partition."""

        def count(batches):
            total = np.zeros(SKETCH, np.int32)
            for batch in batches:
                for s in unblob(batch.column("tokens")):
                    np.add.at(total, slot(partition(s, bands(len(s)), seed)[4]), 1)
            release()
            yield _blocks(total)

        return self._sketch(waiting.select("tokens").mapInArrow(count, "block int, counts binary"))

    def _pairs(self, waiting: DataFrame | None, seed: int, small: int) -> DataFrame:
        """Rows a, b: pairs to verify. Rows sig, a (b is null): the members of signatures that aren't paired in full.

        waiting: node, component and tokens of the sets of a later round, which come with their tallies: a bucket
        pairs only those that can be similar. The first round reads all texts.
        """
        words, limit, later = self.words, max(SPLIT, small), waiting is not None
        sketch = self._recount(waiting, seed) if later else self.sketch
        buckets = max(1, math.ceil((waiting.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0) / 8 * 0.75 / BUCKET_ENTRIES)) if later else self.buckets

        def sets_of(batch, part, known):
            """Lists of (node, component, set), of bounded size."""
            if later:
                nodes, groups, sets = batch.column("node").to_pylist(), batch.column("component").to_pylist(), unblob(batch.column("tokens"))
                ends = np.cumsum([len(x) for x in sets]) // (CHUNK_BYTES // 6)
                for c in np.unique(ends).tolist():
                    yield [(nodes[i], groups[i], sets[i]) for i in np.flatnonzero(ends == c).tolist()]
                return
            for _, sets in part.of(batch):
                fresh = []
                for s in sets:
                    if len(s) and (key := set_key(s)) not in known:
                        known.add(key)
                        fresh.append((key, key, s))
                if len(known) > SENT:
                    known.clear()
                yield fresh

        def send(batches):
            known, part = set(), _Part(words)
            for batch in batches:
                for some in sets_of(batch, part, known):
                    if some:
                        counts, noise = sketch.value
                        sigs = [entries(s, counts, seed, noise) for _, _, s in some]
                        owner = np.repeat(np.arange(len(some)), [len(x) for x in sigs])
                        tallies = [tally(s) for _, _, s in some] if later else None
                        yield _rows(np.concatenate(sigs), owner, np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.int64), np.array([len(x[2]) for x in some], np.int32), tallies, counts, buckets, limit)
            known.clear()
            release()

        def pair(table: pa.Table) -> pa.Table:
            out = pair_bucket(table, later, small, sketch.value[0], limit)
            release()
            return out

        sent = (waiting if later else self.docs.where("id IS NOT NULL")).mapInArrow(send, "bucket int, home int, nodes binary, groups binary, sizes binary, tallies binary, counts binary, sigs binary")
        return self.tables.put(sent.groupBy("bucket").applyInArrow(pair, "a long, b long, sig long"), "pairs")

    def _arrays(self, need: DataFrame) -> DataFrame:
        """The columns of need (id, node and more) with the sets, from the texts.

        The texts that aren't asked for go before any moves: by a broadcast of at most FILTER buckets of ids.
        """
        bucket = F.pmod(F.xxhash64("id"), F.lit(FILTER)).cast("int").alias("bucket")
        asked = need.select(bucket).distinct()
        texts = self.docs.withColumn("bucket", bucket).join(F.broadcast(asked), "bucket", "left_semi").drop("bucket")
        more, words = [f for f in need.schema if f.name not in ("id", "node")], self.words
        names = ["node", *[f.name for f in more], "n", "fine", "tokens"]

        def arrays(batches):
            known, part = set(), _Part(words)
            for batch in batches:
                nodes = batch.column("node").to_pylist()
                for lo, sets in part.of(batch):
                    keep = [i for i, s in enumerate(sets) if nodes[lo + i] not in known and len(s) and set_key(s) == nodes[lo + i]]
                    known.update(nodes[lo + i] for i in keep)
                    at = pa.array([lo + i for i in keep], pa.int64())
                    made = [pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([blob(tally(sets[i], True)) for i in keep], pa.binary()), pa.array([blob(sets[i]) for i in keep], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names[:-3]], *made], names=names)
            known.clear()
            release()

        fields = ", ".join(["node long", *[f"{f.name} {f.dataType.simpleString()}" for f in more]])
        return texts.join(need, "id").mapInArrow(arrays, f"{fields}, n long, fine binary, tokens binary")

    def _verified(self, pairs: DataFrame, waiting: DataFrame | None) -> DataFrame:
        """Of the pairs, those that link. Tallies rule most others out beforehand; the rest compare their sets."""

        def near(batches):
            for batch in batches:
                x, y = (unblob(batch.column(c), np.uint8) for c in ("x", "y"))
                total = (batch.column("xn").to_numpy() + batch.column("yn").to_numpy()).tolist()
                keep = pa.array([i for i in range(len(x)) if can_be_similar(x[i], y[i], total[i])], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])
            release()

        def likely(some: DataFrame, told: DataFrame) -> DataFrame:
            x, y = (told.select(F.col("node").alias(e), F.col("n").alias(c + "n"), F.col(told.columns[-1]).alias(c)) for e, c in (("a", "x"), ("b", "y")))
            like = "5 * least(xn, yn) >= 4 * greatest(xn, yn)"
            return some.join(x, "a").join(y, "b").where(like).select("a", "b", "xn", "yn", "x", "y").mapInArrow(near, "a long, b long")

        if waiting is None:
            pairs = self.tables.put(likely(pairs, self.nodes.select("node", "n", "tally")), "near")
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            need = self.tables.put(ends.join(self.nodes, "node").select(F.col("rep").alias("id"), "node", "n"), "need")
            size = 8 * (need.agg(F.sum("n")).first()[0] or 0)
        else:
            pairs = self.tables.put(likely(pairs, waiting.select("node", "n", "fine")), "close")
            size = waiting.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
        # Nodes are dealt into sides, and a pair goes to the block of its two sides, with the sets that the block's
        # pairs are of: a set travels once for each block and not once for each pair. In the first round it goes
        # there from its text.
        sides = max(6, math.ceil(2 * size / BLOCK_BYTES))
        side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
        dealt_pairs = pairs.withColumn("block", side("a") * sides + side("b"))
        ends = dealt_pairs.select("block", F.col("a").alias("node")).union(dealt_pairs.select("block", "b")).distinct()

        def link(some: pa.Table, told: pa.Table) -> pa.Table:
            known = dict(zip(told["node"].to_pylist(), unblob(told["tokens"]), strict=True)) if told.num_rows else {}
            fine = dict(zip(told["node"].to_pylist(), unblob(told["fine"], np.uint8), strict=True)) if told.num_rows else {}
            rows = zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True)
            linked = [(a, b) for a, b in rows if can_be_similar(fine[a], fine[b], len(known[a]) + len(known[b])) and similar(known[a], known[b])]
            linked = np.array(linked, np.int64).reshape(-1, 2)
            release()
            return pa.table({"a": linked[:, 0], "b": linked[:, 1]})

        if waiting is None:
            blocks = ends.groupBy("node").agg(F.collect_list("block").alias("blocks"))
            told = self._arrays(need.drop("n").join(blocks, "node")).select(F.explode("blocks").alias("of"), "node", "fine", "tokens")
        else:
            told = ends.join(waiting, "node").select(F.col("block").alias("of"), "node", "fine", "tokens")
        linked = self.tables.put(dealt_pairs.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(link, "a long, b long"), "verified")
        self.tables.drop("near", "close", "need")
        return linked

    def _waiting(self, listed: DataFrame, before: DataFrame | None) -> DataFrame:
        """node, component, n, fine tally and tokens of the members of listed signatures that hold more than one component."""
        named = self.tables.put(listed.join(self.found, listed["a"] == self.found["node"], "left").select("sig", F.col("a").alias("node"), F.coalesce("component", "a").alias("component")), "listed")
        split = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
        members = self.tables.put(named.join(split, "sig", "left_semi").select("node", "component").distinct(), "members")
        if before is not None:
            return self.tables.put(members.join(before.drop("component"), "node").repartition("node"), "waiting")
        need = self.tables.put(members.join(self.nodes, "node").select(F.col("rep").alias("id"), "node", "component"), "need")
        return self.tables.put(self._arrays(need), "waiting")

    def components(self) -> DataFrame:
        """node, rep, component (a node) of every node."""
        return self.nodes.select("node", "rep").join(self.found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))


class _Part:
    """Cuts batches into parts of bounded size; a plain object, as it travels to executors."""

    def __init__(self, words: int):
        self.words = words

    def of(self, batch: pa.RecordBatch):
        column = batch.column(batch.schema.get_field_index("text"))
        for lo, hi in slices(column, CHUNK_BYTES):
            yield lo, shingle_sets(column.slice(lo, hi - lo), self.words)


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    counts = [blob(x) for x in np.split(total, 32)] if total.any() else []
    return pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.binary())], names=["block", "counts"])


def _rows(sig, owner, nodes, groups, sizes, tallies, sketch, buckets, limit) -> pa.RecordBatch:
    """Entries by bucket and home: the nodes, how many entries each has there, and these entries' low bits. With tallies also groups, sizes and these."""
    at, home, bucket = dealt(sig, nodes[owner], sketch, buckets, limit)
    order = np.lexsort((owner[at], home, bucket))
    at, home, bucket = at[order], home[order], bucket[order]
    key = bucket * buckets + home
    cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
    rows = {"bucket": bucket[cuts[:-1]], "home": home[cuts[:-1]], **{c: [] for c in ("nodes", "groups", "sizes", "tallies", "counts", "sigs")}}
    for a, b in itertools.pairwise(cuts.tolist()):
        who = owner[at[a:b]]
        # A count has 8 bits; a set with more entries in a bucket is listed again.
        first = np.unique(np.concatenate([np.flatnonzero(np.diff(who, prepend=-1)), np.arange(0, b - a, 255)]))
        named = who[first]
        rows["nodes"].append(blob(nodes[named]))
        rows["groups"].append(blob(groups[named]) if tallies else b"")
        rows["sizes"].append(blob(sizes[named]) if tallies else b"")
        rows["tallies"].append(b"".join(blob(tallies[i]) for i in named.tolist()) if tallies else b"")
        rows["counts"].append(blob(np.diff(np.append(first, b - a)).astype(np.uint8)))
        rows["sigs"].append(blob((sig[at[a:b]] & LOW).astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array(rows[c], pa.int32()) if c in ("bucket", "home") else pa.array(rows[c], pa.binary()) for c in rows], names=list(rows))


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set) and component_id.

    Sets are the distinct 5-word shingles of the lower-cased (A-Z) text, words being runs of anything but ASCII
    white space; with fewer words the whole sequence is the one shingle. Two texts link when their intersection
    has at least 4/5 of the size of their union, decided on 64-bit hashes of all shingles (a set as a whole is
    known by 64 bits as well). component_id is the smallest id that links reach. Null, empty and blank texts have
    no shingles and link with nothing, not even each other. Rows with a null id link with nothing and have a null
    component_id. Rows that share an id are one node, whatever their texts: what links to one of them links to
    all. Other columns are not read; an empty table gives an empty one.
    """
    run = Join(docs, id_col, text_col, words)
    sets, tables = run.sets, run.tables
    shared = tables.put(sets.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows"), F.min("node").alias("first")).where("rows > 1").select("id", "first"), "shared")
    repeats = bool(shared.take(1))
    if repeats:
        same = sets.where("node IS NOT NULL").join(shared, "id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        run._merge(same.distinct())
    named = tables.put(run.components(), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    reached = named.join(least, "component").select("node", "component_id")
    out = sets.join(reached, "node", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    if repeats:
        of_id = out.join(shared.select("id"), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("least"))
        out = out.join(of_id, "id", "left").select("id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of docs without near duplicates: of each component of linked texts, the row with the smallest id.

    Of rows that share both that id and the set of shingles one stays; texts that differ are judged by themselves
    even where they share an id. Rows with a null id and rows without words all stay. All columns are kept, with
    any names; an empty table gives an empty one.
    """
    run = Join(docs, id_col, text_col, words)
    of_node = run.components().select("node", "component")
    sets = run.tables.put(run.sets.where("id IS NOT NULL AND node IS NOT NULL").groupBy("id", "node").agg(F.count("*").alias("rows")).join(of_node, "node"), "dealt")
    best = sets.groupBy("component").agg(F.min(F.struct("id", "node")).alias("best"))
    gone = run.tables.put(sets.join(best, "component").where((F.col("best.id") != F.col("id")) | (F.col("best.node") != F.col("node"))).select("id", "node"), "gone")
    if not sets.groupBy("id").agg(F.sum("rows").alias("rows")).where("rows > 1").take(1):
        own = gone.select(F.col("id").alias("_gone"))
        return docs.join(own, docs[id_col].cast("long") == own["_gone"], "left_anti")
    # Some id has several rows: rows are known by id and set.
    marked = annotate(docs, text_col, docs.columns, lambda texts: [pa.array([set_key(s) if len(s) else None for lo, hi in slices(texts, CHUNK_BYTES) for s in shingle_sets(texts.slice(lo, hi - lo), words)], pa.int64())], "node long")
    marked = marked.withColumn("id", F.col("row")[id_col].cast("long"))
    stay = marked.join(gone, ["id", "node"], "left_anti")
    whole = "id IS NOT NULL AND node IS NOT NULL"
    kept = stay.where(whole).dropDuplicates(["id", "node"]).unionByName(stay.where(f"NOT ({whole})"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of the whole of documents: five words, similarity 0.8."""
    found = similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
